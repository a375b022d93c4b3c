"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower-cased words between white space; a shorter text is one shingle). The
join finds texts whose sets have a Jaccard similarity of at least 0.8:

1. Texts with equal words are one node, so copies are never paired. A node has HASHES MinHash values (16 bits kept).
2. Candidates agree in all ROWS values of one of BANDS bands; a pair at 0.8 is missed with odds (1 - 0.8^6)^40 < 1e-5.
   Members of small buckets meet in pairs. In large ones each member meets the bucket's first node, verified links
   merge nodes into classes, and then members outside the bucket's largest class meet the members of other classes
   whose sizes allow 0.8. So pairs within a group of near copies never become rows, and no link between classes is lost;
   within a class that large buckets have joined, links are a spanning set of it rather than all of its pairs.
3. Pruning: the MinHash values of a pair are compared CHUNK at a time; it is dropped once the posterior probability
   (uniform prior) that its similarity reaches 0.8 falls below TOLERANCE.
4. What is left is verified exactly on the shingles themselves, and classes are the connected components of the links.
5. n_links counts all texts at 0.8 or more from a text. Each of them is in its class, so the nodes of a class with a
   member of a large bucket are compared with each other in pieces of PART x PART, exactly on their shingles, and a
   piece gives a number for each of its nodes. In other classes the links of small buckets are all there are.

Defined cases: null and empty texts have no words: each is a class of its own without links; a text below five words
is one shingle; repeated rows and copies share a class; class_id is the smallest doc_id of the class (null only if no
member has an id); texts are read whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, stage, table, whole

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
SMALL = 12  # members of a bucket that are paired outright
CHUNK, TOLERANCE = 24, 1e-6
PART = 256  # members of a large bucket or class that are compared in one piece
COLUMNS = 4096  # shingles that are counted at once


def shingles(text: str | None) -> set[str]:
    words = (text or "").lower().split()
    if not words:
        return set()
    return {" ".join(words[i : i + WORDS]) for i in range(max(len(words) - WORDS + 1, 1))}


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / max(len(a) + len(b) - both, 1)


class Signer:
    """MinHash over hashed words: a shingle's hash mixes the hashes of its words by position."""

    def __init__(self, cached_words: int = 100_000):
        draw = np.random.default_rng(42)
        self.a = draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
        self.place = draw.integers(0, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
        self.cache: dict[str, int] = {}
        self.cached_words = cached_words

    def _word(self, w: str) -> int:
        h = self.cache.get(w)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
            if len(w) <= 64:
                if len(self.cache) >= self.cached_words:
                    self.cache.clear()
                self.cache[w] = h
        return h

    def hashes(self, words: list[str]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles."""
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        n = max(len(words) - WORDS + 1, 1)
        mixed = np.zeros(n, np.uint64)
        for j in range(min(WORDS, len(words))):
            mixed += h[j : j + n] * self.place[j]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(mixed)

    def sign(self, hashes: np.ndarray) -> np.ndarray:
        """The low half of each minimum, after blocks that fit the processor's cache."""
        low = np.full(HASHES, np.uint32(0xFFFFFFFF))
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(short), 512):
            part = short[i : i + 512]
            np.minimum(low, (self.a[:, None] * part + self.b[:, None]).min(1), out=low)
        return (low ^ (low >> np.uint32(16))).astype(np.uint16)


_SIGNER: list[Signer] = []


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SIGNER:
        _SIGNER.append(Signer())
    s = _SIGNER[0]
    for batch in batches:
        node, size, sig = [], [], []
        for text in batch.column("text").to_pylist():
            words = (text or "").lower().split()
            if not words:
                node.append(None), size.append(0), sig.append(None)
                continue
            node.append(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest())
            h = s.hashes(words)
            size.append(len(h))
            sig.append(s.sign(h).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["doc_id", "tk", "node", "size", "sig"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, text -> nid, MinHash values, all shingle hashes."""
    s = Signer()
    for batch in batches:
        found = [s.hashes((t or "").lower().split()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array([s.sign(h).tobytes() for h in found], pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], names=["nid", "sig", "hashes"])


def least_matches() -> list[tuple[int, int]]:
    """(values compared, matches below which the posterior P(similarity >= 0.8) < TOLERANCE), for each chunk.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at 0.8 is the binomial probability of
    at most m successes in n + 1 draws of 0.8.
    """
    out = []
    for n in range(CHUNK, HASHES + 1, CHUNK):
        tail, m = 0.0, -1
        while m < n:
            term = math.comb(n + 1, m + 1) * THRESHOLD ** (m + 1) * (1 - THRESHOLD) ** (n - m)
            if tail + term >= TOLERANCE:
                break
            tail, m = tail + term, m + 1
        out.append((n, m + 1))
    return out


def _prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bounds = least_matches()
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
        alive, got, at = np.arange(len(x)), np.zeros(len(x), np.int32), 0
        for n, least in bounds:
            got[alive] += (x[alive, at:n] == y[alive, at:n]).sum(1, dtype=np.int32)
            alive, at = alive[got[alive] >= least], n
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, own = None, set()
    for batch in batches:
        a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
        keep = []
        for i in range(len(a)):
            if a[i] != last:
                last, own = a[i], shingles(ta[i])
            other = shingles(tb[i])
            both = len(own & other)
            if 5 * both >= 4 * (len(own) + len(other) - both):  # exactly 0.8 counts
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(nid, label): label is the smallest node of the component. edges: a, b (long).

    Each round takes the smallest label among neighbours, then the label of that label; every other round's table is
    kept in the shared folder, and nothing is collected but whether labels changed.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "components-edges", narrow=True)
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("nid"), F.least("a", "m").alias("label")), "components", narrow=True)

    def turn(labels: DataFrame) -> DataFrame:
        near = both.join(labels, F.col("b") == F.col("nid")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("nid") == F.col("a")).select("nid", F.least("label", "m").alias("label"))
        jump = labels.select(F.col("nid").alias("j"), F.col("label").alias("to"))
        return step.join(jump, F.col("label") == F.col("j")).select("nid", F.least("label", "to").alias("label"))

    while True:
        step = turn(turn(labels)).join(labels.toDF("was_nid", "was"), F.col("nid") == F.col("was_nid")).select("nid", "was", "label")
        step = stage(step, "components", narrow=True)
        discard(labels)
        if step.where("label != was").isEmpty():
            return step.select("nid", "label")
        labels = step.select("nid", "label")
        labels._stage_path = step._stage_path


def _apart(outside: DataFrame, inside: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) that join different classes of a bucket.

    Both sides are cut into parts of about PART rows. A part of one meets each part of the other in Python: MinHash
    values are compared and pruned as matrices, what is left is compared on all shingle hashes, and a link becomes a
    row only if it joins what the piece has not joined yet. So a piece gives fewer rows than it has members, whatever
    the number of similar pairs; the caller verifies the links on the texts."""
    keys = ["bucket", "near"]
    out_n = outside.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("po"))
    in_n = inside.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("pi"))
    parts = stage(out_n.join(in_n, keys), "jaccard-parts", narrow=True)  # so that the joins below have exchanges that AQE can split
    own = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = outside.join(parts, keys).select(*keys, own("po").alias("o"), every("pi").alias("i"), "nid", "size", "label").join(full, "nid")
    right = inside.join(parts, keys).select(*keys, every("po").alias("o"), own("pi").alias("i"), "nid", "size", "label", "main").join(full, "nid")

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.rename(columns=lambda c: c.removesuffix("_y"))
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        (nid_x, size_x, label_x), (nid_y, size_y, label_y) = ((t["nid"].to_numpy(), t["size"].to_numpy(), t["label"].to_numpy()) for t in (x, y))
        fits = (5 * np.minimum.outer(size_x, size_y) >= 4 * np.maximum.outer(size_x, size_y)) & (label_x[:, None] != label_y[None, :])
        fits &= y["main"].to_numpy(bool)[None, :] | (nid_x[:, None] < nid_y[None, :])
        i, j = np.nonzero(fits)
        mx, my = (np.frombuffer(b"".join(t["sig"]), np.uint16).reshape(-1, HASHES) for t in (x, y))
        got, at = np.zeros(len(i), np.int32), 0
        for n, least in least_matches():
            got = got + (mx[i, at:n] == my[j, at:n]).sum(1, dtype=np.int32)
            keep = got >= least
            i, j, got, at = i[keep], j[keep], got[keep], n
        hx, hy = ([np.frombuffer(h, np.uint64) for h in t["hashes"]] for t in (x, y))
        parent: dict[int, int] = {}

        def find(k: int) -> int:
            while parent.setdefault(k, k) != k:
                k = parent[k]
            return k

        out = []
        for k in np.argsort(-got, kind="stable"):
            a, b = i[k], j[k]
            ra, rb = find(int(label_x[a])), find(int(label_y[b]))
            if ra != rb:
                both = len(np.intersect1d(hx[a], hy[b], assume_unique=True))
                if 5 * both >= 4 * (len(hx[a]) + len(hy[b]) - both):
                    parent[ra] = rb
                    out.append((min(nid_x[a], nid_y[b]), max(nid_x[a], nid_y[b])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    group = [*keys, "o", "i"]
    names = {c: f"{c}_y" for c in right.columns}  # both sides stem from one table
    right = right.toDF(*names.values())
    return left.groupBy(*group).cogroup(right.groupBy(*[names[k] for k in group])).applyInPandas(meet, "a long, b long").distinct()


def _shared(ids: list[np.ndarray], width: int, n: int) -> np.ndarray:
    """Common shingles of each of the first n rows with each of the rest. ids: each row's shingles, as sorted numbers below width."""
    out = np.zeros((n, len(ids) - n), np.int64)
    for at in range(0, width, COLUMNS):
        m = np.zeros((len(ids), COLUMNS), np.float32)
        for row, v in enumerate(ids):
            lo, hi = np.searchsorted(v, (at, at + COLUMNS))
            m[row, v[lo:hi] - at] = 1
        out += (m[:n] @ m[n:].T).astype(np.int64)
    return out


def _count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by label, o, i -> (nid, n): links of a node within one piece. A piece may reach over batches."""

    def run(key: tuple, nids: list[int], parts: list[int], texts: list[str]) -> pd.DataFrame:
        number: dict[str, int] = {}
        ids = [np.sort(np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own))) for own in map(shingles, texts)]
        size, nid, part = np.array([len(v) for v in ids]), np.array(nids), np.array(parts)
        x, y = np.flatnonzero(part == key[1]), np.flatnonzero(part == key[2])
        both = _shared([ids[k] for k in (*x, *y)], len(number), len(x))
        linked = 5 * both >= 4 * (size[x][:, None] + size[y][None, :] - both)  # exactly 0.8 counts
        if key[1] == key[2]:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"nid": nid[x], "n": linked.sum(1)})
        return pd.DataFrame({"nid": np.concatenate([nid[x], nid[y]]), "n": np.concatenate([linked.sum(1), linked.sum(0)])})

    last, piece = None, ([], [], [])
    for pdf in batches:
        for label, o, i, *row in zip(*(pdf[c].tolist() for c in ("label", "o", "i", "nid", "part", "text"))):
            if last != (label, o, i):
                if last is not None:
                    yield run(last, *piece)
                last, piece = (label, o, i), ([], [], [])
            for values, v in zip(piece, row):
                values.append(v)
    if last is not None:
        yield run(last, *piece)


def _degrees(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(nid, n_links): for each of nodes (nid, label) the nodes of its label at 0.8 or more. texts: nid, text.

    A label's nodes are cut into parts of about PART, and each two parts, or one with itself, are a piece."""
    parts = nodes.groupBy("label").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    own = nodes.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pieces = own.select("label", "nid", "part", other.alias("other")).select("label", F.least("part", "other").alias("o"), F.greatest("part", "other").alias("i"), "nid", "part")
    dealt = pieces.join(texts, "nid").repartition("label", "o", "i").sortWithinPartitions("label", "o", "i")
    return dealt.mapInPandas(_count, "nid long, n long").groupBy("nid").agg(F.sum("n").alias("n_links"))


def similar(docs: DataFrame, count: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, tk, nid), degrees (nid, n_links) and labels (nid, label) of linked nodes. Without count, n_links is
    only above 0 where a node has links."""
    read = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tk"), "text")
    signed = stage(read.mapInArrow(_sign, read.schema["doc_id"].name + " " + read.schema["doc_id"].dataType.simpleString() + ", tk string, node binary, size int, sig binary"), "jaccard-rows")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("sig").alias("sig"), F.min("tk").alias("tk"))
    nodes = stage(nodes.withColumn("nid", F.monotonically_increasing_id()), "jaccard-nodes")
    sig = nodes.select("nid", "sig")

    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 1 + i * width, width)) for i in range(BANDS)])
    banded = nodes.select("nid", "size", F.explode(bands).alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("nid").alias("first")).where("n > 1")
    members = stage(banded.join(buckets, "bucket"), "jaccard-members", narrow=True)
    # one text for each node of a bucket, fetched once; equal texts are combined before the shuffle
    texts = read.groupBy("tk").agg(F.first("text").alias("text"))
    texts = stage(members.select("nid").distinct().join(nodes.select("nid", "tk"), "nid").join(texts, "tk").select("nid", "text"), "jaccard-texts")

    def prune(pairs: DataFrame) -> DataFrame:
        one, two = sig.toDF("a", "sa"), sig.toDF("b", "sb")
        return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_prune, "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "jaccard-pairs", narrow=True)
        # the first nodes of large buckets are in many pairs: their join comes last, where AQE splits it, and its output
        # is sorted by them, so that a task has the shingles of a once
        both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
        return stage(both.mapInArrow(_verify, "a long, b long"), "jaccard-links")

    few = members.where(f"n <= {SMALL}").select("bucket", "nid")
    pairs = few.join(few.toDF("bucket", "other"), "bucket").where("nid < other").select(F.col("nid").alias("a"), F.col("other").alias("b"))
    many = members.where(f"n > {SMALL}")
    stars = many.where("nid != first").select(F.col("first").alias("a"), F.col("nid").alias("b"))
    links = verify(prune(pairs.union(stars).distinct()))
    labels = components(links)

    # members of large buckets that the first node did not bring into the bucket's largest class
    named = stage(many.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid")).select("bucket", "nid", "size", "label"), "jaccard-classes", narrow=True)
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("m"), F.count("*").alias("classes")).where("classes > 1").select("bucket", F.col("m.label").alias("main"))
    # sizes of a pair at 0.8 are in the same or in neighbouring steps of factor 1.25
    step = F.floor(F.log(F.col("size")) / math.log(1 / THRESHOLD)).cast("int")
    open_ = named.join(main, "bucket").withColumn("step", step)
    outside = open_.where("label != main").withColumn("near", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    inside = open_.withColumn("near", F.col("step")).withColumn("main", F.col("label") == F.col("main"))
    full = stage(texts.join(open_.select("nid").distinct(), "nid").mapInArrow(_hashed, "nid long, sig binary, hashes binary"), "jaccard-hashes")
    more = verify(_apart(outside.select("bucket", "near", "nid", "size", "label"), inside.select("bucket", "near", "nid", "size", "label", "main"), full))
    if not more.isEmpty():
        links = stage(links.union(more).distinct(), "jaccard-links", narrow=True)
        labels = components(links)
    rows = signed.select("doc_id", "tk", "node").join(nodes.select("node", "nid"), "node", "left").select("doc_id", "tk", "nid")
    degree = links.select(F.col("a").alias("nid")).union(links.select("b")).groupBy("nid").agg(F.count("*").alias("n_links"))
    if count:
        large = labels.join(many.select("nid").distinct(), "nid").select("label").distinct()
        inner = stage(labels.join(large, "label").select("nid", "label"), "jaccard-inner", narrow=True)
        degree = stage(degree.join(inner, "nid", "left_anti").union(_degrees(inner, texts)), "jaccard-degrees", narrow=True)
    return rows, degree, labels


def classes(docs: DataFrame, count: bool = True) -> DataFrame:
    """doc_id, tk, class_id, n_links, stays: one row per row of docs. n_links counts the verified links of the row's
    text with other texts (without count, only whether there are any); `stays` marks the text and id that represent a
    class."""
    rows, degree, labels = similar(docs, count)
    rows = rows.join(labels, "nid", "left").join(degree, "nid", "left")
    # a text without words is a class of its own row
    label = F.when(F.col("nid").isNotNull(), F.coalesce("label", "nid"))
    rows = stage(rows.select("doc_id", "tk", label.alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "jaccard-labelled")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tk")).alias("m"), F.count("*").alias("class_size"))
    first = stage(first, "jaccard-first", narrow=True)  # so that the join has an exchange of its own, which AQE can split
    out = rows.join(first, "label", "left")
    stays = F.col("m").isNull() | (F.col("m.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("m.tk") == F.col("tk")))
    return out.select("doc_id", "tk", F.when(F.col("m").isNull(), F.col("doc_id")).otherwise(F.col("m.doc_id")).alias("class_id"), "n_links", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), stays.alias("stays"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that represent their class; of wholly equal (doc_id, text) rows with words one stays."""
    own = lambda tk: F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), tk)
    kept = classes(docs, count=False).where("stays").groupBy(own(F.col("tk")).alias("_own")).agg(F.count("*").alias("_n"), F.max((F.col("class_size") > 1) | (F.col("n_links") > 0)).alias("_g"))
    rows = docs.select(whole(docs), own(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("_own")).join(kept, "_own")
    place = F.row_number().over(Window.partitionBy("_own").orderBy("_own"))
    return rows.withColumn("_i", place).where("not _g or _i = 1").select("row.*")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")
