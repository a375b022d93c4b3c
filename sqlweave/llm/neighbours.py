"""Operator 9: approximate nearest neighbours by NN-descent and greedy graph search.

1. Rows of equal vectors are one node; its members keep their ids, so thousands of equal vectors cost one node.
2. The graph starts from blocks of nodes that random hyperplanes put together (several draws), each node keeping its
   DEGREE best of the block. NN-descent then joins neighbours of neighbours: a node's best neighbours (JOIN old, twice as
   many new) and JOIN of the nodes that have it as a neighbour meet in a local join, where at least one of a pair is
   new, and pairs that beat a node's worst neighbour become its neighbours. It stops when few lists change.
3. A query starts at its own node and searches the graph greedily: the best unexpanded nodes of its beam are expanded
   by a join with the graph, until no beam has an unexpanded node.
4. The beam's nodes are scored again in double precision on the original vectors, and their members ranked.

Every row is indexed. Vectors travel as bytes with a scale while the graph is built and searched; the answers' order and
scores come from the original vectors.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part; a vector that is
shorter than the longest counts as having zeros at its end; ties go to the smaller vec_id; rows that repeat a vec_id count as separate
candidates, but a query's own id is never its neighbour; a query with fewer than 20 candidates gets them all; an empty
table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, stage, table

EVERY, TOP = 20, 20
DEGREE, JOIN, ROUNDS = 48, 24, 7
BLOCK, DRAWS = 256, 4
BEAM, EXPAND, MEASURED = 128, 40, 52_000  # the beam of tables of up to MEASURED nodes


def valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    good = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null").where(good)


def _pack(rows: pd.Series) -> pd.Series:
    """A vector as its scale (float32) and bytes of its components (int8): 1/8 of the size, errors of 1/250 of its
    largest component."""
    out = []
    for r in rows:
        v = np.asarray(r, float)
        scale = np.float32(max(np.abs(v).max(), 1e-30) / 127)
        out.append(scale.tobytes() + np.rint(v / float(scale)).clip(-127, 127).astype(np.int8).tobytes())
    return pd.Series(out)


def _matrix(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
    return raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _best(df: DataFrame, degree: int) -> DataFrame:
    """The `degree` best neighbours of each node, out of (node, other, score, fresh) rows; old entries win over new.

    One shuffle by node serves the removal of double pairs, the ranking, and each list's worst score."""
    one = df.repartition("node").groupBy("node", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("node").orderBy(F.desc("score"), "other")
    kept = one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree)
    whole = Window.partitionBy("node")
    full = F.when(F.count("*").over(whole) >= degree, F.min("score").over(whole))
    return kept.withColumn("worst", F.coalesce(full, F.lit(float("-inf")).cast("float")))


def _groups(batches: Iterator[pd.DataFrame], key: list[str], run) -> Iterator[pd.DataFrame]:
    """Runs over the groups of batches that are sorted by key; a group may reach over batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        k = pdf[key].to_numpy()
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist()]
        got = [run(pdf.iloc[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
        rest = pdf.iloc[cuts[-1] :]
        if got := [g for g in got if g is not None]:
            yield _pairs(got)
    if rest is not None and not rest.empty and (last := run(rest)) is not None:
        yield _pairs([last])


def _pairs(parts: list[tuple]) -> pd.DataFrame:
    node, other, score = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return pd.DataFrame({"node": node.astype("int64"), "other": other.astype("int64"), "score": score.astype("float32"), "fresh": np.ones(len(node), bool)})


SCHEMA = "node long, other long, score float, fresh boolean"


def _block_pairs(nodes: DataFrame, n: int, width: int, degree: int, draws: int) -> DataFrame:
    """Neighbours within blocks of about BLOCK nodes that share the signs on random hyperplanes, for several draws.

    Bits grow with the number of nodes; a block that is still large is dealt by hash into parts of bounded size."""
    bits = max(int(np.ceil(np.log2(max(n, 1) / BLOCK))), 0)
    planes = [np.random.default_rng(100 + d).normal(size=(max(bits, 1), width)) for d in range(draws)]

    @F.pandas_udf("array<long>")
    def codes(blobs: pd.Series) -> pd.Series:
        m, power = _matrix(blobs.tolist()), 1 << np.arange(bits)
        cols = [((m @ p.T > 0)[:, :bits] * power).sum(1) * draws + d if bits else np.full(len(m), d) for d, p in enumerate(planes)]
        return pd.Series(list(np.stack(cols, 1).astype("int64")))

    coded = nodes.select("nid", "vec", F.explode(codes("vec")).alias("block"))
    parts = coded.groupBy("block").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
    coded = coded.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("nid", "block"), F.col("parts")))

    def run(pdf: pd.DataFrame):
        m, ids = _matrix(pdf["vec"].tolist()), pdf["nid"].to_numpy()
        s = m @ m.T
        np.fill_diagonal(s, -np.inf)
        k = min(degree, len(ids) - 1)
        if k < 1:
            return None
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        return np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()

    dealt = coded.select("block", "part", "nid", "vec").repartition("block", "part").sortWithinPartitions("block", "part")
    return dealt.mapInPandas(lambda it: _groups(it, ["block", "part"], run), SCHEMA)


def _local_join(pdf: pd.DataFrame):
    """Pairs of one node's neighbours, one of them new, that beat the worst neighbour of the first."""
    fresh = pdf["fresh"].to_numpy(bool)
    if not fresh.any():
        return None
    m, ids, worst = _matrix(pdf["vec"].tolist()), pdf["nid"].to_numpy(), pdf["worst"].to_numpy()
    s = m @ m.T
    a, b = np.nonzero((fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]) & (s > worst[:, None]))
    return (ids[a], ids[b], s[a, b]) if len(a) else None


def build_graph(nodes: DataFrame, n: int, width: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(node, other, score): the neighbour graph of nodes (nid, vec)."""
    graph = stage(_best(_block_pairs(nodes, n, width, degree, DRAWS), degree), "ann-graph", narrow=True)
    offers = (F.col("fresh") & (F.col("r") <= 2 * JOIN)) | (F.col("r") <= JOIN)
    for turn in range(rounds):
        ahead = graph.where(offers).select(F.col("node").alias("centre"), F.col("other").alias("nid"), "fresh")
        # reverse lists are cut by a hash that changes with the turn, before and after the shuffle
        w = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("nid", F.lit(turn)))
        back = ahead.select(F.col("nid").alias("centre"), F.col("centre").alias("nid"), "fresh").withColumn("r", F.row_number().over(w)).where(F.col("r") <= JOIN).drop("r")
        known = graph.where("r = 1").select(F.col("node").alias("nid"), "worst")
        met = ahead.unionByName(back).join(known, "nid").join(nodes, "nid").select("centre", "nid", "vec", "worst", "fresh")
        found = met.repartition("centre").sortWithinPartitions("centre").mapInPandas(lambda it: _groups(it, ["centre"], _local_join), SCHEMA)
        # entries that took part are old from now on
        kept = graph.select("node", "other", "score", (F.col("fresh") & ~offers).alias("fresh"))
        last, graph = graph, stage(_best(kept.unionByName(found), degree), "ann-graph", narrow=True)
        discard(last)
        if graph.where("fresh").count() < 0.02 * degree * n:
            break
    return graph.select("node", "other", "score")


def _exact(pdf_rows: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([float(np.dot(np.asarray(a, float), np.asarray(b, float))) for a, b in zip(pdf_rows, other)])


def beam_of(n: int) -> int:
    """Nodes of a beam: a table five times as large needs about twice as many for the same recall, so the square root."""
    return int(np.ceil(BEAM * max(1.0, n / MEASURED) ** 0.5))


def search(vectors: DataFrame, every: int = EVERY, top: int = TOP, beam_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for rows whose vec_id is divisible by `every`. beam_size: else by the table's size."""
    rows = valid(vectors)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    padded = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("embedding")))
    rows = stage(rows.withColumn("embedding", padded).withColumn("vk", F.md5(F.array_join(F.transform("embedding", lambda x: (x + 0.0).cast("string")), ",").cast("binary"))), "ann-rows")
    distinct = stage(rows.groupBy("vk").agg(F.first("embedding").alias("embedding")).withColumn("nid", F.monotonically_increasing_id()), "ann-distinct")
    n = distinct.count()
    most = beam_size or beam_of(n)
    nodes = stage(distinct.select("nid", F.pandas_udf(_pack, "binary")("embedding").alias("vec")), "ann-nodes")
    graph = build_graph(nodes, n, width)

    member = stage(rows.select("vec_id", "vk").join(distinct.select("vk", "nid"), "vk").select("vec_id", "nid"), "ann-members", narrow=True)
    asked = member.where(F.col("vec_id") % every == 0).select("nid").distinct()  # equal queries search once
    qvec = stage(asked.join(nodes, "nid").select(F.col("nid").alias("q"), F.col("vec").alias("qv")), "ann-queries")

    @F.pandas_udf("float")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_matrix(a.tolist()) * _matrix(b.tolist())).sum(1) if len(a) else np.zeros(0, np.float32))

    def settled(rows: DataFrame) -> DataFrame:
        """The `most` best nodes of each query; the EXPAND best that were not expanded yet are to go."""
        rows = rows.repartition("q").groupBy("q", "nid").agg(F.max("score").alias("score"), F.max("done").alias("done"))
        best, todo = Window.partitionBy("q").orderBy(F.desc("score"), "nid"), Window.partitionBy("q", "done").orderBy(F.desc("score"), "nid")
        rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).withColumn("t", F.row_number().over(todo))
        return rows.select("q", "nid", "score", "done", ((~F.col("done")) & (F.col("t") <= EXPAND)).alias("go"))

    edges = graph.select(F.col("node").alias("nid"), F.col("other"), F.col("score").alias("edge"))
    start = qvec.select("q", F.col("q").alias("nid")).join(nodes, "nid")
    start = start.join(qvec, "q").select("q", "nid", near("qv", "vec").alias("score"), F.lit(False).alias("done"))
    beam = stage(settled(start), "ann-beam", narrow=True)
    while True:  # ends: a beam's worst score only rises, and a node is expanded once while it is in the beam
        go = beam.where("go").select("q", "nid")
        if go.isEmpty():
            break
        found = go.join(edges, "nid").select("q", F.col("other").alias("nid"), F.lit(False).alias("old"))
        # nodes that the beam has, and double finds, are left out before vectors are fetched
        new = found.unionByName(beam.select("q", "nid", F.lit(True).alias("old"))).repartition("q").groupBy("q", "nid").agg(F.max("old").alias("old")).where("not old").drop("old")
        new = new.join(qvec, "q").join(nodes, "nid").select("q", "nid", near("qv", "vec").alias("score"), F.lit(False).alias("done"))
        last, beam = beam, stage(settled(beam.select("q", "nid", "score", (F.col("done") | F.col("go")).alias("done")).unionByName(new)), "ann-beam", narrow=True)
        discard(last)

    exact = F.pandas_udf(_exact, "double")
    e1, e2 = distinct.select(F.col("nid").alias("q"), F.col("embedding").alias("e1")), distinct.select("nid", F.col("embedding").alias("e2"))
    pairs = stage(beam.select("q", "nid").join(e1, "q").join(e2, "nid").select("q", "nid", exact("e1", "e2").alias("score")), "ann-pairs")
    # of each node the smallest top + 1 ids suffice: one may be the query itself
    w = Window.partitionBy("nid").orderBy("vec_id")
    few = member.groupBy("nid").agg(F.count("*").alias("c"))
    first = member.join(few.where(f"c > {top + 1}").select("nid", F.lit(True).alias("large")), "nid", "left")
    part = F.spark_partition_id()
    cut = first.where("large").withColumn("r", F.row_number().over(Window.partitionBy("nid", part).orderBy("vec_id"))).where(F.col("r") <= top + 1).drop("r")
    cut = cut.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top + 1).select("vec_id", "nid")
    heads = stage(first.where("large is null").select("vec_id", "nid").unionByName(cut), "ann-heads", narrow=True)
    answers = pairs.join(heads, "nid").select("q", "vec_id", "score")
    # as many as any query of this node can need
    answers = answers.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= top + 1).drop("r")
    queries = member.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("nid").alias("q"))
    out = queries.join(answers, "q").where("query_id != vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= top)
    return out.select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
