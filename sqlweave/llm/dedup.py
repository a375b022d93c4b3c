"""Operator 6 [native]: exact dedup through an extendible-hash index kept as shared files.

1. Entries (row id, doc_id, length, 64-bit key, SHA-256) of all rows are written once to the shared folder.
2. The directory doubles until no bucket holds more than `capacity` different keys, save equal ones, which no bit tells
   apart: a cell is a key's leading bits, and cells that one bucket can hold are merged again, level by level, so each
   bucket has a depth of its own. Doubling ends with the keys' own bits; nothing else bounds it.
3. Equal texts are combined before any shuffle, as the normalised text itself is the grouping key, so bytes are compared.
   What is left, one digest a text, goes to owner tasks: a bucket's key range is one task's. The owner finds for each
   text the row that stays, chains the texts of a key, and writes its part of the index.
4. Every row finds its bucket in the directory and its chain entry in the bucket; hot keys are split by AQE's skew join.
   Texts that share key and digest but not bytes are told apart by the texts themselves.

Defined cases: null counts as empty, and all empty texts are one group; repeated rows (same doc_id and text) are copies
of which one stays; among ties the smallest doc_id stays, null last; very long texts are compared whole; an empty table
gives an empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, stage, table, whole

#: The deleted characters: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
CAPACITY = 16_384
CELLS = 1 << 16  # a directory of at most so many cells (some 2 MB) is broadcast


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def _cell(key: str, depth: int):
    """The leading `depth` bits of a 64-bit key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Index:
    """entries: one row a row; cells: (cell, bucket) of the directory, whose cells are `depth` bits; chains: one row a
    text, written by the owners: bucket, key, digest, group_size, texts, best, chain (its place among its key's texts)."""

    entries: DataFrame
    cells: DataFrame
    depth: int
    small: bool
    chains: DataFrame | None = None

    def owned(self, df: DataFrame) -> DataFrame:
        """df with the bucket of its key; null where no key of the index begins like it."""
        cells = F.broadcast(self.cells) if self.small else self.cells
        return df.withColumn("cell", _cell("key", self.depth)).join(cells, "cell", "left").drop("cell")

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id and keep_id of the equal text in the index, null if it has none: only buckets that docs need are read."""
        rows = self.owned(docs.select("doc_id", F.xxhash64(normalised()).alias("key"), F.sha2(normalised(), 256).alias("digest")))
        return rows.join(self.chains.select("bucket", "key", "digest", F.col("best.d").alias("keep_id")), ["bucket", "key", "digest"], "left").select("doc_id", "keep_id")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(cell, bucket) and the number of bits of a cell; a bucket is 'depth:prefix'. keys: different keys."""
    n = keys.count()
    depth = max(-(-n // max(capacity, 1)) - 1, 0).bit_length()  # fewer cells cannot hold them
    while True:
        cells = stage(keys.groupBy(_cell("key", depth).alias("cell")).agg(F.count("*").alias("n")), "dedup-cells", narrow=True)
        if cells.where(F.col("n") > capacity).isEmpty():  # at 64 bits a cell is one key
            break
        depth += 1
    buckets = cells.select(F.lit(depth).alias("depth"), F.col("cell").alias("prefix"), "n")
    for d in range(depth - 1, -1, -1):
        # all that is under a prefix of d bits: were its halves not merged, it would be too much
        up = F.expr(f"shiftrightunsigned(prefix, depth - {d})")
        pairs = buckets.where(F.col("depth") > d).groupBy(up.alias("up")).agg(F.sum("n").alias("both")).where(F.col("both") <= capacity)
        pairs = stage(pairs, "dedup-merged", narrow=True)
        if pairs.isEmpty():
            break
        rest = buckets.withColumn("up", up).join(pairs.select("up"), "up", "left_anti").drop("up")
        last, buckets = buckets, stage(rest.unionByName(pairs.select(F.lit(d).alias("depth"), F.col("up").alias("prefix"), F.col("both").alias("n"))), "dedup-buckets", narrow=True)
        discard(last, pairs)
    # back to the cells: each falls into the bucket whose prefix its leading bits are
    depths = [r["depth"] for r in buckets.select("depth").distinct().collect()]  # 65 at most
    own = cells.select("cell", F.explode(F.array(*map(F.lit, depths)) if depths else F.array(F.lit(0))).alias("depth"))
    own = own.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - depth)"))
    return stage(own.join(buckets, ["depth", "prefix"]).select("cell", F.concat_ws(":", "depth", "prefix").alias("bucket")), "dedup-directory", narrow=True), depth


def build(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64, digest: int = 64) -> Index:
    """capacity: different keys of a bucket; key_bits, and characters of the digest: fewer than 64 only in tests, to
    force collisions."""
    read = _read(docs, key_bits, digest)
    entries = stage(read.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "len", "key", "digest", "sha"), "dedup-entries")
    cells, depth = directory(stage(entries.select("key").distinct(), "dedup-keys", narrow=True), capacity)
    index = Index(entries, cells, depth, cells.count() <= CELLS)
    texts = read.groupBy("key", "norm").agg(F.count("*").alias("size"), F.first("digest").alias("digest")).select("key", "digest", "size", F.lit(1).alias("texts"), F.lit(None).alias("best"))
    best = F.min(F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_id").alias("r")))
    best = entries.groupBy("key", "digest").agg(best.alias("best")).select("key", "digest", F.lit(0).cast("long").alias("size"), F.lit(0).alias("texts"), "best")
    # owner tasks: all of a bucket is in one partition, so neither grouping nor chaining shuffles again
    mine = index.owned(texts.unionByName(best)).repartition("bucket")
    mine = mine.groupBy("bucket", "key", "digest").agg(F.sum("size").alias("group_size"), F.sum("texts").alias("texts"), F.max("best").alias("best"))
    index.chains = stage(mine.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))), "dedup-chains")
    return index


def _read(docs: DataFrame, key_bits: int = 64, digest: int = 64) -> DataFrame:
    key = F.xxhash64("norm")
    if key_bits < 64:
        key = F.shiftleft(key, 64 - key_bits)
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("len"), normalised().alias("norm"))
    sha = F.sha2("norm", 256)
    return rows.select("doc_id", "len", "norm", key.alias("key"), (F.substring(sha, 1, digest) if digest < 64 else sha).alias("digest"), sha.alias("sha"))


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64, digest: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    index = build(docs, capacity, key_bits, digest)
    out = index.owned(index.entries).join(index.chains, ["bucket", "key", "digest"])
    out = out.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain", "key", "digest", "texts")
    clashes = index.chains.where("texts > 1").select("key", "digest")
    if not clashes.isEmpty():  # different texts of one key and digest: by their bytes
        rows = index.owned(_read(docs, key_bits, digest).join(clashes, ["key", "digest"], "left_semi")).withColumn("row_id", F.monotonically_increasing_id())
        rows = stage(rows, "dedup-clashes")
        order = F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row_id").alias("r"))
        groups = rows.groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
        groups = groups.withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("norm")))
        apart = rows.join(groups, ["key", "norm"])
        apart = apart.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.r")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")
        return out.where("texts = 1").drop("key", "digest", "texts").unionByName(apart)
    return out.drop("key", "digest", "texts")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are matched by doc_id and digest of the whole text, so
    that a row of a repeated doc_id and another text is not touched; of wholly equal (doc_id, text) rows one stays."""
    own = lambda norm: F.concat_ws("|", norm, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    g = exact_groups(docs, **options).where("kept").select(own(F.col("text_sha256")).alias("_own"))
    rows = docs.select(whole(docs), own(F.sha2(normalised(), 256)).alias("_own")).join(g, "_own", "left_semi")
    # rows of one doc_id and normalised text: the longest raw text stays; the window reuses the join's partitioning
    w = Window.partitionBy("_own").orderBy(F.desc(F.length(F.coalesce("row.text", F.lit("")))), "row.text")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
