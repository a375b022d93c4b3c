"""Operator 7: mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target / size of the source. Its whole part is
taken for certain; the fractions are rounded in pairs of documents: words are moved at random from one partner to the
other, in either direction with the odds that keep both expectations, until one of the two is integral; the other goes
on to the next. Within a block documents are met in falling order of size: partners are then of like size, so the one
that goes on is either the smaller or all but integral, and what stays fractional in the end is small. That needs partners of
like size, which a document of more than 1/HEAVY of its block lacks (in a source of a few thousand documents or less):
such a document comes first, and its partner is all that follow, which still have one fraction in common, provided that
they can take in its mass and stay fractional; else it waits for the pairs. Blocks of a source are rounded apart and their residuals paired in a reduction
tree of fan-in FAN, so a hot source is many blocks; the sum of words is kept exactly but for the last residual of a
source, one document, which is rounded with its own odds. Draws come from a hash of ids and a seed, so reruns agree.

Defined cases: null text has size 0 and takes 0 words; sources are ordered by code point, null last (a source of its
own); ties in size are ordered by hash and doc_id; repeated rows are separate documents; a source of size 0 has target
0; an empty table gives an empty result; only doc_id, source and text are read.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table, whole

WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, FAN, HEAVY = 4096, 64, 100


def word_count(text: str = "text"):
    """Number of runs of other characters than U+0020 and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, target: one row a source.

    Resharing the excess by weight ends where the sources that are stopped at MOST times their size are those of the
    smallest size / weight, and the others share what is left by weight; prefix sums over that order find the end.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST)
    level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    whole, before = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), level.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("share", left / rest)
    s = s.withColumn("open", F.when(F.col("cap") / F.col("w") >= F.col("share"), F.col("share")))
    s = s.withColumn("share", F.coalesce(F.max("open").over(whole), F.lit(0.0)))  # later places give lower levels
    return s.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("w") * F.col("share")).alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    """A number in [0, 1) from two ids (splitmix64)."""
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * m) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(keys: list[int], sizes: list[int], parts: list[float], seed: int) -> tuple[list[float], int]:
    """Round fractions in pairs; returns the fractions and the place of the one that may still be fractional, or -1.

    With words moved from b to a: at most min((1 - xa) * sa, xb * sb), and back min(xa * sa, (1 - xb) * sb).
    """
    x, tiny = list(parts), 1e-9
    a = -1
    for b in range(len(x)):
        if not tiny < x[b] < 1 - tiny:
            x[b] = float(round(x[b]))
            continue
        if a < 0:
            a = b
            continue
        up, down = min((1 - x[a]) * sizes[a], x[b] * sizes[b]), min(x[a] * sizes[a], (1 - x[b]) * sizes[b])
        move = up if _draw(seed, keys[a], keys[b]) * (up + down) < down else -down
        x[a] += move / sizes[a]
        x[b] -= move / sizes[b]
        open_a, open_b = (tiny < x[i] < 1 - tiny for i in (a, b))
        for i, still in ((a, open_a), (b, open_b)):
            if not still:
                x[i] = float(round(x[i]))
        a = a if open_a else b if open_b else -1
    return x, a


def pivot_block(keys: list[int], sizes: list[int], part: float, seed: int) -> tuple[list[float], int]:
    """Round documents (falling sizes) that share one fraction: heavy ones against all that follow, the others in pairs."""
    total, x, out = sum(sizes), part, {}
    rest = total
    for a, s in enumerate(sizes):
        if s * HEAVY <= total:
            break
        rest -= s
        up, down = (1 - x) * s, x * s  # words that it takes from the others, or gives to them
        if up < 0.999 * x * rest and down < 0.999 * (1 - x) * rest:
            took = _draw(seed, keys[a], a) < x
            out[a], x = (1.0, x - up / rest) if took else (0.0, x + down / rest)
        else:
            rest += s  # it stays among those that follow
    open_ = [i for i in range(len(sizes)) if i not in out]
    got, left = pivot([keys[i] for i in open_], [sizes[i] for i in open_], [x] * len(open_), seed)
    out |= dict(zip(open_, got))
    return [out[i] for i in range(len(sizes))], open_[left] if left >= 0 else -1


def round_copies(items: DataFrame, seed: int = 17) -> DataFrame:
    """items: row_id, key, source, size, part in [0, 1), block. Returns row_id, extra (0 or 1)."""

    def level(df: DataFrame, leaf: bool) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "key", "row_id"], ascending=[False, True, True], kind="stable")
            keys, sizes, parts = [k & 0xFFFFFFFFFFFFFFFF for k in pdf["key"].tolist()], pdf["size"].tolist(), pdf["part"].tolist()
            x, left = pivot_block(keys, sizes, parts[0], seed) if leaf else pivot(keys, sizes, parts, seed)
            return pdf.assign(part=x, still=[i == left for i in range(len(x))])

        return df.groupBy("source", "block").applyInPandas(run, "row_id long, key long, source string, size long, part double, block long, still boolean")

    done, leaf = None, True
    blocks = items.agg((F.max("block") + 1).alias("n")).first()["n"] or 1
    while True:
        got = stage(level(items, leaf), "mix-level", narrow=True)
        leaf = False
        settled = got.where("not still").select("row_id", "part")
        done = settled if done is None else done.unionByName(settled)
        items = got.where("still").drop("still").withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
    # the last residual of a source: one document at most, rounded with its own odds
    toss = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / float(1 << 30)
    last = items.select("row_id", F.when(toss < F.col("part"), 1.0).otherwise(0.0).alias("part"))
    return done.unionByName(last).select("row_id", F.col("part").cast("long").alias("extra"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """row_id, doc_id, source, digest, size, source_size, target, copies, taken: one row per row of docs."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", word_count().alias("size"), digest.alias("digest"))
    rows = stage(rows, "mix-sizes")
    targets = stage(source_targets(rows), "mix-targets", narrow=True)
    # one row a source: joined by AQE as its size allows; rows of a hot source are split by skew join
    t = targets.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_s")
    j = rows.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    j = j.withColumn("whole", F.floor("share").cast("long")).withColumn("part", F.col("share") - F.floor("share"))
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "digest")
    block = F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / BLOCK).cast("long"))
    items = j.where("size > 0 and part > 0").withColumn("key", key).select("row_id", "key", "source", "size", "part", block.alias("block"))
    out = j.join(round_copies(items, seed), "row_id", "left")
    copies = F.col("whole") + F.coalesce("extra", F.lit(0))
    return out.select("row_id", "doc_id", "source", "digest", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix takes them. Copies of equal (doc_id, source, text) rows are added up and
    dealt out again among them, so repeated rows need no identity."""
    own = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.coalesce("text", F.lit(""))).cast("string"), F.xxhash64("source", F.col("source").isNull()).cast("string"))
    m = mix(docs, seed)
    m = m.withColumn("_own", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest").cast("string"), F.xxhash64("source", F.col("source").isNull()).cast("string")))
    total = m.groupBy("_own").agg(F.sum("copies").alias("_c"), F.count("*").alias("_n")).where("_c > 0")
    rows = docs.select(whole(docs), own.alias("_own")).join(total, "_own")
    place = F.row_number().over(Window.partitionBy("_own").orderBy("_own"))
    share = F.floor(F.col("_c") / F.col("_n")) + (F.col("_i") <= F.col("_c") % F.col("_n")).cast("long")
    rows = rows.withColumn("_i", place).withColumn("_k", share.cast("int")).where("_k > 0")
    return rows.withColumn("_x", F.explode(F.sequence(F.lit(1), F.col("_k")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


