"""Operator 10: sharding by best-fit-decreasing bin packing (law `bytes`).

Groups of equal texts are indivisible. In falling order of size each enters the shard of the tightest remaining
capacity, found in a balanced tree of capacities; the smallest capacity under which the given number of shards suffices
is found by doubling and halving steps.

The packing is of all groups, yet the driver sees sizes only: groups of one size are interchangeable, and the shard that
takes the first of them stays the tightest one until it is full. So a row of (size, count) is placed in a few runs, with
the result of placing its groups one by one. Different sizes that add up to the corpus are at most sqrt(2 * its bytes),
14 million for 100 TB. Groups are numbered within their size in chunks of about CHUNK, a chunk a task, and the runs of
their numbers tell their shards. Slots follow from prefix sums over chunks, so no shard, size or group is one task.

A group of more than the shards' equal share, and SLACK beyond, cannot be kept whole under the law of near-equal sizes.
It is cut into the fewest pieces: as many of one share as fit, and a rest, each an item of the packing. There are fewer
such groups than shards.

Defined cases: null text counts as empty (size 8, crc32 0) and equals the empty text; repeated rows are separate rows of
one group; ties in size are ordered by a digest of the text; a row of its own that is larger than a share has a shard of
its own; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

SHARDS, CHUNK, SLACK = 24, 1024, 0.01


class Rooms:
    """A treap of (room, shard): insert, remove, and the smallest entry that is not below another, in O(log n)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _weight(key: tuple[int, int]) -> int:
        return ((key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xBF58476D1CE4E5B9) ^ (key[0] >> 7)) & 0xFFFFFFFFFFFF

    def _split(self, node, key):
        """Entries below key, and the others. A node is [key, weight, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._weight(key), None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = self._split(self.root, key)
        _, high = self._split(rest, (key[0], key[1] + 1))
        self.root = self._join(low, high)

    def ceiling(self, key: tuple[int, int]) -> tuple[int, int] | None:
        node, best = self.root, None
        while node is not None:
            if node[0] < key:
                node = node[3]
            else:
                best, node = node[0], node[2]
        return best


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int) -> list[tuple[int, int, int, int]] | None:
    """classes: (size, count) in falling order of size. Runs (class, first, end, bin): items first to end - 1 of a class
    are in that bin; None if more than `bins` bins would be opened."""
    rooms, runs, opened = Rooms(), [], 0
    for k, (size, count) in enumerate(classes):
        done = 0
        while done < count:
            room = rooms.ceiling((size, -1))
            if room is not None:
                rooms.remove(room)
            elif opened < bins and size <= capacity:
                room, opened = (capacity, opened), opened + 1
            else:
                return None
            n = min(count - done, room[0] // size)
            runs.append((k, done, done + n, room[1]))
            rooms.insert((room[0] - n * size, room[1]))
            done += n
    return runs


def pack(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing under the smallest capacity found that needs at most `bins` bins."""
    if not classes:
        return []
    low = max(classes[0][0], -(-sum(s * n for s, n in classes) // bins))
    best, step, high = best_fit(classes, low, bins), 1, low
    while best is None:  # a fit exists once high reaches the sum
        low, high = high + 1, high + step
        best, step = best_fit(classes, high, bins), step * 2
    while low < high:
        mid = (low + high) // 2
        got = best_fit(classes, mid, bins)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return best


def _before(value: str, part: list[str], order: list) -> Column:
    """Sum of value over the rows of a part that come earlier."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def shard(docs: DataFrame, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group"))
    rows = stage(rows, "shard-rows")
    groups = stage(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("each")), "shard-groups", narrow=True)
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    share = max(total // shards, 1)
    over = (F.col("bytes") > int(share * (1 + SLACK))) & (F.col("n") > 1)
    sizes = stage(groups.where(~over).groupBy("bytes").agg(F.count("*").alias("alike")), "shard-sizes", narrow=True)

    # the plan: classes of whole groups by size, and pieces of cut groups, one by one
    items = [(r["bytes"], r["alike"], None) for r in sizes.collect()]  # at most sqrt(2 * total) rows
    for r in groups.where(over).orderBy("group").collect():  # fewer than `shards` rows
        per = max(share // r["each"], 1)
        items += [(min(per, r["n"] - at) * r["each"], 1, (r["group"], at // per, per, min(per, r["n"] - at))) for at in range(0, r["n"], per)]
    items.sort(key=lambda x: (-x[0], x[2] or ()))
    runs, pieces, used = [], [], [0] * shards
    for k, first, end, b in pack([x[:2] for x in items], shards):
        size, _, piece = items[k]
        if piece is None:
            runs.append((size, first, end, b))
        else:  # cut pieces take the first slots of their shards
            pieces.append((*piece[:3], b, used[b]))
            used[b] += piece[3]
    runs = spark.createDataFrame(runs, "bytes long, first long, end long, shard int")
    pieces = spark.createDataFrame(pieces, "group string, piece long, per long, shard int, first long")

    # numbers of groups within their size, and their shards
    whole = groups.where(~over).join(sizes, "bytes").withColumn("chunk", F.pmod(F.xxhash64("group"), F.ceil(F.col("alike") / chunk)))
    units = whole.groupBy("bytes", "chunk").agg(F.count("*").alias("c"))
    units = units.select("bytes", "chunk", _before("c", ["bytes"], ["chunk"]).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("bytes", "chunk").orderBy("group")) - 1
    whole = whole.join(units, ["bytes", "chunk"]).select("group", "bytes", "n", "chunk", (F.col("ahead") + place).alias("number"))
    r = runs.withColumnRenamed("bytes", "_bytes")
    whole = whole.join(r, (F.col("bytes") == F.col("_bytes")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))).select("group", "bytes", "n", "chunk", "number", "shard")
    whole = stage(whole, "shard-placed", narrow=True)

    # slots: units of a shard follow one another, groups within a unit, chunks of rows within a group
    units = whole.groupBy("shard", "bytes", "chunk").agg(F.sum("n").alias("c"))
    start = F.element_at(F.array(*map(F.lit, used)), F.col("shard") + 1)
    units = units.select("shard", "bytes", "chunk", (start + _before("c", ["shard"], [F.desc("bytes"), "chunk"])).alias("ahead"))
    within = _before("n", ["shard", "bytes", "chunk"], ["number"])
    heads = whole.join(units, ["shard", "bytes", "chunk"]).select("group", "n", "shard", (F.col("ahead") + within).alias("first"))
    heads = heads.unionByName(groups.where(over).select("group", "n", F.lit(None).cast("int").alias("shard"), F.lit(0).cast("long").alias("first")))
    part = F.pmod(F.xxhash64("row_id", F.lit(7)), F.ceil(F.col("n") / chunk))
    placed = stage(rows.join(heads, "group").withColumn("part", part), "shard-rows-placed", narrow=True)
    parts = placed.groupBy("group", "part").agg(F.count("*").alias("c"))
    parts = stage(parts.select("group", "part", _before("c", ["group"], ["part"]).alias("ahead")), "shard-parts", narrow=True)
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("group", "part").orderBy("doc_id", "row_id")) - 1
    out = placed.join(parts, ["group", "part"]).withColumn("rank", rank)

    kept = out.where("shard is not null").select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).alias("slot"))
    per = pieces.groupBy("group").agg(F.max("per").alias("per"))
    cut = out.where("shard is null").drop("shard", "first").join(F.broadcast(per), "group").withColumn("piece", F.floor(F.col("rank") / F.col("per")))
    cut = cut.join(F.broadcast(pieces.drop("per")), ["group", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") % F.col("per")).alias("slot"))
    both = kept.unionByName(cut) if any(used) else kept
    return both.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
