"""Operator 4 [native]: secret scans with multipart credential linking.

Base kinds (always reported) are assign, access and hex. The method adds weak candidates: short access identifiers
(`ident`), short secrets (`weak`) and endpoints (`endpoint`). Alone they are noise; they are reported only where
complementary parts meet in scope, that is, where at most SCOPE code points lie between the two spans, wherever in the
text they are. The interval join is a sweep: parts of a text become rows, sorted by place; the furthest end among the
parts before and the nearest start among those after tell whether a complement is in scope, so its cost is that of the
sort and no pairs of parts are built. Only places travel, never text, and a text's parts are one group, whose size the
text bounds.

  ident     reported where a secret (assign, hex or weak) is in scope
  weak      reported where an identifier (access or ident) is in scope
  endpoint  reported where both an identifier and a secret are in scope

Defined cases: null text counts as empty, giving zero counts, the digest of '' and empty spans; texts are scanned
whole, in time linear in their length; overlapping spans of different kinds are all reported, and are in scope of each
other; repeated rows, and rows that repeat a doc_id, are scanned apart; an empty table gives an empty result; only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

SCOPE = 400
#: Fixed patterns. The value is the last group; (?i) folds ASCII letters only.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run is taken whole, so this finds what [0-9a-f]+ of 16 or more finds
IDENT = r"""(?i)(?:access_?key(?:_?id)?|client_?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"(?i)https?://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:host|endpoint)\x20*[:=]\x20*[A-Za-z0-9.-]{4,}"
VALUE = r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
KINDS = ("assign", "access", "hex", "ident", "weak", "endpoint")
BASE, IDENTIFIERS, SECRETS = KINDS[:3], ("access", "ident"), ("assign", "hex", "weak")


def matches(text: Column, pattern: str, source: int, kind: Column) -> Column:
    """array<struct<source, i, gap, size, kind>> of the leftmost non-overlapping matches: the code points between a
    match and the one before it, and its own. kind: from the matched text, as `hit`; null where it is to be dropped.

    split() gives the stretches between matches and regexp_extract_all() the matches; running sums of both place them.
    Rows without a match skip both.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)), F.lit(1), F.size(found))
    each = lambda x, i: F.struct(F.lit(source).alias("source"), i.alias("i"), x["gap"].alias("gap"), F.length(x["hit"]).alias("size"), kind(x["hit"]).alias("kind"))
    spans = F.transform(F.arrays_zip(between.alias("gap"), found.alias("hit")), each)
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<source:int,i:int,gap:int,size:int,kind:string>>)"))


def parts(text: Column) -> Column:
    """All parts of a text, dropped ones too, as places of later matches build on them."""
    value = lambda hit: F.length(F.regexp_extract(hit, VALUE, 1))
    sources = (
        (ASSIGN, lambda hit: F.when(value(hit) >= 12, "assign").when(value(hit) >= 4, "weak")),
        (ACCESS, lambda hit: F.when(F.length(hit) >= 18, "access").otherwise("ident")),
        (HEX, lambda hit: F.lit("hex")),
        (IDENT, lambda hit: F.lit("ident")),
        (ENDPOINT, lambda hit: F.lit("endpoint")),
    )
    return F.concat(*[matches(text, pattern, i, kind) for i, (pattern, kind) in enumerate(sources)])


def linked(spans: DataFrame, scope: int = SCOPE) -> Column:
    """Whether a part of spans (row_id, start, stop, kind) is to be reported."""
    here = Window.partitionBy("row_id")
    before = here.orderBy("start", "source").rowsBetween(Window.unboundedPreceding, -1)
    after = here.orderBy(F.desc("start"), F.desc("source")).rowsBetween(Window.unboundedPreceding, -1)

    def near(kinds: tuple) -> Column:
        end = F.max(F.when(F.col("kind").isin(*kinds), F.col("stop"))).over(before)
        start = F.min(F.when(F.col("kind").isin(*kinds), F.col("start"))).over(after)
        return F.coalesce(F.col("start") - end <= scope, F.lit(False)) | F.coalesce(start - F.col("stop") <= scope, F.lit(False))

    identifier, secret = near(IDENTIFIERS), near(SECRETS)
    return F.when(F.col("kind") == "ident", secret).when(F.col("kind") == "weak", identifier).when(F.col("kind") == "endpoint", identifier & secret).otherwise(F.col("kind").isNotNull())


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id and spans, array<struct<start, rank, kind, stop>> in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text.alias("_t"))
    rows = rows.select("row_id", "doc_id", F.explode_outer(parts(F.col("_t"))).alias("p")).select("row_id", "doc_id", "p.*")
    # one exchange, by row, serves all windows and the final grouping
    along = Window.partitionBy("row_id", "source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition("row_id").withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(along).cast("int")).withColumn("start", F.col("stop") - F.col("size"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.when(linked(placed, scope), F.struct("start", rank.alias("rank"), "kind", "stop"))
    return placed.select("row_id", "doc_id", span.alias("span")).groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("span")).alias("spans")).drop("row_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def secret_digests(docs: DataFrame) -> DataFrame:
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
