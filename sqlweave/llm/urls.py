"""Operator 8 [native]: URL filters.

Host rules come first, the longest fitting one wins; all other urls are judged by a logistic regression on hashed
character n-grams of host and path, trained on the driver from the small labelled table below and scored by SQL
functions only: crc32 of each n-gram picks a weight from a literal array.

Characters are split once, so the work is linear in a url's length.

Defined cases: a null url or one without `://` has an empty host and path, no rule, and the model's verdict on empty
features; urls are read whole; an empty table gives an empty result; repeated rows give equal results; columns other than page_id and url are not read.
"""

from __future__ import annotations

import math
import zlib
from itertools import cycle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Fixed rules: verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The labelled urls: names to block and ordinary names to allow, met with ordinary paths.
BLOCKED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "xxx-cams", "win-cash-now", "pills-online", "best-casino", "bet-bonus", "hot-adult-video", "spam-links", "cheap-replica", "poker-win", "free-porn", "viagra-shop", "lottery-winner", "adult-dating", "link-farm", "slots-casino")
ALLOWED = ("news", "docs", "library", "research", "garden", "weather", "shop", "school", "cooking", "forum", "travel", "museum", "history", "science", "music", "archive", "university", "maps", "theatre", "recipes")
PATHS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/")
DIMENSIONS, GRAM = 2048, 3


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): every host above under three domains, with varied paths."""
    rows, path = [], cycle(PATHS)
    for blocked, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            for domain in ("example.com", "example.net", "example.org"):
                rows.append((f"{'www.' * (i % 3 == 0)}{name}.{domain}", next(path).format(n=37 * i + 5), blocked))
    return rows


def _grams(part: str, mark: str) -> list[int]:
    w = f"{mark}{part}$"
    return [zlib.crc32(w[i : i + GRAM].encode()) % DIMENSIONS for i in range(len(w) - GRAM + 1)]


def train(rows: list[tuple[str, str, int]], epochs: int = 60, rate: float = 1.0, l2: float = 1e-4) -> tuple[float, list[float]]:
    """Bias and weights; x is the share of each n-gram, scaled by 10."""
    bias, w = 0.0, [0.0] * DIMENSIONS
    data = []
    for host, path, y in rows:
        g = _grams(host, "^") + _grams(path, "|")
        data.append((g, 10 / max(len(g), 1), y))
    for _ in range(epochs):
        for g, x, y in data:
            t = bias + x * sum(w[i] for i in g)
            err = 1 / (1 + math.exp(-max(min(t, 30), -30))) - y
            bias -= 0.1 * rate * err
            for i in g:
                w[i] -= rate * (err * x + l2 * w[i])
    return bias, w


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def probability(host: Column, path: Column, model: tuple[float, list[float]]) -> Column:
    """Probability that a url is to be blocked."""
    bias, w = model
    weights = F.lit([float(x) for x in w])

    def grams(part: Column, mark: str) -> Column:
        letters = F.split(F.concat(F.lit(mark), part, F.lit("$")), "")
        shifted = [F.slice(letters, i + 1, F.greatest(F.size(letters) - GRAM + 1, F.lit(0))).alias(f"c{i}") for i in range(GRAM)]
        code = lambda x: F.pmod(F.crc32(F.concat(*[x[f"c{i}"] for i in range(GRAM)]).cast("binary")), F.lit(DIMENSIONS)).cast("int")
        return F.transform(F.arrays_zip(*shifted), code)

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    add = lambda a, i: F.struct((a["sum"] + F.element_at(weights, i + 1)).alias("sum"), (a["n"] + 1).alias("n"))
    score = lambda a: 1 / (1 + F.exp(-(F.lit(bias) + 10 * a["sum"] / F.greatest(a["n"], F.lit(1)))))
    return F.aggregate(F.concat(grams(host, "^"), grams(path, "|")), start, add, score)


def judge(pages: DataFrame, rules=RULES, model: tuple[float, list[float]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block."""
    model = model or train(labelled_urls())
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(longest):
        rule, verdict = F.when(fits(h, p), F.lit(h + p)).otherwise(rule), F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    out = parts.withColumn("rule", rule).withColumn("_v", verdict).withColumn("p_block", probability(F.col("host"), F.col("path"), model))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
