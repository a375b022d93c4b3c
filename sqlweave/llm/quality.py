"""Operator 3: quality classifier, a factorisation machine.

Inputs of a score are hashed words, statistics of the text's structure (binned, one-hot) and the recorded n_chars
(metadata), never labels, lang, source or doc_id. Pairwise interactions have rank k and are scored in linear time:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 * (|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2).

Defined cases: null text counts as empty and is scored by its structure bins; texts are scored whole; null n_chars has
a bin of its own; repeated rows score alike; without labelled rows every score is 0.5; an empty table gives an empty
result; columns other than doc_id, text and n_chars are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fold, table

WORD_BUCKETS, BINS = 1 << 15, 12
#: Statistics of structure, each with BINS bins after the word buckets, then one bin block for n_chars.
STATS = ("chars", "words", "lines", "upper", "digit", "mark", "odd_mark", "distinct", "top_share", "word_len", "repeat_lines", "adjacent", "n_chars")
SIZE = WORD_BUCKETS + BINS * len(STATS)


def _log_bin(x: float) -> int:
    return min(BINS - 1, int(math.log2(1 + max(x, 0))))


def _share_bin(x: float) -> int:
    """Finer bins near 0."""
    return min(BINS - 1, int(math.sqrt(min(max(x, 0.0), 1.0)) * BINS))


class Features:
    def __init__(self) -> None:
        self.cache: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        b = self.cache.get(word)
        if b is None:
            b = zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS
            if len(word) <= 64:
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[word] = b
        return b

    def of(self, text: str | None, n_chars) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = text.lower().split()
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x.strip()]
        n, w = max(len(text), 1), max(len(words), 1)
        raw = text.encode("utf-8", "replace")
        table_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper, digit = table_[65:91].sum(), table_[48:58].sum()
        plain = table_[[33, 39, 44, 46, 63, 58, 59, 45]].sum()
        marks = table_[33:48].sum() + table_[58:65].sum() + table_[91:97].sum() + table_[123:127].sum()
        same = sum(a == b for a, b in zip(words, words[1:]))
        bins = (
            _log_bin(len(text)), _log_bin(len(words)), _log_bin(len(lines)), _share_bin(upper / n), _share_bin(digit / n), _share_bin(marks / n),
            _share_bin((marks - plain) / n), _share_bin(len(counts) / w), _share_bin(max(counts.values(), default=0) / w), min(BINS - 1, int(n / w)),
            _share_bin(1 - len(set(lines)) / max(len(lines), 1)), _share_bin(same / w), BINS - 1 if n_chars is None or n_chars != n_chars else min(BINS - 2, int(math.log2(1 + max(n_chars, 0)) / 2)),
        )
        at: dict[int, float] = {}
        for word, c in counts.items():
            b = self.bucket(word)
            at[b] = at.get(b, 0.0) + c
        idx = np.fromiter(at, np.int64, len(at))
        val = np.log1p(np.fromiter(at.values(), float, len(at)))
        val /= max(math.sqrt(float(val @ val)), 1e-12)
        own = np.array([WORD_BUCKETS + i * BINS + b for i, b in enumerate(bins)], np.int64)
        return np.concatenate([idx, own]), np.concatenate([val, np.full(len(own), 0.5)])


class FactorMachine:
    """w0, w (SIZE) and V (SIZE x rank), trained with AdaGrad on the log loss with L2."""

    def __init__(self, rank: int = 6, seed: int = 3):
        self.w0, self.w = 0.0, np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SIZE, rank))

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        total = vx.sum(0)
        t = self.w0 + self.w[idx] @ val + 0.5 * float(total @ total - (vx * vx).sum())
        return 1 / (1 + math.exp(-min(max(t, -30.0), 30.0)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, batch: int = 32, rate: float = 0.1, l2: float = 1e-4) -> FactorMachine:
        order = np.random.default_rng(11)
        g0, gw, gv = 1e-8, np.full(SIZE, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs if rows else 0):
            pick = order.permutation(len(rows))
            for at in range(0, len(rows), batch):
                part = [rows[i] for i in pick[at : at + batch]]
                sizes = [len(r[0]) for r in part]
                idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                own, starts = np.repeat(np.arange(len(part)), sizes), np.cumsum([0, *sizes[:-1]])
                y = np.array([r[2] for r in part], float)
                vx = self.v[idx] * val[:, None]
                total = np.add.reduceat(vx, starts)
                t = self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                err = (1 / (1 + np.exp(-np.clip(t, -30, 30))) - y) / len(part)
                e = err[own]
                keys, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, e * val, len(keys)) + l2 * self.w[keys]
                dv = np.zeros((len(keys), self.v.shape[1]))
                np.add.at(dv, back, (e * val)[:, None] * (total[own] - vx))
                dv += l2 * self.v[keys]
                g0 += err.sum() ** 2
                gw[keys] += dw * dw
                gv[keys] += dv * dv
                self.w0 -= rate * err.sum() / math.sqrt(g0)
                self.w[keys] -= rate * dw / np.sqrt(gw[keys])
                self.v[keys] -= rate * 0.5 * dv / np.sqrt(gv[keys])
        return self


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> FactorMachine:
    """Learn from at most `sample` labelled rows outside the held-out fold, chosen by a hash of their id."""
    known = labels.where((fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("y")).withColumn("h", F.xxhash64(F.lit(3), "doc_id")).orderBy("h", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id")  # at most `sample` rows

    @F.pandas_udf("i array<int>, x array<float>")
    def run(text: pd.Series, n: pd.Series) -> pd.DataFrame:
        f = Features()
        got = [f.of(a, b) for a, b in zip(text, n)]
        return pd.DataFrame({"i": [a.astype("int32") for a, _ in got], "x": [b.astype("float32") for _, b in got]})

    rows = texts.select("y", "h", "doc_id", run("text", "n_chars").alias("f")).orderBy("h", "doc_id").limit(sample).collect()
    return FactorMachine().fit([(np.array(r.f.i, np.int64), np.array(r.f.x, float), r.y) for r in rows])


_MODELS: dict[str, tuple[FactorMachine, Features]] = {}


def score(docs: DataFrame, model: FactorMachine):
    """docs with a column score; the model's size is fixed (SIZE x (rank + 1)), so it may be broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.w0, model.w.astype("float32"), model.v.astype("float32")))
    key = uuid.uuid4().hex  # workers serve several queries, each with its own model

    @F.pandas_udf("double")
    def run(text: pd.Series, n: pd.Series) -> pd.Series:
        if key not in _MODELS:
            _MODELS.clear()
            m = FactorMachine.__new__(FactorMachine)
            m.w0, m.w, m.v = shared.value
            _MODELS[key] = (m, Features())
        m, f = _MODELS[key]
        return pd.Series([m.score(*f.of(a, b)) for a, b in zip(text, n)], dtype=float)

    return docs.withColumn("score", run("text", "n_chars"))


def op3_quality(spark: SparkSession, sf_dir: str, sample: int = 6000) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), sample)
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
