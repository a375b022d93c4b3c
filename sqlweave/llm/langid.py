"""Operator 5: language ID by sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal, per coordinate) with an elastic net, then temperature calibration
on rows that training did not see. Document frequencies are counted over all rows that may be learned from, in one
Spark aggregation of one array a task; weights are fitted on a bounded sample of them (`sample` rows, dealt out evenly
to the languages, so that a rare one is not lost). Features are TF-IDF shares of hashed character n-grams, so that a text's logits are
sums over its n-grams divided by the sum of their weights: one vectorised pass, linear in the text's length.

Defined cases: a text that is null or has no letter is `und` with score 0; very long texts are scored whole, in
blocks of BLOCK characters; repeated rows score alike; ties between languages go to the smaller name; with no labelled row every text is `und`; only
doc_id, text and (for training) lang are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fold, table

BLOCK = 1 << 16

@dataclass
class LanguageModel:
    """Weights of hashed n-grams, one column for each language; `scale` brings shares to the size that FTRL likes."""

    bits: int = 15
    longest: int = 3
    scale: float = 24.0
    temperature: float = 1.0
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    table: np.ndarray | None = field(default=None, repr=False)

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """Hashed n-grams of 1 to `longest` characters of the whole text, in lower case, white space as one kind, in
        blocks: an n-gram belongs to the block of its first character."""
        whole = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
        for i in range(0, len(whole), BLOCK):
            c = whole[i : i + BLOCK + self.longest - 1].copy()
            c[c < 33] = 32
            parts, h, own = [], c, min(BLOCK, len(whole) - i)
            for n in range(1, self.longest + 1):
                if n > 1:
                    h = h[: max(len(c) - n + 1, 0)] * np.uint32(31337) + c[n - 1 :]
                parts.append(((h[:own] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - self.bits))
            yield np.concatenate(parts).astype(np.intp)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text and their counts."""
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = sum((np.bincount(g, minlength=1 << self.bits) for g in self.grams(text)), np.zeros(1 << self.bits, np.int64))
        found = np.flatnonzero(total)
        return found, total[found]

    def logits(self, text: str) -> np.ndarray:
        """Sums over n-grams in one pass: their TF-IDF weights, and those times the weights of each language."""
        if self.table is None:
            self.table = np.concatenate([self.idf[:, None], self.idf[:, None] * self.weights], axis=1).astype(np.float32)
        total = np.zeros(1 + len(self.languages))
        for g in self.grams(text):
            total += self.table.take(g, axis=0).sum(0, dtype=np.float64)
        return self.scale * total[1:] / max(total[0], 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def inverse(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray | None = None, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> LanguageModel:
    """rows: language, distinct n-grams, counts; idf: of all texts, else that of rows. Every fifth row is set aside for
    the temperature."""
    m = LanguageModel(languages=sorted({r[0] for r in rows}))
    size, k = 1 << m.bits, len(m.languages)
    if idf is None:
        df = np.zeros(size)
        for _, g, _ in rows:
            df[g] += 1
        idf = inverse(len(rows), df)
    m.idf = idf
    z, n, w = np.zeros((size, k)), np.zeros((size, k)), np.zeros((size, k))
    code = {x: i for i, x in enumerate(m.languages)}

    def features(g: np.ndarray, c: np.ndarray) -> np.ndarray:
        x = c * m.idf[g]
        return m.scale * x / max(x.sum(), 1e-12)

    def settle(g: np.ndarray) -> np.ndarray:
        """The proximal solution of the touched coordinates: zero inside the L1 ball."""
        zz = z[g]
        out = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[g])) / alpha + l2)
        out[np.abs(zz) <= l1] = 0
        return out

    def softmax(t: np.ndarray) -> np.ndarray:
        e = np.exp(t - t.max())
        return e / e.sum()

    fit, held = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            lang, g, c = fit[i]
            if not len(g):
                continue
            x, wg = features(g, c), settle(g)
            err = softmax(x @ wg)
            err[code[lang]] -= 1
            grad = x[:, None] * err
            sigma = (np.sqrt(n[g] + grad * grad) - np.sqrt(n[g])) / alpha
            z[g] += grad - sigma * wg
            n[g] += grad * grad
    w = settle(np.arange(size))
    m.weights = w
    logits = [(features(g, c) @ w[g], code[lang]) for lang, g, c in held if len(g)]

    def loss(t: float) -> float:
        return sum(-math.log(max(softmax(v / t)[y], 1e-15)) for v, y in logits)

    lo, hi = math.log(0.05), math.log(20.0)  # golden section on the log of the temperature
    for _ in range(40 if logits else 0):
        a, b = hi - (hi - lo) * 0.618, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, hi)
    m.temperature = math.exp((lo + hi) / 2) if logits else 1.0
    return m


def frequencies(texts: DataFrame, bits: int = LanguageModel.bits) -> tuple[int, np.ndarray]:
    """Number of texts, and for each hashed n-gram the number of texts that have it. Each task gives one number a hash
    at most, whatever its texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, last, n = LanguageModel(bits=bits), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for t in batch.column("text"):
                n += 1
                for g in own.grams(t.as_py()):
                    last[g] = n
                total += last == n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *total[at]], pa.int64())], names=["gram", "n"])

    df = np.zeros((1 << bits) + 1, np.int64)
    for r in texts.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # 2**bits + 1 rows
        df[r["gram"]] = r["n"]  # the number of texts is at the end, as gram -1
    return int(df[-1]), df[:-1]


def fit_languages(docs: DataFrame, sample: int = 2500) -> LanguageModel:
    """Learn from text and lang of rows outside the held-out fold; `sample` bounds the rows whose n-grams reach the
    driver: those of the smallest hash of each language in turn."""
    labelled = docs.where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # rows whose hash is small enough to be among the first: about twice as many as can be, whatever a language's size
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample)  # a row a language, `sample` at most
    share = F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.select("doc_id", "lang", F.xxhash64(F.lit(5), "doc_id").alias("h")).join(F.broadcast(sizes), "lang").where(share * F.col("n") < 2 * sample + 100)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(share, "h", "doc_id"))
    chosen = chosen.withColumn("turn", turn).where(F.col("turn") <= sample).orderBy("turn", "h", "doc_id", "lang").limit(sample).select("doc_id", "lang", "h").distinct()
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most `sample` rows

    @F.pandas_udf("g binary, c binary")
    def counts(s: pd.Series) -> pd.DataFrame:
        own = LanguageModel()
        got = [own.counts(t) for t in s]
        return pd.DataFrame({"g": [a.astype("int32").tobytes() for a, _ in got], "c": [b.astype("int32").tobytes() for _, b in got]})

    rows = texts.select("doc_id", "h", "lang", counts("text").alias("f")).select("doc_id", "h", "lang", "f.g", "f.c").orderBy("h", "doc_id", "lang").limit(sample)
    read = lambda b: np.frombuffer(bytes(b), np.int32).astype(np.int64)
    return train([(r.lang, read(r.g), read(r.c)) for r in rows.collect()], inverse(*frequencies(labelled)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with a struct column _lang (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature))  # 2**bits rows, whatever the corpus
    key = uuid.uuid4().hex  # workers serve several queries, each with its own model

    @F.pandas_udf("lang_pred string, score double")
    def run(s: pd.Series) -> pd.DataFrame:
        m = _MODELS.get(key)
        if m is None:
            _MODELS.clear()
            languages, idf, weights, temperature = shared.value
            m = _MODELS[key] = LanguageModel(languages=languages, idf=idf, weights=weights, temperature=temperature)
        return pd.DataFrame([m.predict(t) for t in s], columns=["lang_pred", "score"])

    return docs.withColumn("_lang", run(F.col(text)))


_MODELS: dict[str, LanguageModel] = {}


def op5_language_id(spark: SparkSession, sf_dir: str, sample: int = 2500) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = predict(docs.select("doc_id", "text"), fit_languages(docs, sample))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "_lang.lang_pred", "_lang.score")
