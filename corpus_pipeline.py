"""A corpus from `documents`: language ID, exact dedup, near-duplicate removal, mixing, tokenising.

Each stage reads what its predecessor wrote as Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm import bpe, dedup, jaccard, langid, mixing
from sqlweave.llm.shared import stage, table, whole

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; `und` ones (null text, no letter) go, and all of them where no row has a
    language to learn from. Repeated rows share one fate; an empty table stays empty."""
    scored = langid.predict(docs.select(whole(docs), "text"), langid.fit_languages(docs))
    return scored.where(F.col("_lang.lang_pred") != "und").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without blanks the longest stays, then the one of the smallest doc_id, null last; null
    counts as empty; of wholly equal rows one stays."""
    return dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked at 0.8 the row of the smallest doc_id stays, null last; texts without words are
    classes of their own."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times; null sources are one source; texts without words are never
    taken."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row; null text has none; repeated rows have repeated results."""
    import public_tokenizers

    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokens)]

#: A trained classifier, MinHash and hashed draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
