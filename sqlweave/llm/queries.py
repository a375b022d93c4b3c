"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, dedup, jaccard, langid, mixing, neighbours, quality, secrets, shards, urls

QUERIES = {
    "op1_ngram_jaccard": jaccard.op1_ngram_jaccard,
    "op2_bpe": bpe.op2_bpe,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secrets.op4_secrets,
    "op5_language_id": langid.op5_language_id,
    "op6_exact_dedup": dedup.op6_exact_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": urls.op8_url_filter,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_sharding": shards.op10_sharding,
}
ORACLE_SQL = {"op6_exact_dedup": dedup.OP6_SQL}
