"""The pipeline's stages, each against brute force on its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from sqlweave.llm import jaccard
from sqlweave.llm.shared import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf001):
    import public_tokenizers
    from tokenizers import Tokenizer

    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["language", "exact_dedup", "near_dedup", "mixing", "bpe"]
    base = " ".join(f"{w}" for w in table(spark, sf001, "documents").where("lang = 'en'").orderBy("n_chars", ascending=False).first().text.split()[:80])
    extra = [(9001, base, "en", "src1", 1), (9002, base + "  ", "en", "src1", 1), (9003, base + " more", "en", "src2", 1), (9004, None, "en", "src2", 0), (9005, "12 34 !!", "en", None, 8)]
    docs = table(spark, sf001, "documents").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    before = docs.collect()

    docs = stage(steps["language"](spark, docs, sf001), "t")
    rows = docs.collect()
    assert docs.columns == COLUMNS and not {9004, 9005} & {r.doc_id for r in rows}
    letters = {r.doc_id for r in before if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in rows} == letters  # only what the operator itself rejects goes

    docs = stage(steps["exact_dedup"](spark, docs, sf001), "t")
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append(r)
    want = {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    rows = docs.collect()
    assert docs.columns == COLUMNS and sorted(r.doc_id for r in rows) == sorted(want) and 9002 in want and 9001 not in want

    docs = stage(steps["near_dedup"](spark, docs, sf001), "t")
    sets = {r.doc_id: jaccard.shingles(r.text) for r in rows}
    label = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    rows = docs.collect()
    assert docs.columns == COLUMNS and sorted(r.doc_id for r in rows) == sorted(set(label.values()))
    assert len({9002, 9003} & {r.doc_id for r in rows}) <= 1

    docs = stage(steps["mixing"](spark, docs, sf001), "t")
    took = Counter(r.doc_id for r in docs.collect())
    assert docs.columns == COLUMNS and max(took.values()) <= 3 and set(took) <= {r.doc_id for r in rows}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words = sum(size(r.text) for r in rows)
    assert abs(sum(size(r.text) * took[r.doc_id] for r in rows) - words) <= 0.1 * words

    text = {r.doc_id: r.text for r in rows}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = steps["bpe"](spark, docs, sf001).collect()
    assert Counter(r.doc_id for r in out) == took
    for r in out[:60]:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


ODD = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 10)] * 2 + [(2, None, None, None, None), (3, "", "en", "b", 0), (None, "alpha  beta gamma\tdelta epsilon zeta", "fr", None, 3), (4, "x" * 100_000, "de", "a", 9), (5, "12 34", "es", None, 4), (6, "né çé", "fr", "c", 8), (6, "né çé ñ", "fr", "c", 8)]


def test_stages_on_odd_tables(spark, sf001):
    """Nulls, empty and long texts, ties, repeated rows and ids, and columns with names that operators use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, label long, _n int, nid long"
    odd = spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in ODD], schema)
    want = {"language": 6, "exact_dedup": 6, "near_dedup": None, "mixing": None, "bpe": 9}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, odd, sf001)
        assert name == "bpe" or out.columns == odd.columns
        assert out.count() == (want[name] if want[name] is not None else out.count()), name
        assert step(spark, odd.limit(0), sf001).count() == 0
