"""The pipeline: every stage acts, columns stay, and what survives is what the operators say."""

import hashlib
import random

import corpus_pipeline
from tests.llm.test_text import SCHEMA, brute_components, edited, prose

QUERIES = [f"op{n}_" for n in range(1, 11)]


def test_stages(spark):
    rng = random.Random(1)
    clean = [prose(rng, rng.randint(60, 160)) for _ in range(60)]
    texts = clean + [edited(rng, clean[0], 1), "#### " * 200, None, "", "too short"]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = docs.columns
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, None)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = docs.collect()
    assert {r.doc_id for r in out["quality rules"]} == set(range(61))
    assert [r for r in out["line dedup"] if r.doc_id == 60][0].text != texts[60]
    assert all(r.n_chars == len(r.text) for r in out["line dedup"] if r.text != texts[r.doc_id])
    mixed = {r.doc_id: r.text for r in out["mixing sources"]}
    for r in out["byte-level BPE"]:
        assert r.n_tokens == len(r.token_ids) > 0
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].encode()).hexdigest()


def test_near_duplicates_from_four_fifths(spark):
    """The near-duplicate stage against brute force, with pairs from 0.8 to below 0.85."""
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        words = prose(rng, 104).split()
        # 100 shingles; so many of them change at the end
        texts += [" ".join(words), *(" ".join(words[:-n] + [f"x{i}" for i in range(n)]) for n in (rng.randint(9, 11), 12))]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = brute_components([shingles(t) for t in texts], 80)
    assert len(set(want)) < len(set(brute_components([shingles(t) for t in texts], 85)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, None).collect()} == set(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else stage(spark, docs, None)
    assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(q) for n in names) == 1 for q in QUERIES) and "pipeline" in names
