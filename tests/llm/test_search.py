"""Suffix dedup, top-k search, language-model scores and toxicity against brute force, with odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import class_lm, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string"


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.defaultdict(list)
    for i, b in enumerate(data):
        for j in range(len(b) - 199):
            seen[b[j : j + 200]].append((i, j))
    cover = [np.zeros(len(b) + 1, int) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                cover[i][j] += 1
                cover[i][j + 200] -= 1
    found = []
    for b, c in zip(data, cover, strict=True):
        gone = np.cumsum(c[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        found.append((len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return found


@pytest.mark.parametrize("hot", [30_000, 4])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RANGE", 50)
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    p, q, r = letters(300), letters(200), letters(199)
    texts = [letters(500) + p + letters(90), p + letters(20), q, letters(3) + q + letters(4), r + letters(1), letters(2) + r, "a" * 5000, "b" + "a" * 200 + "c", "xy" * 3000, letters(50) + "xy" * 110]
    texts += ["abcdefghij" * 60, None, "", "q" * 199, "q" * 200, "z" * 201, ("k" + "j" * 39) * 80, letters(60) + ("k" + "j" * 39) * 7, letters(7) + "é" * 400, "é" * 101, p[:250] + letters(5) + p[50:], p + letters(20)]
    texts += [letters(int(rng.integers(0, 300))) + p[int(rng.integers(0, 60)) :] + letters(100) for _ in range(20)] + [texts[0]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("spans", F.lit(1)).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_suffix_dedup_rows_without_id(spark):
    text = "".join(map(chr, np.random.default_rng(6).integers(97, 123, 400)))
    rows = [(None, text), (None, text), (None, "short"), (7, "x" + text[:250])]
    got = sorted(tuple(r)[1:] for r in suffix_dedup.digests(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted(brute_repeats([t for _, t in rows]))
    assert suffix_dedup.digests(spark.createDataFrame([], DOCS)).count() == 0


def test_long_rows_are_taken_in_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 700)
    pieces = suffix_dedup.anchors(data, np.array([0, len(data)]))
    assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def test_multikey_order():
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 2, (300, 21)).astype(np.uint8)
    order, common = suffix_dedup.multikey_order(rows)
    text = [r.tobytes() for r in rows]
    assert [text[i] for i in order] == sorted(text)
    for k in range(1, 300):
        a, b = text[order[k - 1]], text[order[k]]
        assert common[k] == next((i for i in range(21) if a[i] != b[i]), 21)


def brute_top(rows, k):
    vectors = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, v in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in vectors if i != q)[:k]
            found += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(found)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(8)] + [(320, None), (340, [1.0, None]), (360, [float("nan")] * 24), (380, [float("inf")] * 24), (400, []), (401, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()))
    assert got == brute_top(rows, 5)
    few = df.where("vec_id < 4 OR vec_id = 20")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 20 == 0, 20).collect())) == brute_top([r for r in rows if r[0] is not None and (r[0] < 4 or r[0] == 20)], 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_split_follows_the_score_to_beat():
    """The higher the score to beat, the fewer dimensions are essential; strips beyond all bounds are not looked at."""
    assert [topk.split(np.array([5.0, 3, 2, 1]), room) for room in (0, 0.5, 1.5, 3.5, 6.5, 20)] == [4, 4, 3, 2, 1, 0]
    rng = np.random.default_rng(5)
    vectors, ids = np.floor(rng.normal(size=(5000, 32)) * 64), np.arange(5000)
    vectors[3000:] = np.floor(vectors[3000:] / 64)
    touched = []
    got = topk.max_score(vectors[:5], ids[:5], vectors, ids, 20, touched=touched)
    for i, (rows, scores) in enumerate(got):
        want = vectors @ vectors[i]
        want[i] = -np.inf
        best = np.lexsort((ids, -want))[:20]
        assert rows.tolist() == best.tolist() and scores.tolist() == want[best].tolist()
    strips = np.array(touched).reshape(5, 5, 3)
    assert (strips[:, 0, 0] == 32).all() and (strips[:, 1:, 0] < 32).all() and (strips[:, -1, 2] == 0).all()


def test_top_k_of_large_components(spark):
    rows = [(i, [1e9 * (i % 7 - 3), 3e8 * (i % 5), -2e9]) for i in range(45)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute_top(rows, 4)]
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, 4).collect())) == sorted(want)


def test_class_model(spark):
    """Two kinds of sentences with words of their own: classes tell which word can follow."""
    rng = random.Random(3)
    kinds = [([f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]), ([f"x{i}" for i in range(40)], [f"y{i}" for i in range(40)])]
    texts = [" ".join(rng.choice(kinds[i % 2][k % 2]) for k in range(rng.randint(5, 60))) for i in range(300)] + [None, "", "never seen words", "N1 V1\tN2"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("score", F.lit(0.0))
    got = {r.doc_id: r for r in class_lm.score_all(docs, ~class_lm.held_out(F.col("doc_id"))).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    counts = collections.Counter(w for i, t in enumerate(tokens) if not out[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(w in counts for w in t), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
    held = [i for i in range(300) if out[i]]
    assert sum(got[i].score for i in held) / sum(got[i].base_score for i in held) < 0.93


def test_class_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{(i * k) % 9}" for k in range(12)) + f" once{i % 20}") for i in range(30)], DOCS)
    counts = class_lm.word_counts(docs)
    model, words = class_lm.learn(docs, counts, core=3, known=5, n_classes=3)
    all_words = [(int(n), int(c)) for n, c in zip(model.counts, model.classes, strict=True)] + [(r.n, r.c) for r in words.collect()]
    assert len(all_words) == 29 and sorted(n for n, _ in all_words)[:11] == [1] * 10 + [2]
    assert all((c == model.rest) == (n < class_lm.SEEN) for n, c in all_words)
    n, c = (np.array([*x, last]) for x, last in zip(zip(*all_words, (0, model.rest), strict=True), (model.ends, model.rest + 1), strict=True))
    for before in range(len(model.mass)):
        assert model.probability(np.full(len(n), before), c, n).sum() == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("known", [0, 12, 10_000])
def test_class_model_scores_of_words_that_are_joined(spark, known):
    """Scores are those of the formula, wherever counts and classes of words come from."""
    rng = random.Random(5)
    texts = [" ".join(f"{'ab'[k % 2]}{int(rng.paretovariate(0.7)) % 500}" for k in range(rng.randint(0, 40))) for _ in range(150)]
    texts += [None, "", "unseen " * 5 + "a1 unseen b1", "a1 b1 " * 30_000, "unseen " * 20_000]
    docs = spark.createDataFrame([(1 if i > 145 else i, t) for i, t in enumerate(texts)], DOCS).repartition(3)
    training = F.col("text").isNull() | ~F.col("text").contains("unseen")
    counts = class_lm.word_counts(docs.where(training))
    model, words = class_lm.learn(docs.where(training), counts, core=10, known=10_000, n_classes=4)
    assert words.count() == 0
    hashes = lambda t: class_lm._words(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()
    at = {int(h): (int(c), int(n)) for h, c, n in zip(model.known, model.classes, model.counts, strict=True)}
    end = (model.rest + 1, model.ends)
    bigrams = collections.Counter()
    want = []
    with np.errstate(over="ignore"):
        for t in texts:
            own = [*(at.get(h, (model.rest, 0)) for h in hashes(t)), end]
            for a, b in zip([end, *own], own):
                if "unseen" not in (t or ""):
                    bigrams[a[0], b[0]] += 1
            p = [math.log10(float(model.probability(np.array([a[0]]), np.array([b[0]]), np.array([b[1]]))[0])) for a, b in zip([end, *own], own)] if len(own) < 1000 else None
            want.append((len(own), p and sum(p)))
    k = model.rest + 2
    pairs = np.array([[bigrams[a, b] for b in range(k)] for a in range(k)], float)
    prior = (pairs.sum(axis=0) + 1) / (pairs.sum() + k)
    assert np.allclose(model.transition, (pairs + class_lm.PRIOR * prior) / (pairs.sum(axis=1, keepdims=True) + class_lm.PRIOR))
    got = collections.Counter((r.n_tokens, round(r.score, 6)) for r in class_lm.score_all(docs, training, core=10, known=known, n_classes=4).collect())
    assert sum(got.values()) == len(texts)
    short = collections.Counter((n, round(p, 6)) for n, p in want if p is not None)
    assert all(any(n == a and abs(p - b) < 1e-5 for a, b in got) for n, p in short)
    assert {n for n, p in want if p is None} == {n for n, _ in got if n >= 1000}


def test_class_model_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    got = {r.doc_id: tuple(r)[1:] for r in class_lm.score_all(docs, F.lit(False)).collect()}
    assert got == {1: (3, 0, 0, 0.0, 0.0), 2: (1, 0, 0, 0.0, 0.0)}
    assert class_lm.score_all(docs.limit(0), F.lit(True)).count() == 0


def brute_segments(s):
    found = []

    def rec(a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if best is None or t > best[2] + 1e-12:
                    best = (i, j + 1, t)
        if best and best[2] > 0:
            found.append(best)
            rec(a, best[0])
            rec(best[1], b)

    rec(0, len(s))
    return sorted(found)


def test_maximal_segments():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-3, -2.5, -1.25, -0.5, 1, 2.1, 3.0, 0.7]) + rng.random() / 7 for _ in range(rng.randint(0, 24))]
        assert [(a, b) for a, b, _ in sorted(toxicity.maximal_segments(s))] == [(a, b) for a, b, _ in brute_segments(s)]


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng = random.Random(5)
    words, bad = [f"w{i}" for i in range(300)], ["vile", "scum", "rotten", "awful"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(rng.randint(10, 80))]
        toxic = i % 9 == 0
        if toxic:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(bad).title() + "," for _ in range(rng.randint(2, 4))]
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if i % 3 else 0, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "..."), (2002, "...")]
    labels += [(3, None, None), (None, 1, 1), (9000, 0, 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(9)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, toxic_corpus):
    docs, labels = toxic_corpus
    model = toxicity.learn(docs, labels)
    found = toxicity.passages(docs, model).collect()
    assert len(found) == 1504
    held = [r for r in found if r.doc_id < 1500 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) != (r.doc_id % 9 == 0) for r in held) <= 0.02 * len(held)
    texts = {r.doc_id: r.text for r in docs.collect()}
    hits = [(r, p) for r in held if r.doc_id % 9 == 0 for p in r.passages]
    assert hits
    for r, p in hits:
        assert any(x in texts[r.doc_id].encode()[p.start : p.end].decode().lower() for x in ("vile", "scum", "rotten", "awful"))
    assert all(0 <= r.score < 0.5 and not r.passages for r in found if r.doc_id >= 2000)


def test_toxicity_without_labels_of_both_kinds(spark, toxic_corpus):
    docs, labels = toxic_corpus
    assert all(r.score < 1e-9 for r in toxicity.passages(docs, toxicity.learn(docs, labels.limit(0))).collect())
    one = toxicity.learn(docs, labels.where("toxic = 1"))
    assert all(0 <= r.score <= 1 for r in toxicity.passages(docs, one).collect())
    assert toxicity.passages(docs.limit(0), one).count() == 0


def test_toxicity_ranks_evidence_upwards_whatever_lies_far_out():
    """A few clean rows with very much evidence, as long junk has, on which full Newton steps swing and end with a negative weight."""
    rng = np.random.default_rng(3)
    best = np.concatenate([np.where(rng.random(700) < 0.5, 0, rng.exponential(1.5, 700)), [180.0, 90.0], rng.gamma(4, 4, 90)])
    x = np.column_stack([best, np.log1p(best * rng.uniform(1, 1.5, len(best)))])
    y = (np.arange(len(best)) >= 702).astype(float)
    w = np.array(toxicity._logistic(x, y))
    assert (w[1:] >= 0).all() and w[1:].any()
    scores = w[0] + x @ w[1:]
    assert (scores[y == 1][:, None] > scores[y == 0]).mean() > 0.9
    # at the best weights no part of a positive one is left to climb
    slope = np.column_stack([np.ones(len(x)), x]).T @ (y - 1 / (1 + np.exp(-scores))) - np.array([1e-6, 0.1, 0.1]) * w
    assert (np.abs(slope[w != 0]) < 1e-3).all() and (slope[w == 0] < 1e-3).all()


def test_class_counts_reach_the_driver_as_one_packed_row_a_word(spark, monkeypatch):
    """Nothing that grows with the vocabulary or its cells becomes Python rows on the driver."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 50)))) for i in range(60)], DOCS).repartition(4)
    names = [f"w{i}" for i in range(20)]
    hashes = np.array([class_lm._words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in names])
    classes = np.array([*(i % 3 for i in range(20)), 3, 4])
    want = np.zeros((2, 22, 5))
    for r in docs.collect():
        ids = [21, *(min(int(w[1:]), 20) for w in r.text.split()), 21]
        for a, b in zip(ids, ids[1:]):
            want[0, a, classes[b]] += 1
            want[1, b, classes[a]] += 1
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows of Python objects"))
    seqs = class_lm.sequences(docs.select("text"), hashes)
    assert (class_lm._cells(seqs, classes, 5) == want).all()
    assert class_lm.word_cells(seqs, classes, 5).count() == int(want.sum(axis=2).any(axis=0).sum())
    model, words = class_lm.learn(docs, class_lm.word_counts(docs), core=10, known=10_000, n_classes=3)
    assert len(model.known) == 31 and words.count() == 0
