"""Tokenizers, mixing, quality, line dedup and near-duplicates against brute force, with odd inputs."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tidemark.llm import bpe, line_dedup, minhash, mixing, quality, token_count
from tidemark.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]
ODD = [None, "", " \n\t ", "one", "a" * 3000, "é" * 700 + "x", "<|endoftext|> and 'll it's  \n\n  9,999", "\x00\x0b\x0c\x1c", "日本語テキスト " * 50]


def prose(rng, n, line=12):
    words = [rng.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def docs_of(spark, texts, sources=("a", "b", None)):
    rows = [(i, t, "en" if i % 3 else None, sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, tiktoken_encoding):
    rng = random.Random(1)
    texts = ODD + [prose(rng, 80) for _ in range(10)] + ["same"] * 3
    got = {r.doc_id: r for r in bpe.digests(docs_of(spark, texts), RANKS, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_columns_and_round_trip(spark, tiktoken_encoding):
    docs = docs_of(spark, ODD).withColumn("token_ids", F.lit(3))
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(encoded.columns) == sorted([*SCHEMA.replace(",", "").split()[::2], "token_ids"])
    for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect():
        assert list(r.token_ids) == tiktoken_encoding.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_words_are_merged_by_a_heap(tiktoken_encoding):
    model = bpe.model(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    for w in ("a" * 5000, "".join(rng.choice("abcdeß") for _ in range(3000)), "=" * 999):
        assert model.encode(w).tolist() == tiktoken_encoding.encode_ordinary(w)


def test_bpe_decodes_each_distinct_word_once(monkeypatch, tiktoken_encoding):
    model = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    rows = []
    run = model._decoded
    monkeypatch.setattr(model, "_decoded", lambda docs, ids: rows.append(len(ids)) or run(docs, ids))
    text = "naïve 日本語テキスト it's qzxjv qzxjv\x00 " * 40 + "a" * 600
    for more in ("", " another wörd", ""):
        words = model.split.findall(text + more)
        n = model.numbers(words)
        assert model.ids(n).tolist() == tiktoken_encoding.encode_ordinary(text + more)
        assert "".join(model.decoded()[k] for k in n).encode("latin-1") == (text + more).encode()
    once = [len(tiktoken_encoding.encode_ordinary(w)) for w in dict.fromkeys(model.split.findall(text))]
    assert rows[0] == sum(once) and len(rows) == 2 and rows[1] < 10


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 1), (100, 16), (512, 64)])
def test_token_counts_equal_whole_encodings(chunk, overlap):
    counter = token_count.Counter(JSON, chunk, overlap)
    rng = random.Random(chunk)
    texts = ["a" * 900, (" " * 70 + "x") * 9, "<|endoftext|>" * 40, ("ab <|endoftext|>  " * 30) + "zz" * 200, "don't " * 90 + "!!<|endoftext|>" * 20, "\n \n  " * 90, "日本語 " * 99, prose(rng, 500)]
    texts += ["".join(rng.choice(["a", " ", "\n", "'s", "<|endoftext|>", "é", "1"]) for _ in range(400)) for _ in range(20)]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.widened > 0 or chunk > 500


def test_token_count_rows(spark):
    got = {r.doc_id: r for r in token_count.count_tokens(docs_of(spark, ODD), JSON, limit=100).collect()}
    counter = token_count.Counter(JSON)
    for i, t in enumerate(ODD):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((t or "").encode()), len(counter.tokenizer.encode(t or "", add_special_tokens=False)))
        assert got[i].over_limit == (got[i].n_tokens > 100)
    pieces = token_count.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    assert pieces.counts(["", "hello world"])[0] == 0 and pieces.counts(["hello world"])[0] > 0


def water_fill(sizes, weights, most=3):
    total, found, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        left, w = total - sum(found.values()), sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / w > most * sizes[k]]
        if not over:
            return found | {k: left * weights[k] / w for k in open_}
        for k in over:
            found[k] = float(most * sizes[k])
            open_.discard(k)
    return found


def test_mixing(spark):
    rng = random.Random(4)
    sources = ["s0"] * 6 + ["s1", "s2", "s3", None, "s4"]
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(3000)] + [None, "", "same words"] * 3
    rows = [(i if i < 3005 else 3005, t, "en", sources[i % len(sources)], 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.sizes_and_copies(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.sizes_and_copies(docs.repartition(7)).collect()), key=str)
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    order = [*sorted(k for k in sizes if k is not None), None]
    want = water_fill(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)})
    taken, target = collections.Counter(), {}
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[by_size[r.source_size]] += r.taken
        target[by_size[r.source_size]] = r.target
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 60
    assert mixing.sizes_and_copies(docs.limit(0)).count() == 0
    mixture = mixing.mixture(docs)
    assert mixture.columns == docs.columns and mixture.count() == sum(r.taken // r.size for r in got if r.size)


def test_pivotal_keeps_words_and_rounds():
    rng = np.random.default_rng(6)
    for last in (False, True):
        f, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
        out, left = mixing.pivotal(f, size, rng.integers(-(2**62), 2**62, 500), last)
        assert ((out == 0) | (out == 1)).sum() >= 499 and (left < 0 or not last)
        assert abs((out * size).sum() - (f * size).sum()) <= (1e-6 if left >= 0 else 900)
    means = np.mean([mixing.pivotal(np.array([0.3, 0.5, 0.9]), np.array([2.0, 7.0, 4.0]), np.array([i, i + 9, i * 7]), False)[0] for i in range(4000)], axis=0)
    assert np.abs(means - [0.3, 0.5, 0.9]).max() < 0.03


def statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = collections.defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})


def test_quality_statistics_and_outliers(spark):
    rng = random.Random(8)
    clean = [prose(rng, rng.randint(60, 200)) for _ in range(150)]
    junk = ["#### $$$$ ||||| " * 40, " ".join("x" * 30 + str(i) for i in range(90)), "\n".join([" ".join(WORDS[:11])] * 20)]
    texts = ODD + clean + junk + ["x y " * 30 + "z"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == statistics(t)
        assert got[i].base_failed == (got[i].n_words < 50 or 100 * got[i].n_repeat_words > 50 * got[i].n_words)
    first = len(ODD)
    assert all(got[i].kept for i in range(first, first + len(clean)))
    assert not any(got[i].kept for i in range(first + len(clean), len(texts)))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_concentration_is_not_moved_by_outliers(spark):
    """A third of a group far away does not hide: estimates come from the closest share alone."""
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(140)] + [re.sub(r"\bw", "#" * 3 + "w", prose(rng, 120)) for _ in range(30)]
    got = {r.doc_id: r.kept for r in quality.verdicts(docs_of(spark, texts, sources=("one",)).withColumn("lang", F.lit("en"))).collect()}
    assert all(got[i] for i in range(140)) and not any(got[i] for i in range(140, 170))


def brute_components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_near_duplicates(spark):
    rng = random.Random(10)
    base = [prose(rng, n) for n in (8, 40, 150, 150, 300)]
    texts = [*ODD, *base]
    for b in base:
        texts += [b, b.upper(), *(edited(rng, b, k % 4) for k in range(12))]
    hub = prose(rng, 200)
    texts += [edited(rng, hub, 2) for _ in range(30)] + [hub, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "few words", "few  WORDS"]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    want = brute_components(sets, 85)
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    unnamed = minhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(unnamed) == len(texts) and all(r.kept and r.component_id is None for r in unnamed)


def test_blocks_compare_all_members(spark, monkeypatch):
    """Large buckets are compared in pairs of blocks; a chain of links is one component."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 700)
    rng = random.Random(11)
    texts = [prose(rng, 100)]
    for _ in range(40):
        texts.append(edited(rng, texts[-1], 1))
    sets = minhash.shingle_sets(*_column(texts))
    want = brute_components([set(s.tolist()) for s in sets], 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_small_sets_have_an_exact_way(spark):
    """Short texts that differ by a word at one end: bands miss some of them, prefixes none."""
    rng = random.Random(21)
    texts = []
    for _ in range(400):
        words = prose(rng, rng.randint(5, 14)).split()
        texts += [" ".join(words), " ".join([*words, "x"]), " ".join(words[1:])]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    want = brute_components([shingles(t) for t in texts], 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def _column(texts):
    import pyarrow as pa

    from tidemark.llm.common import strings

    return strings(pa.array(texts))


def test_line_dedup(spark):
    rng = random.Random(12)
    lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 30))) for _ in range(30)]
    texts = [*ODD, "\n".join(lines[:9]), "\n".join([*lines[5:14], "", "  ", lines[5]]), "\n".join(edited(rng, x, 1) for x in lines[:14]), "\n".join(lines[20:]), "\n".join(lines[20:])]
    docs = docs_of(spark, texts)
    places = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k, x in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", x):
                places[x].append((i, k))
    distinct = list(places)
    gone = collections.defaultdict(list)
    groups = collections.defaultdict(list)
    for x, c in zip(distinct, brute_components([all_places(x) for x in distinct], 80), strict=True):
        groups[c] += places[x]
    for members in groups.values():
        for i, k in sorted(members)[1:]:
            gone[i].append(k)
    removed = line_dedup.removed_lines(docs)
    assert {r.doc_id: list(r.removed) for r in removed.collect()} == {i: sorted(v) for i, v in gone.items()}
    clashing = docs.withColumns({c: F.lit(1) for c in ("removed", "removed_", "text_hash", "t_", "t", "x", "i", "component")})
    cut = {r.doc_id: r for r in line_dedup.dedup_lines(clashing).collect()}
    assert len(cut) == len(texts)
    for i, t in enumerate(texts):
        want = t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert cut[i].text == want and cut[i].n_chars == (None if want is None else len(want)) and cut[i].removed_ == cut[i].removed == cut[i].t_ == cut[i].x == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 9), (7, 7), (None, 3), (3, 1)] + [(100, 100 + i) for i in range(50)] + [(300 + i, 301 + i) for i in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4} | {100 + i: 100 for i in range(50)} | {300 + i: 300 for i in range(61)}
    assert got == want


def all_places(line):
    """The five-character shingles of a line at every position."""
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def lines_kept(spark, lines):
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(lines)], SCHEMA).repartition(3)
    return [r.text == lines[r.doc_id] for r in sorted(line_dedup.dedup_lines(docs).collect())]


def test_line_dedup_looks_at_whole_lines(spark):
    """Long words, and lines without spaces, are compared to their ends."""
    rng = random.Random(13)
    lines = ["https://example.com/articles/2021/alpha", "https://example.com/shop/beta?id=77", "これは最初の行で、天気のことだけが書かれている。", "これは最初の行で、料理と旅行についてのみ述べる。", "a", "b"]
    lines += ["/usr/share/" + "".join(rng.choice("0123456789abcdef") for _ in range(200)) for _ in range(4)]
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120)) + "𠮷"
    lines += [cjk, cjk[:60] + "改" + cjk[61:], lines[0] * 3 + "/one", lines[0] * 3 + "/two"]
    c = brute_components([all_places(x) for x in lines], 80)
    assert c[:10] == list(range(10)) and c[11] == 10
    assert lines_kept(spark, lines) == [i == k for i, k in enumerate(c)]


def test_line_dedup_of_ordinary_lines(spark):
    """One changed word in lines of 8 to 30 words, as brute force over all positions says."""
    rng = random.Random(14)
    lines = ["the quick brown fox jumps over the lazy dog near the river", "the quick brown fox jumped over the lazy dog near the river"]
    for _ in range(40):
        x = " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 30)))
        lines += [x, edited(rng, x, 1)]
    c = brute_components([all_places(x) for x in lines], 80)
    assert c[1] == 0 and 20 < len(set(c)) < len(c)
    assert lines_kept(spark, lines) == [i == k for i, k in enumerate(c)]


def test_line_bands_find_pairs_at_the_threshold():
    """Of pairs with similarity 0.8 no more than one in 200 shares no band, whatever their size."""
    draw = np.random.default_rng(15)
    for n in (20, 60, 300):
        common, pairs = n * 4 // 5, 3000
        half = common + (n - common) // 2
        own = [np.frombuffer(draw.bytes(8 * n), np.uint64) for _ in range(pairs)]
        with np.errstate(over="ignore"):
            left = line_dedup.band_keys(line_dedup.signatures(np.concatenate([h[:half] for h in own]), np.full(pairs, half)))
            right = line_dedup.band_keys(line_dedup.signatures(np.concatenate([np.concatenate([h[:common], h[half:]]) for h in own]), np.full(pairs, common + n - half)))
        assert (~(left == right).any(axis=1)).sum() <= 15


def test_line_shingles_and_ids():
    """Spans, sets and ids of lines are those of the text's characters."""
    import pyarrow as pa
    import xxhash

    from tidemark.llm.common import strings

    texts = ["a\n\nab𠮷cdef\n \t\nlonger line", "", None, "\n", "été à la mer\n", "x" * 9]
    data, offsets = strings(pa.array(texts))
    chars, offsets = line_dedup.characters(data), line_dedup.char_offsets(data, offsets)
    want = [x for t in texts for x in (t or "").split("\n") if x.strip(" \t")]
    starts, ends = line_dedup.line_spans(chars, offsets)
    assert ["".join(map(chr, chars[a:b])) for a, b in zip(starts, ends, strict=True)] == want
    assert line_dedup.line_ids(chars, starts, ends).view(np.uint64).tolist() == [xxhash.xxh64_intdigest(x.encode(), 42) for x in want]
    with np.errstate(over="ignore"):
        h, counts = line_dedup.shingles_of(chars, starts, ends)
    assert counts.tolist() == [max(1, len(x) - 4) for x in want]
    places = [p for x in want for p in [x[i : i + 5] for i in range(max(1, len(x) - 4))]]
    assert len(set(h.tolist())) == len(set(places)) and len({(a, b) for a, b in zip(h.tolist(), places, strict=True)}) == len(set(places))


def test_small_sets_share_a_band():
    """Sets of seven and six shingles of which six are shared have a band in common, in whichever registers they fall."""
    draw = np.random.default_rng(16)
    for _ in range(20_000):
        sketch = np.zeros((2, minhash.BUCKETS), np.uint16)
        h = np.frombuffer(draw.bytes(56), np.uint64)
        for row, part in zip(sketch, (h, h[:6]), strict=True):
            at, value = minhash.registers(np.sort(part))
            row[at] = value
        with np.errstate(over="ignore"):
            keys, empty = minhash.band_keys(sketch)
        assert ((keys[0] == keys[1]) & ~empty[0] & ~empty[1]).any()


def test_clashing_names(spark):
    """Columns of any names pass the stages as they are."""
    rng = random.Random(23)
    extra = ["g", "own", "m0", "l00", "q_kept", "q_row", "mix_copies", "mix_copy", "mix_size", "packed", "key", "size"]
    docs = docs_of(spark, [prose(rng, 80) for _ in range(20)] + [None, ""]).withColumns({c: F.lit(c) for c in extra})
    for stage in (quality.keep_good, mixing.mixture):
        rows = stage(docs).collect()
        assert len(rows) > 10 and all(r[c] == c for r in rows for c in extra)
        assert stage(docs.limit(0)).columns == docs.columns


def test_one_deviating_statistic_is_enough(spark):
    """Texts that are ordinary but for repeated lines, repeated words or symbols are rejected; ordinary ones stay."""
    rng = random.Random(24)
    good = [prose(rng, rng.randint(80, 200)) for _ in range(150)]
    lines = [rng.choice(WORDS) + " " + rng.choice(WORDS) for _ in range(40)]
    bad = ["\n".join([*lines, *rng.sample(lines, 36)]), prose(rng, 100) + " " + " ".join(["w1 w2 w3 w4"] * 18), " ".join("#" + w if i % 2 else w for i, w in enumerate(prose(rng, 150).split(" ")))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)], SCHEMA)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert all(got[i].kept for i in range(150))
    assert [got[i].base_failed for i in (150, 151, 152)] == [False] * 3 and not any(got[i].kept for i in (150, 151, 152))


def test_line_dedup_packs_bucket_keys(spark):
    """Few packed rows go to the shuffle, and buckets are those of the keys row by row."""
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(60)]
    texts += [t.replace("w1", "w2", 1) for t in texts[:20]] + texts[40:45] + [texts[0] + "\n" + texts[0], None, "", "x"]
    docs = docs_of(spark, texts).select("text").coalesce(1)
    rows = [(k, x) for b in line_dedup._banded(docs.where("text IS NOT NULL").toArrow().to_batches()) for k, x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    packed = line_dedup.mapped(docs.where("text IS NOT NULL"), line_dedup._packed, "g int, rows binary").collect()
    assert sum(len(r.rows) for r in packed) == 16 * len(rows) and len(packed) < len(rows) / 2 and len({r.g for r in packed}) == len(packed)
    lines = collections.defaultdict(collections.Counter)
    for k, x in rows:
        lines[k][x] += 1
    members, repeated = line_dedup.buckets(docs)
    got = sorted(map(tuple, members.collect()))
    assert got == sorted((k, x) for k, c in lines.items() if len(c) > 1 for x in c) and got
    got = sorted(r.x for r in repeated.collect())
    assert got == sorted(x for k, c in lines.items() if k % 2 for x, m in c.items() if m > 1) and got


def test_line_dedup_moves_texts_of_lines_once(spark):
    """Texts are laid out by line, so that joins with them exchange the other side only."""
    docs = docs_of(spark, [f"line {i} of some text\nanother line {i % 3}" for i in range(30)])
    ids = line_dedup.lines_of(docs).select(line_dedup.line_id(F.col("line")).alias("x")).distinct()
    lines = line_dedup.laid_out(line_dedup.texts_of(docs, line_dedup.checkpointed(ids)))
    hint = line_dedup.checkpointed(ids.repartition(3)).hint("merge")
    plan = hint.join(lines, "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 1


def test_line_dedup_compares_few_as_many(spark):
    """Sets compared one by one join the components that matrices join; sets and words are those of brute force."""
    rng = random.Random(4)
    for _ in range(60):
        base = np.array(sorted(rng.sample(range(1000), 30)), np.uint64)
        sets = [np.unique(np.concatenate([rng.sample(base.tolist(), 27), [rng.randrange(2000) for _ in range(rng.randint(0, 6))]]).astype(np.uint64)) for _ in range(rng.randint(1, 12))]
        component = np.array([rng.randrange(6) for _ in sets])
        ends = []
        for join in (line_dedup._joining_few, minhash.joining):
            root = component.tolist()
            for i, j in join(sets, component, 80):
                assert 100 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 80 * len({*sets[i].tolist()} | {*sets[j].tolist()}) and root[i] != root[j]
                root = [root[j] if c == root[i] else c for c in root]
            ends.append([[a == b for b in root] for a in root])
        assert ends[0] == ends[1]
    texts = ["a", "abcabcabcabc", "é" * 9 + "x", " \t\v\f\r", "\x1c", " ", "", "  \r w"]
    import pyarrow as pa

    with np.errstate(over="ignore"):
        sizes = [len(x) for x in line_dedup._sets(pa.array(texts[:3]))]
    assert sizes == [len({t[i : i + 5] for i in range(max(1, len(t) - 4))}) for t in texts[:3]]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").where(line_dedup.has_word(F.col("line"))).collect()
    assert {r.line for r in rows} == {t for t in texts if re.search(r"[^\x20\x09-\x0D]", t)}


def test_line_dedup_compares_many_pairs_as_one(monkeypatch):
    """Pairs compared by matrices, of any width, are linked where brute force links them."""
    import pyarrow as pa

    rng = random.Random(14)
    left = ["a", "abcabcabcabc", "é" * 9 + "x", "日本語テキスト", "x" * 3000] + [prose(rng, rng.randint(3, 60), 99) for _ in range(150)]
    right = [edited(rng, t, rng.randint(0, 3)) if len(t) > 20 else t for t in left[:-20]] + left[:20]
    want = []
    for p, q in zip(left, right, strict=True):
        p, q = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (p, q))
        want.append(100 * len(p & q) >= 80 * len(p | q))
    assert 10 < sum(want) < len(want) - 10
    for cells in (1, 5000, 1 << 17):
        monkeypatch.setattr(line_dedup, "CELLS", cells)
        with np.errstate(over="ignore"):
            assert line_dedup._pairs_linked(pa.array(left), pa.array(right), 80).tolist() == want


def test_line_dedup_cuts_texts_of_many_lines_in_linear_time(spark):
    """The text is split once, not for every line that stays."""
    import time

    lines = [f"{i}" for i in range(30_000)]
    docs = spark.createDataFrame([(0, "\n".join(lines), [3, 29_999]), (1, "a\n\nb", [0]), (2, "a", [0]), (3, "a\nb", None), (4, None, None)], "doc_id long, text string, gone array<int>")
    begin = time.monotonic()
    got = {r.doc_id: r.t for r in docs.select("doc_id", line_dedup.without_lines(F.col("text"), F.col("gone")).alias("t")).collect()}
    assert time.monotonic() - begin < 15
    assert got == {0: "\n".join(lines[:3] + lines[4:-1]), 1: "\nb", 2: "", 3: "a\nb", 4: None}


def test_line_dedup_moves_texts_alike_in_small_and_large_tables(spark):
    docs = docs_of(spark, ["one line of text\nanother", "one line of text", "last"])
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 1 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_line_dedup_hashes_bounded_parts_of_a_group(monkeypatch):
    import pyarrow as pa

    texts = pa.array([prose(random.Random(i), 20, 99) for i in range(40)] + ["é" * 500])
    with np.errstate(over="ignore"):
        whole = line_dedup._sets(texts)
        sizes = []
        hashes = line_dedup.shingles_of
        monkeypatch.setattr(line_dedup, "shingles_of", lambda c, *x: sizes.append(len(c)) or hashes(c, *x))
        monkeypatch.setattr(line_dedup, "COMPARED_BYTES", 300)
        parts = line_dedup._sets(texts)
    assert len(sizes) > 5 and max(sizes) <= 500 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
