"""Near-duplicate documents by HyperMinHash.

A text's set holds the 64-bit hashes of its distinct five-word shingles. Hashes are dealt over
128 buckets; a register keeps the least one of its bucket as a count of leading zeros and ten
mantissa bits. Four registers make a band.

1. Documents with equal sets form a class and share one representative: copies never meet again.
2. In every band bucket each representative is paired with the bucket's leader (another one in
   each band), most often met leader first. Pairs are confirmed on full sets, and linked classes
   become components.
3. In buckets that still hold several components, representatives of different ones are compared
   by registers. The share of equal registers, less those expected to be equal by chance,
   estimates the similarity; what may reach the threshold within six standard deviations is
   confirmed on full sets, bucket by bucket: a set travels once for each group of bounded size, and
   all pairs of a group are counted there by the shingles that they have in common.

So no pair is ever a row unless it is a link that joins two components, and no group is capped: what
is skipped is already in one component. Bands cover all registers. Sets of fewer than ``SMALL``
shingles leave most registers empty; they have an exact way beside the bands: two linked sets share one
of their least hashes, so few of which are keys of buckets as well.

Nulls and texts without words have an empty set and are linked with nothing. Rows without doc_id
are counted, belong to no component (null) and are kept. Rows that share a doc_id are one node.
Ties cannot arise: leaders are least by (hash, doc_id), components least by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, in_groups, laid_out, lower_ascii, mapped, mix, release, slices, strings, table, word_hashes, word_spans
from .components import components, small

WIDTH = 5
BUCKETS, BANDS, ROWS = 128, 32, 4
MANTISSA_BITS = 10
#: Links are 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Candidates whose ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a bucket, and shingles of theirs, that are compared in one block.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
#: Sets of fewer shingles have an exact candidate way, as registers say little of them; sets linked with those have fewer than WIDEST.
SMALL, WIDEST = 40, 64
BATCH_BYTES = 8 << 20


def registers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that are not empty, and their registers, for sorted distinct hashes."""
    bucket = (h >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    fraction, exponent = np.frexp((h[first] & np.uint64((1 << 57) - 1)).astype(np.float64))
    value = (58 - exponent).astype(np.uint16) << np.uint16(MANTISSA_BITS)
    return bucket[first], value | np.floor(np.maximum(fraction * 2 - 1, 0) * (1 << MANTISSA_BITS)).astype(np.uint16)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Of each row, the sorted distinct hashes of its shingles."""
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    multiplier = np.uint64(0xB5297A4D3F84D5B5)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        rolled = rolled * multiplier + words[i : i + len(rolled)]
    rolled = mix(rolled)
    found, at = [], 0
    for n in counts.tolist():
        if n >= width:
            h = np.sort(rolled[at : at + n - width + 1])
            found.append(h[np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))])
        elif n:
            one = np.uint64(n)
            for w in words[at : at + n]:
                one = one * np.uint64(0xC2B2AE3D27D4EB4F) + w
            found.append(mix(np.array([one], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
        at += n
    return found


def prefix(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a small set of sorted hashes, of which any two linked sets share one: its least hashes, one more than a linked set may lack."""
    n = len(h)
    if n >= WIDEST:
        return h[:0]
    return mix(h[: n - -(-percent * n // 100) + 1] ^ np.uint64(0x2545F4914F6CDD1D))


def _sketch(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                sketch = np.zeros((j - i, BUCKETS), np.uint16)
                ids = np.zeros((j - i, 2), np.uint64)
                for k, h in enumerate(sets):
                    if len(h):
                        at, value = registers(h)
                        sketch[k, at] = value
                        ids[k] = mix(h).sum(dtype=np.uint64), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                bands, empty = band_keys(sketch)
                keys = [np.concatenate([b[~e], prefix(h, percent)]).view(np.int64).tolist() for b, e, h in zip(bands, empty, sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(h) for h in sets], pa.int64()),
                        pa.array(ids[:, 0].view(np.int64)),
                        pa.array(ids[:, 1].view(np.int64)),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n", "s1", "s2", "sketch", "bands"],
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h.tobytes() for h in sets], pa.binary())], names=["id", "shingles"])


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, set identity (s1, s2), sketch, bucket keys (bands) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "text"), partial(_sketch, percent=percent), f"doc_id {kind}, n long, s1 long, s2 long, sketch binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and shingles (binary) of the documents in ``ids``, laid out by id. Ids are broadcast while they are few."""
    n = ids.count()
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", "text")
    if n <= BROADCAST_IDS:
        wanted = wanted.join(F.broadcast(ids.withColumnRenamed("id", "doc_id")), "doc_id", "left_semi")
        return laid_out(mapped(wanted, _sets, f"id {kind}, shingles binary"), "id")
    return laid_out(mapped(wanted, _sets, f"id {kind}, shingles binary").join(ids, "id", "left_semi"), "id")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets (id, shingles; laid out by id) reach the threshold.

    Sets of a are joined where they lie. b may be a hub with very many pairs; both sides of that
    join are shuffled by a key that the layout does not know, so that Spark can split it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").withColumn("k", F.xxhash64("b"))
    hubs = sets.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").select(F.xxhash64("id").alias("k"), F.col("id").alias("hub"), F.col("shingles").alias("y"))
    return mapped(left.join(hubs, "k").where("b = hub").select("a", "b", "x", "y"), run, f"a {kind}, b {kind}")


def band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each band of each sketch, and which bands have no register at all."""
    keys = np.zeros((len(sketch), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys ^ sketch[:, r : BANDS * ROWS : ROWS].astype(np.uint64)) + np.arange(BANDS, dtype=np.uint64)
    return keys, (sketch[:, : BANDS * ROWS].reshape(len(sketch), BANDS, ROWS) == 0).all(axis=2)


def estimates(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of each sketch of ``x`` to that in ``y``, less the registers expected to be equal by chance; and their first common band."""
    own, filled = x != 0, y != 0
    equal = (x == y) & own
    both = (own & filled).sum(axis=1)
    found = (equal.sum(axis=1) - both / (3 << MANTISSA_BITS)) / np.maximum(own.sum(axis=1) + filled.sum(axis=1) - both, 1)
    bands = (x == y).reshape(len(x), BANDS, ROWS).all(axis=2) & own.reshape(len(x), BANDS, ROWS).any(axis=2)
    return found, np.where(bands.any(axis=1), bands.argmax(axis=1), BANDS)


def _floor(percent: int) -> float:
    p = percent / 100
    return p - 6 * (p * (1 - p) / BUCKETS) ** 0.5


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (key, id, component, n, sketch) of buckets in groups g of bounded size, with their block and the group's two.

    A bucket is one group while its members and their sets are few; a larger one is cut into blocks that meet in pairs, so that it is many tasks.
    """
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "component", "n", "sketch")
    return rows.select(F.xxhash64("key", "p", "q").alias("g"), (F.col("p") == F.col("q")).alias("whole"), (F.col("block") == F.col("p")).alias("left"), "key", "id", "component", "n", "sketch")


def rivals(groups: DataFrame, percent: int) -> DataFrame:
    """Those rows (g, component, id) of ``groups`` that may be similar to one of another component in their group.

    A pair that shares several bands is looked at in the first alone.
    """
    id_kind, floor = groups.schema["id"].dataType.simpleString(), _floor(percent)

    def run(t: pa.Table) -> pa.Table:
        g, key, n = (np.asarray(t.column(c)) for c in ("g", "key", "n"))
        whole, left = np.array(t.column("whole"), bool), np.array(t.column("left"), bool)
        ids, component = (np.asarray(t.column(c).combine_chunks().dictionary_encode().indices) for c in ("id", "component"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys, _ = band_keys(sketch)
        at = keys.view(np.int64) == key[:, None]
        band = np.where(at.any(axis=1), at.argmax(axis=1), BANDS)
        wanted = np.zeros(len(g), bool)
        d = 1
        while len(i := np.flatnonzero(g[:-d] == g[d:])):
            j = i + d
            able = (component[i] != component[j]) & (ids[i] != ids[j]) & (whole[i] | (left[i] != left[j])) & (np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j]))
            i, j = i[able], j[able]
            for k in range(0, len(i), 20_000):
                x, y = i[k : k + 20_000], j[k : k + 20_000]
                e, first = estimates(sketch[x], sketch[y])
                # the estimate says little of small sets, which are compared in any case
                near = ((e >= floor) | (np.minimum(n[x], n[y]) < SMALL)) & (first == band[x])
                wanted[x[near]] = True
                wanted[y[near]] = True
            d += 1
        return t.select(["g", "component", "id"]).filter(pa.array(wanted))

    return in_groups(groups, run, f"g long, component {id_kind}, id {id_kind}")


def joining(sets: list[np.ndarray], component: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links of ``sets`` in different components that join all that can be joined: none within what links have joined before.

    Of two in different components one at least is not in the commonest; those meet all others, by the shingles that sets have in common.
    """
    names, own, counts = np.unique(component, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(own != counts.argmax())
    size = np.array([len(x) for x in sets], np.int64)
    h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    several = ~(new & np.concatenate([new[1:], [True]]))
    column, owner = (np.cumsum(new) - 1)[several], owner[order][several]
    column = np.cumsum(np.diff(column, prepend=column[:1]) > 0)
    common = np.zeros((len(rest), len(sets)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = max(1, min(columns, (4 << 20) // len(sets)))
    edges = np.searchsorted(column, np.arange(0, columns + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        found = np.zeros((len(sets), width), np.float32)
        found[owner[a:b], column[a:b] - k * width] = 1
        common += found[rest] @ found.T
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for k, i in enumerate(rest.tolist()):
        linked = np.flatnonzero((100 * common[k] >= percent * (size[i] + size - common[k])) & (own != own[i]))
        # one link to each other component is enough
        for c, j in zip(*np.unique(own[linked], return_index=True), strict=True):
            x, y = root(own[i]), root(int(c))
            if x != y:
                parent[x] = y
                yield i, int(linked[j])


def confirmed_in_groups(wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) on full sets between components of each group of ``wanted`` (g, component, id). A set travels once for each group."""
    kind = wanted.schema["id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        g, ids = np.asarray(t.column("g")), t.column("id").combine_chunks()
        component = np.asarray(t.column("component").combine_chunks().dictionary_encode().indices)
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        found = [(a + i, a + j) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b > a + 1 for i, j in joining(shingles[a:b], component[a:b], percent)]
        left, right = (pa.array([x[c] for x in found], pa.int64()) for c in range(2))
        return pa.table({"a": ids.take(left), "b": ids.take(right)})

    rows = wanted.join(sets, "id").select("g", "component", "id", "shingles")
    return in_groups(rows, run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row of ``docs`` (doc_id, text)."""
    rows = checkpointed(sketches(docs, percent))
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"))
    heads = some.join(classes.withColumnRenamed("id", "doc_id"), ["s1", "s2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "id")
    heads = laid_out(heads.drop("s1", "s2"), "id")
    release(docs.sparkSession)

    banded = heads.select("id", "n", F.explode("bands").alias("key"))
    # the leader of a bucket is the least by a hash that differs from band to band
    leaders = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "n")).alias("l")).where("m > 1")
    shared = checkpointed(banded.join(leaders.select("key", "l"), "key").select("key", "id", "n", F.col("l.id").alias("leader"), F.col("l.n").alias("leader_n")))
    sets = full_sets(docs, checkpointed(shared.select("id").distinct()))
    release(docs.sparkSession)
    met = shared.where(f"id <> leader AND 100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)")
    met = met.groupBy(F.col("id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("bands"))
    first = met.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("x")).select("a", "x.b")
    links = checkpointed(confirmed(checkpointed(first), sets, percent))
    found = checkpointed(components(links))
    release(docs.sparkSession)

    def labelled(frame: DataFrame, node: str, into: str) -> DataFrame:
        names = found.select(F.col("node").alias(node), F.col("component").alias(into))
        return frame.join(small(names, found.count()), node, "left").withColumn(into, F.coalesce(into, node))

    # leaders met less often, where that joins other components
    more = labelled(labelled(met.select("a", "b", "bands"), "a", "ca"), "b", "cb").where("ca <> cb")
    more = more.groupBy(F.least("ca", "cb").alias("p"), F.greatest("ca", "cb").alias("q")).agg(F.max(F.struct("bands", "a", "b")).alias("x")).select("x.a", "x.b")
    links = checkpointed(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(confirmed(checkpointed(more), sets, percent)))
    found = checkpointed(components(links))
    release(docs.sparkSession)

    # what is left in the buckets
    members = labelled(shared.select("key", "id"), "id", "component")
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    members = members.join(mixed, "key", "left_semi").distinct().join(heads.select("id", "n", "sketch"), "id")
    more = confirmed_in_groups(checkpointed(rivals(dealt(members), percent)), sets, percent)
    found = checkpointed(components(checkpointed(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))))
    release(docs.sparkSession)

    of_class = labelled(classes, "id", "component_id").select("s1", "s2", "component_id")
    light = rows.select("doc_id", "n", "s1", "s2")
    linked = light.where("n > 0 AND doc_id IS NOT NULL").join(of_class, ["s1", "s2"]).select("doc_id", "n", "component_id")
    alone = light.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without those that are linked with one of smaller doc_id. Ids that go are broadcast while they are few."""
    gone = checkpointed(near_duplicates(docs, percent).where("NOT kept").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.id = e.x WHERE r.c < e.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) AS m ON m.id = d.doc_id
"""
