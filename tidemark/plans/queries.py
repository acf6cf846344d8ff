"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.model import MEMORY_LIMIT_BYTES, PARAM_BOUNDS, PolicyParams
from tidemark.operators import artifacts as A
from tidemark.operators import commands as C
from tidemark.operators import metrics as M
from tidemark.operators import policies as P
from tidemark.operators import state as K
from tidemark.operators import ticks as T
from tidemark.sources.tables import artifact_log, command_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (
    SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'u' || user_id AS key,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'SET' WHEN event_type = 'error' THEN 'DEL' ELSE 'GET' END AS cmd,
           CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(value * 10) AS BIGINT) + 1 END AS size_bytes,
           CASE WHEN event_type = 'signup' THEN (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) * 3600000 END AS ttl_ms,
           ['default', 'premium', 'vector', 'prompt', 'rag', 'rerank', 'response'][CAST(user_id % 7 AS INTEGER) + 1] AS owner
    FROM events)"""
#: Each row's last write before it, and whether it can be read.
SEEN = (
    LOG
    + """, seen AS (
    SELECT *, last_value(CASE WHEN cmd <> 'GET' THEN {'seq': seq, 'cmd': cmd, 'size': size_bytes, 'dl': ts_ms + ttl_ms} END IGNORE NULLS)
        OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM log),
reads AS (SELECT seq, ts_ms, key, owner, coalesce(v.cmd = 'SET' AND (v.dl IS NULL OR v.dl > ts_ms), false) AS hit, v.seq AS vseq, v.size AS vsize, cmd FROM seen),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE cmd <> 'GET'),
entries AS (SELECT key, owner, size_bytes, ts_ms AS created_ms, ts_ms + ttl_ms AS deadline_ms, seq AS set_seq FROM w WHERE rn = 1 AND cmd = 'SET'),
state AS (
    SELECT e.key, e.owner, e.size_bytes, e.created_ms, coalesce(max(r.ts_ms), e.created_ms) AS last_access_ms, count(r.seq) AS hit_count, e.deadline_ms, n.as_of_ms
    FROM entries e CROSS JOIN (SELECT max(ts_ms) AS as_of_ms FROM log) n LEFT JOIN reads r ON r.vseq = e.set_seq AND r.hit AND r.cmd = 'GET'
    WHERE e.deadline_ms IS NULL OR e.deadline_ms > n.as_of_ms
    GROUP BY e.key, e.owner, e.size_bytes, e.created_ms, e.deadline_ms, n.as_of_ms)"""
)
ARTIFACTS = """art AS (
    SELECT 'embedding' AS type, 'emb:m' || label || ':' || vec_id || ':64:float' AS key, 'vector' AS owner, 'm' || label AS model_id, 'ix' || (vec_id % 5) AS snapshot_epoch, 'v' || vec_id AS payload FROM embeddings
    UNION ALL SELECT 'rag_chunk', 'rag:' || coalesce(source, '') || ':' || doc_id || ':r1', 'rag', NULL, 'ix' || (doc_id % 5), text FROM documents
    UNION ALL SELECT 'prompt', 'prm:tok:' || conv_id || '-' || turn, 'prompt', NULL, NULL, text FROM conversations WHERE role = 'user'
    UNION ALL SELECT 'response', 'rsp:' || conv_id || '-' || turn || ':p:m' || (conv_id % 3), 'response', 'm' || (conv_id % 3), NULL, text FROM conversations WHERE role = 'assistant'),
arts AS (
    SELECT *, octet_length(encode(payload)) AS size_bytes, md5(coalesce(payload, '')) AS blob_hash,
           CASE owner WHEN 'response' THEN 3600000 WHEN 'prompt' THEN 86400000 WHEN 'vector' THEN 604800000 WHEN 'rag' THEN 21600000 ELSE 3600000 END AS ttl_ms,
           CASE type WHEN 'embedding' THEN 8.0 WHEN 'response' THEN 4.0 WHEN 'prompt' THEN 2.0 WHEN 'rag_chunk' THEN 2.5 ELSE 1.0 END AS miss_cost FROM art)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return K.live_entries(command_log(spark, sf))


def _artifacts(spark: SparkSession, sf: str) -> DataFrame:
    return A.with_defaults(artifact_log(spark, sf))


# --- state and reads ---


@query(f"WITH {SEEN} SELECT key, owner, size_bytes, created_ms, last_access_ms, hit_count, deadline_ms FROM state")
def state_live_entries(spark, sf):
    return _state(spark, sf).drop("as_of_ms")


@query(f"WITH {SEEN} SELECT seq, key, hit, CASE WHEN hit THEN vseq END AS version_seq, CASE WHEN hit THEN vsize END AS size_bytes FROM reads WHERE cmd = 'GET'")
def get_as_of(spark, sf):
    return K.reads(command_log(spark, sf)).select("seq", "key", "hit", "version_seq", "size_bytes")


@query(f"WITH {SEEN} SELECT owner, count(*) AS gets, count(*) FILTER (hit) AS hits, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate FROM reads WHERE cmd = 'GET' GROUP BY owner")
def get_hit_rate_by_owner(spark, sf):
    return M.hit_rate(K.reads(command_log(spark, sf))).withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"WITH {SEEN} SELECT seq // 100 AS req, CAST(row_number() OVER (PARTITION BY seq // 100 ORDER BY seq) - 1 AS INTEGER) AS position, r.key, s.size_bytes FROM reads r LEFT JOIN state s ON r.key = s.key WHERE cmd = 'GET'")
def mget_ordered(spark, sf):
    gets = command_log(spark, sf).where("cmd = 'GET'").groupBy(F.floor(F.col("seq") / 100).alias("req"))
    requests = gets.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "key"))), lambda x: x["key"]).alias("keys"))
    return K.mget(requests, _state(spark, sf))


@query(f"WITH {SEEN} SELECT key, count(*) AS dels, CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS removed FROM reads WHERE cmd = 'DEL' GROUP BY key")
def del_removed_counts(spark, sf):
    return K.deletes(command_log(spark, sf)).groupBy("key").agg(F.count("*").alias("dels"), F.sum("removed").alias("removed"))


@query(f"WITH {SEEN} SELECT s.key, s.size_bytes FROM state s WHERE s.key NOT IN (SELECT 'u' || user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0)")
def del_remaining_state(spark, sf):
    gone = command_log(spark, sf).where("cmd = 'DEL' AND seq % 50 = 0")
    return K.without(_state(spark, sf), gone).select("key", "size_bytes")


@query(
    f"""WITH {LOG}, moved AS (
    SELECT key, seq, ts_ms + 7200000 AS dl FROM log WHERE cmd = 'GET' AND seq % 10 = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE cmd <> 'GET')
SELECT w.key, coalesce((SELECT arg_max(m.dl, m.seq) FROM moved m WHERE m.key = w.key AND m.seq > w.seq), w.ts_ms + w.ttl_ms) AS deadline_ms
FROM w WHERE rn = 1 AND cmd = 'SET'"""
)
def expire_update(spark, sf):
    """Every tenth read also sets the key to end in two hours."""
    log = command_log(spark, sf)
    moves = log.where("cmd = 'GET' AND seq % 10 = 0").withColumn("cmd", F.lit("EXPIRE")).withColumn("deadline_ms", F.col("ts_ms") + 7_200_000)
    return K.entries(log.where("cmd <> 'GET'").unionByName(moves)).select("key", "deadline_ms")


@query(
    f"""WITH {SEEN} SELECT k.key, CAST(CASE WHEN e.key IS NULL THEN -2 WHEN e.deadline_ms IS NULL THEN -1 WHEN e.deadline_ms <= n.now THEN -2
        ELSE (e.deadline_ms - n.now) // 1000 END AS BIGINT) AS ttl_s
    FROM (SELECT DISTINCT key FROM log) k LEFT JOIN entries e ON k.key = e.key CROSS JOIN (SELECT max(ts_ms) AS now FROM log) n"""
)
def ttl_remaining(spark, sf):
    log = command_log(spark, sf)
    rows = log.select("key").distinct().join(K.entries(log), "key", "left").join(F.broadcast(K.as_of(log)))
    return rows.select("key", S.ttl_seconds(F.col("set_seq").isNotNull(), F.col("deadline_ms"), F.col("as_of_ms")).alias("ttl_s"))


@query(f"WITH {SEEN} SELECT count(*) AS expired, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS expired_bytes FROM entries WHERE deadline_ms <= (SELECT max(ts_ms) FROM log)")
def expired_backlog(spark, sf):
    log = command_log(spark, sf)
    rows = K.entries(log).join(F.broadcast(K.as_of(log))).where("deadline_ms <= as_of_ms")
    return rows.agg(F.count("*").alias("expired"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("expired_bytes"))


# --- guards, placement, sizes ---


@query(
    """SELECT coalesce(CASE WHEN octet_length(encode(k)) NOT BETWEEN 1 AND 256 THEN 'invalid key length' WHEN octet_length(encode(text)) > 4096 THEN 'value too large' END, 'ok') AS verdict, count(*) AS n
    FROM (SELECT CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 0 THEN repeat('k', 257) ELSE 'd' || doc_id END AS k, text FROM documents) GROUP BY 1"""
)
def size_guard(spark, sf):
    key = F.when(F.col("doc_id") % 97 == 0, "").when(F.col("doc_id") % 89 == 0, "k" * 257).otherwise(F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    verdict = F.coalesce(S.write_error(key, F.octet_length("text"), 4096), F.lit("ok"))
    return table(spark, sf, "documents").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN octet_length(encode(html)) >= 4096 THEN 'ssd' ELSE 'ram' END AS tier, count(*) AS n, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def tier_placement(spark, sf):
    size = F.octet_length("html").cast("long")
    return table(spark, sf, "pages").groupBy(F.when(size >= 4096, "ssd").otherwise("ram").alias("tier")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


_CLASS = "CASE WHEN b <= 64 THEN 64 WHEN b <= 128 THEN 128 WHEN b <= 256 THEN 256 WHEN b <= 512 THEN 512 WHEN b <= 1024 THEN 1024 WHEN b <= 4096 THEN ((b + 511) // 512) * 512 ELSE ((b + 4095) // 4096) * 4096 END"


@query(f"SELECT CAST({_CLASS} AS BIGINT) AS size_class, count(*) AS n FROM (SELECT octet_length(encode(text)) AS b FROM documents) GROUP BY 1")
def size_classes(spark, sf):
    return table(spark, sf, "documents").groupBy(S.size_class(F.octet_length("text")).alias("size_class")).agg(F.count("*").alias("n"))


@query(f"WITH {SEEN} SELECT CAST(sum(b) AS BIGINT) AS memory_used_bytes, round(sum({_CLASS}) / sum(b), 6) AS memory_overhead_ratio FROM (SELECT size_bytes AS b FROM state)")
def memory_overhead(spark, sf):
    return M.overhead(_state(spark, sf)).withColumn("memory_overhead_ratio", F.round("memory_overhead_ratio", 6))


@query(f"WITH {SEEN} SELECT owner, count(*) AS keys, CAST(sum(size_bytes) AS BIGINT) AS used_bytes FROM state GROUP BY owner")
def owner_usage(spark, sf):
    return M.owner_usage(_state(spark, sf))


@query(
    f"""WITH {SEEN}, u AS (SELECT owner, sum(size_bytes) AS used FROM state GROUP BY owner),
n AS (SELECT 'u' || user_id AS key, any_value(['default', 'premium', 'vector', 'prompt', 'rag', 'rerank', 'response'][CAST(user_id % 7 AS INTEGER) + 1]) AS owner, max(CAST(floor(value * 10) AS BIGINT) + 1) AS size_bytes FROM events GROUP BY user_id)
SELECT n.key, n.owner, n.size_bytes FROM n LEFT JOIN state s ON n.key = s.key LEFT JOIN u ON n.owner = u.owner
WHERE coalesce(u.used, 0) - CASE WHEN s.owner = n.owner THEN s.size_bytes ELSE 0 END + n.size_bytes > 4000"""
)
def owner_quota_rejections(spark, sf):
    """Each user writes its largest value; owners may hold 4,000 bytes."""
    from tidemark.sources.tables import OWNERS

    owner = F.get(F.array(*(F.lit(o) for o in OWNERS)), (F.col("user_id") % len(OWNERS)).cast("int"))
    writes = table(spark, sf, "events").groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), owner.alias("owner")).agg(F.max(F.floor(F.col("value") * 10) + 1).alias("size_bytes"))
    return P.quota_rejections(_state(spark, sf), writes, 4_000)


@query(f"WITH {SEEN} SELECT string_agg(key || ':' || hit_count, ',' ORDER BY hit_count DESC, key) AS topk_hits FROM (SELECT * FROM state ORDER BY hit_count DESC, key LIMIT 5)")
def top_keys_by_hits(spark, sf):
    return M.top_hits(_state(spark, sf))


_INFO_SQL = f"""WITH {SEEN}, c AS (SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM reads WHERE cmd = 'GET'),
b AS (SELECT count(*) AS n FROM entries WHERE deadline_ms <= (SELECT max(ts_ms) FROM log)), m AS (SELECT count(*) AS keys, sum(size_bytes) AS used FROM state)
SELECT name, value FROM (
    SELECT 3 AS line, 'keys' AS name, CAST(keys AS VARCHAR) AS value FROM m UNION ALL SELECT 4, 'memory_used_bytes', CAST(used AS VARCHAR) FROM m
    UNION ALL SELECT 7, 'expiration_backlog', CAST(n AS VARCHAR) FROM b UNION ALL SELECT 8, 'hits', CAST(hits AS VARCHAR) FROM c UNION ALL SELECT 9, 'misses', CAST(misses AS VARCHAR) FROM c)"""


_ENDED = f"""{SEEN}, nx AS (SELECT *, lead(ts_ms) OVER (PARTITION BY key ORDER BY seq) AS next_ms FROM log WHERE cmd <> 'GET'), mx AS (SELECT max(ts_ms) AS t FROM log),
x AS (SELECT count(*) AS n FROM nx, mx WHERE ts_ms + ttl_ms <= t AND (next_ms IS NULL OR next_ms >= ts_ms + ttl_ms)),
k AS (SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS b FROM state), g AS (SELECT count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m FROM reads WHERE cmd = 'GET'),
top AS (SELECT string_agg(key || ':' || hit_count, ',' ORDER BY hit_count DESC, key) AS s FROM (SELECT * FROM state ORDER BY hit_count DESC, key LIMIT 5)),
lines AS (SELECT unnest([{{'name': 'policy_mode', 'value': 'lru'}}, {{'name': 'policy_params_version', 'value': 'defaults-v1'}}, {{'name': 'memory_limit_bytes', 'value': '67108864'}},
{{'name': 'keys', 'value': CAST(k.n AS VARCHAR)}}, {{'name': 'memory_used_bytes', 'value': CAST(k.b AS VARCHAR)}}, {{'name': 'ram_bytes', 'value': CAST(k.b AS VARCHAR)}}, {{'name': 'hits', 'value': CAST(g.h AS VARCHAR)}}, {{'name': 'misses', 'value': CAST(g.m AS VARCHAR)}},
{{'name': 'expirations', 'value': CAST(x.n AS VARCHAR)}}, {{'name': 'topk_hits', 'value': top.s}}]) AS l FROM k, g, x, top),
none AS (SELECT unnest(['expiration_backlog', 'evictions', 'admissions_rejected', 'ssd_bytes', 'ssd_gets', 'ssd_hits', 'ssd_misses', 'promotions', 'demotions', 'ssd_read_mb', 'ssd_write_mb', 'tier_backlog', 'ssd_gc_runs', 'ssd_gc_bytes_reclaimed']) AS name)"""


@query(f"WITH {_ENDED} SELECT l.name AS name, l.value AS value FROM lines UNION ALL SELECT name, '0' FROM none UNION ALL SELECT 'fragmentation_estimate', '0.0'")
def info_report(spark, sf):
    """The report of a cache that never fills and has no second tier, all lines from the replay's counters."""
    from tidemark.operators.replay import counters

    log = command_log(spark, sf)
    report = M.info(log, K.live_entries(log), counters(log, "lru", MEMORY_LIMIT_BYTES), MEMORY_LIMIT_BYTES, "lru", PolicyParams().version)
    return report.where("name <> 'memory_overhead_ratio'").select("name", "value")


@query()
def info_under_pressure(spark, sf):
    """The same lines for a small cache with a second tier."""
    from tidemark.model import CacheConfig
    from tidemark.operators.replay import counters

    log = command_log(spark, sf)
    tiered = CacheConfig(ssd_enabled=True, ssd_value_min_bytes=2000)
    return M.info(log, K.live_entries(log), counters(log, "lru", 20_000, config=tiered), 20_000, "lru", PolicyParams().version)


@query(_INFO_SQL)
def info_counters(spark, sf):
    """The same facts from the log as a set, without a replay."""
    log = command_log(spark, sf)
    reads, now = K.reads(log), K.as_of(log)
    counted = reads.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    over = K.entries(log).join(F.broadcast(now)).agg(F.count_if(F.col("deadline_ms") <= F.col("as_of_ms")).alias("expiration_backlog"))
    row = M.overhead(K.live_entries(log)).crossJoin(K.live_entries(log).agg(F.count("*").alias("keys"))).crossJoin(counted).crossJoin(over)
    names = ("keys", "memory_used_bytes", "expiration_backlog", "hits", "misses")
    lines = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))
    return row.select(F.inline(lines))


# --- policies ---

_BENEFIT = "{cost} + least(1.0, ({hits} + 1) / (greatest(1, ({idle}) // 1000) + 1)) - (size_bytes / 1024.0 + (size_bytes % 64) * 0.01) - CASE WHEN size_bytes > 262144 THEN 1.0 ELSE 0.0 END"
_COST_ORDER = _BENEFIT.format(cost="1.0", hits="hit_count", idle="as_of_ms - last_access_ms")


def _victim_sql(order: str, gate: str = "true") -> str:
    return f"""WITH {SEEN}, t AS (SELECT sum(size_bytes) AS used FROM state), o AS (
        SELECT key, size_bytes, coalesce(sum(size_bytes) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM state)
    SELECT key, size_bytes, CAST(freed AS BIGINT) AS freed_before FROM o, t WHERE used - freed > used * 0.5 AND {gate}"""


def _victims(spark, sf, policy):
    rows = P.victims(_state(spark, sf), policy, F.sum("size_bytes") * 0.5)
    return rows.withColumn("freed_before", F.col("freed_before").cast("long"))


@query(_victim_sql("last_access_ms, key"))
def victims_lru(spark, sf):
    return _victims(spark, sf, "lru")


@query(_victim_sql("hit_count, last_access_ms, key"))
def victims_lfu(spark, sf):
    return _victims(spark, sf, "lfu")


@query(_victim_sql(f"{_COST_ORDER}, key"))
def victims_cost(spark, sf):
    return _victims(spark, sf, "cost")


@query(f"WITH {SEEN} SELECT 'lru' AS policy, (SELECT key FROM state ORDER BY last_access_ms, key LIMIT 1) AS key UNION ALL SELECT 'lfu', (SELECT key FROM state ORDER BY hit_count, last_access_ms, key LIMIT 1) UNION ALL SELECT 'cost', (SELECT key FROM state ORDER BY {_COST_ORDER}, key LIMIT 1)")
def next_victim_by_policy(spark, sf):
    state = _state(spark, sf)
    one = lambda p: P.next_victim(state, p).select(F.lit(p).alias("policy"), "key")
    return one("lru").union(one("lfu")).union(one("cost"))


_ADMIT = _BENEFIT.format(cost="CASE owner WHEN 'premium' THEN 2.0 WHEN 'vector' THEN 8.0 WHEN 'prompt' THEN 2.0 WHEN 'rag' THEN 3.0 WHEN 'rerank' THEN 4.0 WHEN 'response' THEN 5.0 ELSE 1.0 END", hits="0", idle="0")


@query(f"WITH {LOG} SELECT seq, round({_ADMIT}, 6) AS score, row_number() OVER (PARTITION BY ts_ms // 1000 ORDER BY seq) AS nth, ({_ADMIT}) > 0 AND row_number() OVER (PARTITION BY ts_ms // 1000 ORDER BY seq) <= 10000 AS admitted FROM log WHERE cmd = 'SET'")
def cost_admissions(spark, sf):
    return P.admissions(command_log(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {LOG} SELECT ts_ms // 3600000 AS hour, count(*) AS n, least(count(*), 10) AS within_cap FROM log WHERE cmd = 'SET' GROUP BY 1")
def rate_window_aligned(spark, sf):
    """Writes of each aligned hour, and how many a cap of ten lets in."""
    sets = command_log(spark, sf).where("cmd = 'SET'").groupBy(F.floor(F.col("ts_ms") / 3_600_000).alias("hour"))
    return sets.agg(F.count("*").alias("n")).withColumn("within_cap", F.least("n", F.lit(10).cast("long")))


# --- artifacts ---


@query(f"WITH {ARTIFACTS} SELECT type, key FROM art UNION ALL SELECT 'rerank_buffer', 'rrk:' || conv_id || ':ix' || (conv_id % 5) || ':10:p' FROM (SELECT DISTINCT conv_id FROM conversations)")
def canonical_keys(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    buffers = ids.select(F.lit("rerank_buffer").alias("type"), S.rerank_key(F.col("conv_id"), F.concat(F.lit("ix"), (F.col("conv_id") % 5).cast("string")), F.lit(10), F.lit("p")).alias("key"))
    return artifact_log(spark, sf).select("type", "key").union(buffers)


@query(
    """WITH h AS (SELECT conv_id, turn, hex(encode(coalesce(text, ''))) AS x FROM conversations)
SELECT conv_id, turn, lower(to_hex(CAST(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2)) AS UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(1469598103934665603 AS UHUGEINT)) AS UBIGINT))) AS content_hash FROM h"""
)
def content_hashes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"))


@query(f"WITH {ARTIFACTS}, f AS (SELECT type, blob_hash, count(DISTINCT key) AS n FROM arts GROUP BY ALL) SELECT type, CAST(sum(n) AS BIGINT) AS puts, count(*) AS blobs, CAST(sum(n - 1) AS BIGINT) AS dedup_hits FROM f GROUP BY type")
def dedup_by_type(spark, sf):
    return A.dedup_hits(_artifacts(spark, sf))


@query(f"WITH {ARTIFACTS} SELECT blob_hash, count(DISTINCT key) AS refcount, CAST(max(size_bytes) AS BIGINT) AS size_bytes FROM arts GROUP BY blob_hash")
def blob_refcounts(spark, sf):
    return A.blobs(_artifacts(spark, sf))


_META = """'{' || CASE WHEN conv_id % 7 = 0 THEN '' ELSE '"artifact_type":"prompt",' END || '"owner": "prompt","schema_version":"' || turn || '","ttl_deadline":' || (conv_id * 10) || CASE WHEN turn % 2 = 0 THEN ',"miss_cost":2.5' ELSE '' END || '}'"""


@query(
    f"""WITH p AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'response' ELSE 'prompt' END AS type, {_META} AS meta FROM conversations)
SELECT conv_id, turn, CAST(regexp_extract(meta, '"ttl_deadline"\\s*:\\s*([0-9]+)', 1) AS BIGINT) AS m_ttl_ms,
       CASE WHEN turn % 2 = 0 THEN 2.5 END AS m_miss_cost,
       CASE WHEN conv_id % 7 = 0 THEN 'missing required metadata fields' WHEN type <> 'prompt' THEN 'artifact type mismatch' END AS error FROM p"""
)
def metadata_parsed(spark, sf):
    n = lambda c: F.col(c).cast("string")
    meta = F.concat(
        F.lit("{"), F.when(F.col("conv_id") % 7 == 0, "").otherwise('"artifact_type":"prompt",'), F.lit('"owner": "prompt","schema_version":"'), n("turn"), F.lit('","ttl_deadline":'), (F.col("conv_id") * 10).cast("string"), F.when(F.col("turn") % 2 == 0, ',"miss_cost":2.5').otherwise(""), F.lit("}")
    )
    puts = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, "response").otherwise("prompt").alias("type"), meta.alias("meta_json"))
    return A.parsed_meta(puts).select("conv_id", "turn", "m_ttl_ms", "m_miss_cost", "error")


@query(f"WITH {ARTIFACTS} SELECT key, CAST(size_bytes AS BIGINT) AS size_bytes, CAST(ttl_ms AS BIGINT) AS ttl_ms, CAST(miss_cost AS DOUBLE) AS miss_cost, blob_hash FROM arts")
def put_defaults(spark, sf):
    return _artifacts(spark, sf).select("key", "size_bytes", "ttl_ms", "miss_cost", "blob_hash")


@query(
    f"""WITH {ARTIFACTS} SELECT key, '{{"artifact_type":"' || type || '","owner":"' || owner || '","schema_version":"1","model_id":"' || coalesce(model_id, '') || '","created_at":0,"ttl_deadline":' || ttl_ms || ',"size_bytes":' || size_bytes
    || ',"content_hash":"' || blob_hash || '","tenant":"local","snapshot_epoch":"' || coalesce(snapshot_epoch, '') || '","source_rev":""}}' AS meta_json FROM arts"""
)
def metadata_json(spark, sf):
    return _artifacts(spark, sf).select("key", A.meta_json(F.lit(0)).alias("meta_json"))


def _artifact_requests(spark, sf):
    """Every view asks for one artifact, by number; one number in eleven is not there."""
    n = table(spark, sf, "embeddings").count()
    views = table(spark, sf, "events").where("event_type = 'view'")
    vec = F.col("event_id") % (n + n // 10)
    label = table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), "label")
    rows = views.select(F.col("event_id").alias("req"), vec.alias("v")).join(label, "v", "left")
    return rows.select("req", S.embedding_key(F.concat(F.lit("m"), F.coalesce("label", F.lit(0)).cast("string")), F.col("v"), F.lit(64), F.lit("float")).alias("key"))


_REQUESTS = "n AS (SELECT count(*) AS n FROM embeddings), rq AS (SELECT event_id AS req, event_id % (n + n // 10) AS v FROM events, n WHERE event_type = 'view'), r AS (SELECT req, 'emb:m' || coalesce(label, 0) || ':' || v || ':64:float' AS key FROM rq LEFT JOIN embeddings ON v = vec_id)"


@query(f"WITH {ARTIFACTS}, {_REQUESTS} SELECT r.req, r.key, a.key IS NOT NULL AS hit, a.size_bytes AS payload_bytes FROM r LEFT JOIN arts a ON r.key = a.key")
def artifact_get(spark, sf):
    found = _artifacts(spark, sf)
    return A.get(_artifact_requests(spark, sf), found, A.blobs(found)).select("req", "key", "hit", "payload_bytes")


@query(f"WITH {ARTIFACTS}, {_REQUESTS} SELECT r.req // 50 AS req, CAST(row_number() OVER (PARTITION BY r.req // 50 ORDER BY r.req) - 1 AS INTEGER) AS position, r.key, a.key IS NOT NULL AS hit, a.size_bytes AS payload_bytes FROM r LEFT JOIN arts a ON r.key = a.key")
def artifact_mget(spark, sf):
    found = _artifacts(spark, sf)
    asked = _artifact_requests(spark, sf).groupBy(F.floor(F.col("req") / 50).alias("r")).agg(F.transform(F.sort_array(F.collect_list(F.struct("req", "key"))), lambda x: x["key"]).alias("keys"))
    return A.mget(asked.withColumnRenamed("r", "req"), found, A.blobs(found))


@query(f"WITH {ARTIFACTS} SELECT 'EPOCH' AS mode, key FROM arts WHERE snapshot_epoch = 'ix3' UNION ALL SELECT 'MODEL', key FROM arts WHERE model_id = 'm1' UNION ALL SELECT 'PREFIX', key FROM arts WHERE starts_with(key, 'rag:src1')")
def invalidated_keys(spark, sf):
    found = _artifacts(spark, sf)
    one = lambda by, v: A.invalidated(found, by, v).select(F.lit(by).alias("mode"), "key")
    return one("EPOCH", "ix3").union(one("MODEL", "m1")).union(one("PREFIX", "rag:src1"))


@query(f"WITH {ARTIFACTS} SELECT blob_hash FROM arts GROUP BY blob_hash HAVING count(*) = count(*) FILTER (snapshot_epoch = 'ix3')")
def blobs_released(spark, sf):
    found = _artifacts(spark, sf)
    return A.after_invalidation(found, A.invalidated(found, "EPOCH", "ix3"))[1]


@query(f"WITH {ARTIFACTS} SELECT type, count(DISTINCT key) AS n FROM arts GROUP BY type")
def artifact_stats(spark, sf):
    return A.stats(_artifacts(spark, sf))


#: Keys live as long as their owner says, from the start of the log on; one blob in seven is gone before.
_LIVE = f"""{ARTIFACTS}, {_REQUESTS}, bl AS (SELECT DISTINCT blob_hash, size_bytes, CASE WHEN ends_with(blob_hash, '7') THEN 1000000 END AS until FROM arts),
z AS (SELECT r.req, r.key, a.size_bytes, a.key IS NOT NULL AND a.ttl_ms > r.req * 60000 AS found, until IS NULL OR until > r.req * 60000 AS kept FROM r LEFT JOIN arts a ON r.key = a.key LEFT JOIN bl ON a.blob_hash = bl.blob_hash)"""


def _live_gets(spark, sf):
    found = _artifacts(spark, sf)
    content = A.blobs(found).withColumn("expires_ms", F.when(F.col("blob_hash").endswith("7"), F.lit(1_000_000).cast("long")))
    asked = _artifact_requests(spark, sf).withColumn("now_ms", F.col("req") * 60_000)
    return A.get_live(asked, found.withColumn("expires_ms", F.col("ttl_ms")), content)


@query(f"WITH {_LIVE} SELECT req, key, found AND kept AS hit, CASE WHEN found AND kept THEN CAST(size_bytes AS BIGINT) END AS payload_bytes, CAST(found AS INTEGER) + CAST(found AND kept AS INTEGER) AS engine_hits FROM z")
def artifact_get_live(spark, sf):
    return _live_gets(spark, sf)


@query(
    f"""WITH {_LIVE}, c AS (SELECT (SELECT count(*) FROM arts) AS p, (SELECT count(DISTINCT blob_hash) FROM arts) AS b, (SELECT count(*) FROM z) AS g, (SELECT count(*) FROM z WHERE found AND kept) AS h),
t AS (SELECT type, count(DISTINCT key) AS n FROM arts GROUP BY type)
SELECT 1 AS nr, 'puts:' || p AS line FROM c UNION ALL SELECT 2, 'gets:' || g FROM c UNION ALL SELECT 3, 'hits:' || h FROM c UNION ALL SELECT 4, 'misses:' || (g - h) FROM c
UNION ALL SELECT 5, 'dedup_hits:' || (p - b) FROM c UNION ALL SELECT 6, 'blob_count:' || b FROM c UNION ALL SELECT CAST(6 + row_number() OVER (ORDER BY type) AS INTEGER), 'type.' || type || ':' || n FROM t"""
)
def artifact_stats_report(spark, sf):
    return A.stats_lines(_artifacts(spark, sf), _live_gets(spark, sf))


@query(f"WITH {ARTIFACTS}, {_REQUESTS} SELECT key, hits FROM (SELECT a.key, count(r.req) AS hits FROM arts a LEFT JOIN r ON a.key = r.key GROUP BY a.key) ORDER BY hits DESC, key LIMIT 10")
def artifacts_hot(spark, sf):
    used = _artifact_requests(spark, sf).groupBy("key").agg(F.count("*").alias("n"))
    return A.top(_artifacts(spark, sf).join(used, "key", "left").withColumn("hits", F.coalesce("n", F.lit(0))), "hits")


@query(f"WITH {ARTIFACTS} SELECT key, CAST(miss_cost AS DOUBLE) AS miss_cost FROM arts ORDER BY miss_cost DESC, key LIMIT 10")
def artifacts_costly(spark, sf):
    return A.top(_artifacts(spark, sf), "miss_cost")


@query(f"WITH {ARTIFACTS}, {_REQUESTS} SELECT DISTINCT r.key, CASE WHEN a.key IS NULL THEN 'MISS:no metadata' ELSE 'admit:score>threshold owner=' || owner || ' type=' || type END AS explain FROM r LEFT JOIN arts a ON r.key = a.key")
def artifact_explain(spark, sf):
    return A.explained(_artifact_requests(spark, sf).select("key").distinct(), _artifacts(spark, sf))


# --- log store ---

_SEGMENTS = f"{LOG}, seg AS (SELECT seq // 1000 AS segment_id, seq, key, cmd = 'DEL' AS tombstone, coalesce(ts_ms + ttl_ms, -1) AS ttl_epoch_ms, coalesce(size_bytes, 0) AS len FROM log WHERE cmd <> 'GET'), won AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM seg), lv AS (SELECT * FROM won WHERE rn = 1 AND NOT tombstone AND (ttl_epoch_ms < 0 OR ttl_epoch_ms > (SELECT max(ts_ms) FROM log)))"


def _segments(spark, sf):
    log = command_log(spark, sf).where("cmd <> 'GET'")
    return log.select(F.floor(F.col("seq") / 1000).alias("segment_id"), "seq", F.col("seq").alias("offset"), "key", (F.col("cmd") == "DEL").alias("tombstone"), F.coalesce("deadline_ms", F.lit(-1)).alias("ttl_epoch_ms"), F.coalesce("size_bytes", F.lit(0)).alias("len"))


@query(f"WITH {_SEGMENTS} SELECT segment_id, seq, key, tombstone, ttl_epoch_ms, len FROM won WHERE rn = 1")
def log_latest(spark, sf):
    from tidemark.operators.store import latest

    return latest(_segments(spark, sf)).drop("offset")


@query(f"WITH {_SEGMENTS} SELECT key, seq, len FROM lv")
def log_compacted(spark, sf):
    from tidemark.operators.store import live

    now = command_log(spark, sf).agg(F.max("ts_ms").alias("now_ms"))
    return live(_segments(spark, sf), now).select("key", "seq", "len")


@query(f"WITH {_SEGMENTS} SELECT CAST((SELECT sum(len) FROM lv) AS BIGINT) AS live_bytes, CAST(sum(len) AS BIGINT) AS total_bytes, round(1 - (SELECT sum(len) FROM lv) / sum(len), 6) AS fragmentation FROM seg")
def log_fragmentation(spark, sf):
    from tidemark.operators.store import fragmentation

    now = command_log(spark, sf).agg(F.max("ts_ms").alias("now_ms"))
    return fragmentation(_segments(spark, sf), now).withColumn("fragmentation", F.round("fragmentation", 6))


@query(f"WITH {SEEN} SELECT coalesce(r.key, s.key) AS key, CASE WHEN r.key IS NULL THEN 'ssd' ELSE 'ram' END AS tier FROM (SELECT key FROM state WHERE size_bytes < 2000) r FULL JOIN (SELECT key FROM entries WHERE size_bytes > 1000) s ON r.key = s.key")
def tier_union(spark, sf):
    log = command_log(spark, sf)
    ram = K.live_entries(log).where("size_bytes < 2000").select("key", "size_bytes")
    return K.tiers(ram, K.entries(log).where("size_bytes > 1000").select("key", "size_bytes")).select("key", "tier")


# --- protocol ---


@query(f"WITH {LOG} SELECT seq, CASE WHEN cmd = 'SET' THEN 3 ELSE 2 END AS n_args, cmd, key FROM log")
def protocol_roundtrip(spark, sf):
    """Commands encoded, cut every 37 bytes, and parsed again from the pieces."""
    from tidemark.sources.resp import encode_commands, parse_chunks, split_chunks

    log = command_log(spark, sf)
    args = F.when(F.col("cmd") == "SET", F.array("cmd", "key", F.col("size_bytes").cast("string"))).otherwise(F.array("cmd", "key"))
    chunks = split_chunks(encode_commands(log.select(F.floor(F.col("seq") / 500).alias("client"), "seq", args.alias("args"))), 37)
    parsed = parse_chunks(chunks)
    first = log.groupBy(F.floor(F.col("seq") / 500).alias("client")).agg(F.min("seq").alias("base"))
    text = lambda i: F.decode(F.get("args", F.lit(i)), "UTF-8")
    return parsed.join(first, "client").select((F.col("base") + F.col("n")).alias("seq"), F.size("args").alias("n_args"), text(0).alias("cmd"), text(1).alias("key"))


@query(
    f"""WITH {SEEN} SELECT seq, CASE cmd WHEN 'SET' THEN '+OK' || chr(13) || chr(10) WHEN 'DEL' THEN ':' || CAST(hit AS INTEGER) || chr(13) || chr(10)
    ELSE CASE WHEN hit THEN '$' || length(CAST(vsize AS VARCHAR)) || chr(13) || chr(10) || vsize || chr(13) || chr(10) ELSE '$-1' || chr(13) || chr(10) END END AS reply FROM reads"""
)
def command_replies(spark, sf):
    """What the server answers to every command; values are their sizes as text."""
    rows = K.versions(command_log(spark, sf)).withColumn("hit", K.hit())
    value = F.when(F.col("hit"), F.col("version.size_bytes").cast("string"))
    reply = F.when(F.col("cmd") == "SET", S.reply_simple(F.lit("OK"))).when(F.col("cmd") == "DEL", S.reply_integer(F.col("hit").cast("int"))).otherwise(S.reply_bulk(value))
    return rows.select("seq", reply.alias("reply"))


@query("SELECT event_id, upper(event_type) AS name, TRY_CAST(CASE WHEN regexp_full_match(a, '[0-9]+') THEN a END AS BIGINT) AS number FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN '-' || event_id WHEN event_id % 3 = 1 THEN '99999999999999999999' ELSE CAST(event_id AS VARCHAR) END AS a FROM events)")
def numeric_arguments(spark, sf):
    n = F.col("event_id").cast("string")
    arg = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("-"), n)).when(F.col("event_id") % 3 == 1, F.lit("9" * 20)).otherwise(n)
    return table(spark, sf, "events").select("event_id", F.upper("event_type").alias("name"), S.unsigned(arg).alias("number"))


# --- requests ---

#: Requests by event_id modulo their number: arguments ({} is the event's id), the answer to a refused one. None is a malformed request.
REQUESTS: list[tuple[list[str] | None, str | None]] = [
    (["PING"], None),
    (["ping", "extra"], None),
    (["SET", "k{}", "v{}"], None),
    (["SET", "k{}"], "SET key value [EX sec|PX ms] [OWNER name]"),
    (["set", "k{}", "v", "EX", "{}"], None),
    (["SET", "k{}", "v", "EX", "abc", "OWNER", "rag"], "invalid numeric argument"),
    (["SET", "k{}", "v", "px", "{}", "OWNER", "rag"], None),
    (["SET", "k{}", "v", "PX", "5", "EX", "7"], None),
    (["SET", "k{}", "v", "FOO", "1", "OWNER"], None),
    (["SET", "", "v"], None),
    (["GET"], "GET key"),
    (["MGET"], "MGET key [key...]"),
    (["DEL"], "DEL key [key...]"),
    (["EXPIRE", "k{}", "x"], "invalid numeric argument"),
    (["EXPIRE", "k{}"], "EXPIRE key seconds"),
    (["TTL", "k{}", "y"], "TTL key"),
    (["CONFIG", "GET", "policy"], None),
    (["CONFIG", "GET", "other"], "unsupported CONFIG GET"),
    (["CONFIG", "SET", "POLICY", "lfu"], None),
    (["CONFIG", "GET", "POLICY"], None),
    (["CONFIG", "SET", "POLICY", "unheard"], None),
    (["CONFIG", "SET", "POLICY"], "unsupported CONFIG SET"),
    (["CONFIG"], "CONFIG GET|SET"),
    (["AI.PUT", "prompt", "k{}"], "AI.PUT <type> <key> <meta_json> <payload_bytes>"),
    (["AI.EMB.PUT", "e{}", "m1", "64", "float", "{}", "bytes"], None),
    (["AI.EMB.PUT", "e{}", "m1", "64", "double", "10", "bytes"], "invalid vector header"),
    (["AI.EMB.PUT", "e{}", "m1", "-1", "float", "10", "bytes"], "invalid numeric argument"),
    (["AI.INVALIDATE", "SOME", "x"], "AI.INVALIDATE EPOCH|MODEL|PREFIX <value>"),
    (["AI.TOP", "HOT", "many"], "invalid numeric argument"),
    (["AI.TOP", "BEST"], "AI.TOP HOT|COSTLY [N]"),
    (["AI.GET"], "AI.GET <key>"),
    (["AI.EXPLAIN", "a", "b"], "AI.EXPLAIN <key>"),
    (["FLUSH", "k{}"], "unknown command"),
    ([], "empty command"),
    (None, "malformed RESP"),
]


def _requests(spark, sf):
    """seq, args of one request for each event."""
    n = F.col("event_id").cast("string")
    found = F.lit(None).cast("array<string>")
    for i, (args, _) in enumerate(REQUESTS):
        if args is not None:
            made = F.array(*(n if a == "{}" else F.concat(F.lit(a.replace("{}", "")), n) if "{}" in a else F.lit(a) for a in args)).cast("array<string>")
            found = F.when(F.col("event_id") % len(REQUESTS) == i, made).otherwise(found)
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), found.alias("args"))


_CASE = f"event_id % {len(REQUESTS)}"
_ERRORS = f"CASE {_CASE} " + " ".join(f"WHEN {i} THEN '{e}'" for i, (_, e) in enumerate(REQUESTS) if e) + " END"
_NAMES = f"CASE {_CASE} " + " ".join(f"WHEN {i} THEN '{a[0].upper()}'" for i, (a, _) in enumerate(REQUESTS) if a) + " END"
_CRLF = "chr(13) || chr(10)"


@query(f"SELECT event_id AS seq, {_NAMES} AS command, {_ERRORS} AS error, CASE WHEN {_CASE} < 2 THEN '+PONG' || {_CRLF} WHEN {_CASE} IN (18, 20) THEN '+OK' || {_CRLF} WHEN {_ERRORS} IS NOT NULL THEN '-ERR ' || ({_ERRORS}) || {_CRLF} END AS reply FROM events")
def request_dispatch(spark, sf):
    return C.dispatched(_requests(spark, sf)).select("seq", "command", "error", "reply")


@query(
    f"""SELECT event_id AS seq, CASE {_CASE} WHEN 9 THEN '' ELSE 'k' || event_id END AS key, CAST(CASE {_CASE} WHEN 2 THEN 1 + length(CAST(event_id AS VARCHAR)) ELSE 1 END AS BIGINT) AS size_bytes,
CAST(CASE {_CASE} WHEN 4 THEN event_id * 1000 WHEN 6 THEN event_id WHEN 7 THEN 7000 END AS BIGINT) AS ttl_ms, CASE {_CASE} WHEN 6 THEN 'rag' ELSE 'default' END AS owner,
CASE {_CASE} WHEN 9 THEN 'invalid key length' END AS error FROM events WHERE {_CASE} IN (2, 4, 6, 7, 8, 9)"""
)
def set_options(spark, sf):
    return C.writes(_requests(spark, sf)).drop("value")


@query(f"""SELECT event_id AS seq, 'e' || event_id AS key, '{{"artifact_type":"embedding","owner":"vector","schema_version":"v1","model_id":"m1","dim":64,"dtype":"float","ttl_deadline":' || (event_id * 1000) || '}}' AS meta_json, 'bytes' AS payload FROM events WHERE {_CASE} = 24""")
def vector_puts(spark, sf):
    return C.vector_puts(_requests(spark, sf))


@query(
    f"""WITH c AS (SELECT event_id AS seq, {_CASE} AS i, last_value(CASE {_CASE} WHEN 18 THEN 'lfu' WHEN 20 THEN 'cost' END IGNORE NULLS) OVER (ORDER BY event_id) AS p FROM events)
SELECT seq, coalesce(p, 'cost') AS policy, '*2' || {_CRLF} || '$6' || {_CRLF} || 'policy' || {_CRLF} || '$' || length(coalesce(p, 'cost')) || {_CRLF} || coalesce(p, 'cost') || {_CRLF} AS reply FROM c WHERE i IN (16, 19)"""
)
def config_policy(spark, sf):
    return C.policy_in_force(_requests(spark, sf))


@query(f"SELECT count(*) AS request_count, count(*) FILTER ({_ERRORS} IS NOT NULL OR {_CASE} = 9) AS rejected_requests FROM events")
def rejected_requests(spark, sf):
    return C.request_counters(_requests(spark, sf))


# --- ticks and the second tier ---


@query(f"WITH {LOG}, w AS (SELECT seq, key, cmd, lag(cmd) OVER (PARTITION BY key ORDER BY seq) AS before FROM log WHERE cmd <> 'GET') SELECT seq, key, CAST(coalesce(before = 'SET', false) AS BIGINT) AS removed FROM w WHERE cmd = 'DEL'")
def ssd_del_removed(spark, sf):
    """What DEL counts in the second tier, whose index ignores deadlines."""
    return K.deletes(command_log(spark, sf), indexed=True)


_QUEUE = f"{LOG}, q AS (SELECT seq, ts_ms // 3600000 AS tick, row_number() OVER (ORDER BY seq) - 1 AS k FROM log WHERE cmd = 'SET'), s AS (SELECT seq, tick, (max(tick * 4 - k) OVER (ORDER BY seq) + k) // 4 AS served FROM q)"


def _queue(spark, sf):
    sets = command_log(spark, sf).where("cmd = 'SET'")
    return T.served(sets.select("seq", F.floor(F.col("ts_ms") / 3_600_000).alias("tick")), 4, slice_rows=1000)


@query(f"WITH {_QUEUE} SELECT seq, tick, CAST(served AS BIGINT) AS served FROM s")
def tier_work_served(spark, sf):
    """In which hour a queue with a budget of four an hour comes to each write."""
    return _queue(spark, sf)


@query(f"WITH {_QUEUE}, t AS (SELECT DISTINCT tick FROM s) SELECT tick, (SELECT count(*) FROM s WHERE s.tick <= t.tick AND s.served > t.tick) AS tier_backlog FROM t")
def tier_backlog(spark, sf):
    return T.backlog(_queue(spark, sf))


@query(f"WITH {SEEN} SELECT key, deadline_ms FROM entries WHERE deadline_ms <= (SELECT max(ts_ms) FROM log) ORDER BY deadline_ms, key LIMIT 8")
def ssd_expired_first(spark, sf):
    """What one tick with a budget of eight drops from the second tier's index."""
    log = command_log(spark, sf)
    index = K.entries(log).join(F.broadcast(K.as_of(log)))
    return T.expired_first(index, F.col("as_of_ms"), 8).select("key", "deadline_ms")


@query(f"WITH {SEEN}, u AS (SELECT CAST(sum(size_bytes) AS BIGINT) AS used FROM state) SELECT key, used FROM u, (SELECT key FROM state ORDER BY last_access_ms, key LIMIT 1) WHERE used / 1000.0 >= 0.9")
def demotion_victim(spark, sf):
    """The one entry that a tick queues for the second tier, if memory is under pressure with a limit of 1000 bytes."""
    state = _state(spark, sf)
    used = state.agg(F.sum("size_bytes").alias("used")).where(T.demotion_due(F.col("used"), F.lit(1000)))
    return P.next_victim(state, "lru").select("key").join(F.broadcast(used))


@query(f"WITH {LOG}, w AS (SELECT seq, ts_ms, row_number() OVER (PARTITION BY ts_ms // 1000 ORDER BY seq) AS nth FROM log WHERE cmd <> 'GET') SELECT mode, seq FROM w, (SELECT unnest(['never', 'everysec', 'always']) AS mode) WHERE mode = 'always' OR (mode = 'everysec' AND nth = 1)")
def durability_syncs(spark, sf):
    appends = command_log(spark, sf).where("cmd <> 'GET'").select("seq", "ts_ms")
    one = lambda m: T.synced(appends, m).select(F.lit(m).alias("mode"), "seq")
    return one("never").union(one("everysec")).union(one("always"))


# --- tuning and benchmarks ---


@query(
    f"""WITH {SEEN}, m AS (SELECT owner, avg(CAST(NOT hit AS INTEGER)) AS miss, avg(vsize) FILTER (hit) AS size FROM reads WHERE cmd = 'GET' GROUP BY owner)
SELECT owner, round(1 + 5 * miss, 4) AS w_miss, round(greatest(0.1, least(10.0, coalesce(size, 1024) / 8192)), 4) AS w_mem, 1.0 AS w_reuse, 1.0 AS w_risk FROM m"""
)
def tuner_weights(spark, sf):
    miss = K.reads(command_log(spark, sf)).groupBy("owner").agg(F.avg((~F.col("hit")).cast("double")).alias("miss_rate"), F.avg("size_bytes").alias("avg_size_bytes"))
    return M.tuned(miss, "owner")


@query(
    f"""WITH {SEEN}, m AS (SELECT owner, avg(CAST(NOT hit AS INTEGER)) AS miss FROM reads WHERE cmd = 'GET' GROUP BY owner)
SELECT owner, 'tuner-v1' AS version, round(1 + 5 * miss, 4) AS w_miss, 0.85 AS evict_pressure, 50000 AS max_evictions, 0.7 AS premium_prior, 1000.0 AS w_risk_most FROM m"""
)
def tuner_output(spark, sf):
    """The tuner's file for each owner, read back by its members."""
    from tidemark.sources.files import tuned_json

    miss = K.reads(command_log(spark, sf)).groupBy("owner").agg(F.avg((~F.col("hit")).cast("double")).alias("miss_rate"), F.lit(1024.0).alias("avg_size_bytes"))
    texts = tuned_json(M.tuned(miss, "owner"), "owner")
    member = lambda path, kind: F.get_json_object("value", f"$.{path}").cast(kind)
    return texts.select("owner", member("version", "string").alias("version"), member("weights.w_miss", "double").alias("w_miss"), member("thresholds.evict_pressure", "double").alias("evict_pressure"), member("guardrails.max_evictions_per_second", "int").alias("max_evictions"), member("per_owner_priors.premium.p_reuse_prior", "double").alias("premium_prior"), member("ranges.w_risk[1]", "double").alias("w_risk_most"))


@query("SELECT event_id, greatest(0.0, least(1000.0, value - 100)) AS w_mem, greatest(0.1, least(1.0, value / 300)) AS evict_pressure FROM events")
def params_clamped(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", S.clamp("w_mem", v - 100, F.lit(1.0)).alias("w_mem"), S.clamp("evict_pressure", v / 300, F.lit(0.8)).alias("evict_pressure"))


@query(
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (i = floor(0.95 * (n - 1))) AS p95, max(value) FILTER (i = floor(0.99 * (n - 1))) AS p99, max(value) FILTER (i = floor(0.999 * (n - 1))) AS p999 FROM s GROUP BY 1"""
)
def latency_percentiles(spark, sf):
    return M.lower_percentiles(table(spark, sf, "events"), "value", "event_type", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999})


@query("SELECT round(avg(octet_length(encode(props))), 6) AS avg_request_bytes FROM events")
def average_request_bytes(spark, sf):
    rows = table(spark, sf, "events").select(F.octet_length("props").alias("bytes"))
    return M.average_request_bytes(rows).select(F.round("avg_request_bytes", 6).alias("avg_request_bytes"))


@query()
def bench_workloads(spark, sf):
    from tidemark.sources.generators import workload

    found = [workload(spark, n, 20_000, 5_000).groupBy(F.lit(n).alias("workload"), "cmd").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys")) for n in ("hotset", "uniform", "writeheavy", "mixed", "ttlheavy", "pipeline")]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _replay(spark, sf, policy):
    from tidemark.operators.replay import replay

    return replay(command_log(spark, sf), policy, memory_limit=40_000, shards=1)


@query()
def replay_lru(spark, sf):
    return _replay(spark, sf, "lru")


@query()
def replay_lfu(spark, sf):
    return _replay(spark, sf, "lfu")


@query()
def replay_cost(spark, sf):
    return _replay(spark, sf, "cost")


@query(
    f"""WITH RECURSIVE {LOG}, q AS (SELECT owner, seq, ts_ms, CAST(size_bytes AS DOUBLE) AS n, row_number() OVER (PARTITION BY owner ORDER BY seq) AS k FROM log WHERE cmd = 'SET'),
r AS (SELECT owner, k, seq, ts_ms, CASE WHEN n <= 1 THEN 1 - n ELSE CAST(1 AS DOUBLE) END AS left_, n <= 1 AS allowed FROM q WHERE k = 1
    UNION ALL SELECT q.owner, q.k, q.seq, q.ts_ms, t.t - CASE WHEN q.n <= t.t THEN q.n ELSE CAST(0 AS DOUBLE) END, q.n <= t.t
    FROM r JOIN q ON q.owner = r.owner AND q.k = r.k + 1, LATERAL (SELECT least(CAST(1 AS DOUBLE), r.left_ + (q.ts_ms - r.ts_ms) / CAST(1000 AS DOUBLE)) AS t) AS t)
SELECT owner AS bucket, seq, allowed FROM r"""
)
def replay_token_bucket(spark, sf):
    from tidemark.operators.replay import token_bucket

    return token_bucket(command_log(spark, sf).where("cmd = 'SET'"), bytes_per_second=1.0)


@query(f"WITH {SEEN} SELECT key, seq, cmd, CASE WHEN cmd <> 'SET' THEN hit END AS hit, false AS expired FROM reads")
def stream_ttl_state(spark, sf):
    from tidemark.streaming.state import run_available

    return run_available(spark, sf)
