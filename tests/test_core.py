"""Literals and folds for the parts of the cache model."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.model import CacheConfig, PolicyParams
from tidemark.operators import artifacts as A
from tidemark.operators import metrics as M
from tidemark.operators import policies as P
from tidemark.operators import state as K
from tidemark.operators import store
from tidemark.operators.replay import Cache, _benefit, _by_shard, counters, fold, replay, token_bucket
from tidemark.sources import files, segments
from tidemark.sources.generators import artifact_workload, workload
from tidemark.sources.resp import MALFORMED, Parser

LOG = "seq long, ts_ms long, key string, cmd string, size_bytes long, ttl_ms long, owner string, deadline_ms long"


def log_of(spark, rows):
    return spark.createDataFrame([(i, ts, k, c, n, ttl, o, None if ttl is None else ts + ttl) for i, (ts, k, c, n, ttl, o) in enumerate(rows)], LOG)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_keys(spark):
    x = F.lit
    assert one(spark, S.embedding_key(x("m"), x("h"), x(3), x("float"))) == "emb:m:h:3:float"
    assert one(spark, S.prompt_key(x("t"), x(None))) == "prm:t:"
    assert one(spark, S.rag_key(x("s"), x("c"), x("r"))) == "rag:s:c:r"
    assert one(spark, S.rerank_key(x("q"), x("e"), x(5), x("p"))) == "rrk:q:e:5:p"
    assert one(spark, S.response_key(x("p"), x("q"), x("m"))) == "rsp:p:q:m"


@pytest.mark.parametrize(("size", "want"), [(0, 64), (64, 64), (65, 128), (1024, 1024), (1025, 1536), (4096, 4096), (4097, 8192)])
def test_size_class(spark, size, want):
    assert one(spark, S.size_class(F.lit(size))) == want


def test_content_hash_follows_the_byte_loop(spark):
    texts = ["", "a", "hello", "é" * 40]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(S.content_hash(F.col("t")).alias("h")).collect()]

    def loop(b):
        h = 1469598103934665603
        for x in b:
            h = (h ^ x) * 1099511628211 % 2**64
        return format(h, "x")

    assert got == [loop(t.encode()) for t in texts]


def test_limits_and_defaults(spark):
    assert one(spark, S.write_error(F.lit(""), F.lit(1))) == "invalid key length"
    assert one(spark, S.write_error(F.lit("k" * 256), F.lit(1 << 20))) is None
    assert one(spark, S.write_error(F.lit("k"), F.lit((1 << 20) + 1))) == "value too large"
    assert one(spark, S.owner_or_default(F.lit(""))) == "default"
    assert (one(spark, S.owner_miss_cost(F.lit("vector"))), one(spark, S.owner_miss_cost(F.lit("none")))) == (8.0, 1.0)
    assert (one(spark, S.owner_ttl_ms(F.lit("rerank"))), one(spark, S.owner_ttl_ms(F.lit(None).cast("string")))) == (300_000, 3_600_000)
    assert [one(spark, S.unsigned(F.lit(a))) for a in ("12", "-1", "x", "9" * 30)] == [12, None, None, None]


def test_ttl_reads_and_reset(spark):
    rows = [(0, "ex", "SET", 1, 1200, "default"), (0, "px", "SET", 1, 100, "default"), (150, "px", "GET", None, None, "default"), (150, "ex", "GET", None, None, "default"), (160, "px", "SET", 2, None, "default"), (900, "px", "GET", None, None, "default"), (950, "px", "DEL", None, None, "default"), (960, "px", "GET", None, None, "default")]
    for slice_rows in (1, 3, 1 << 20):
        log = log_of(spark, rows)
        seen = K.versions(log, slice_rows).where("cmd = 'GET'").withColumn("hit", K.hit()).orderBy("seq").collect()
        assert [r.hit for r in seen] == [False, True, True, False]
    assert [(r.key, r.hit_count, r.last_access_ms) for r in K.live_entries(log_of(spark, rows)).collect()] == [("ex", 1, 150)]
    assert [r.removed for r in K.deletes(log_of(spark, rows)).collect()] == [1]


def test_ordered_reads_keep_repeats(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "key string, size_bytes long")
    got = K.mget(spark.createDataFrame([(7, ["b", "x", "b"])], "req long, keys array<string>"), state).orderBy("position").collect()
    assert [(r.key, r.size_bytes) for r in got] == [("b", 2), ("x", None), ("b", 2)]


def test_top_hits_and_info(spark):
    rows = [(i, k, "SET", 8, None, "default") for i, k in enumerate("xyz")] + [(5, "y", "GET", None, None, "default"), (6, "z", "GET", None, None, "default"), (7, "z", "GET", None, None, "default")]
    log = log_of(spark, rows)
    assert M.top_hits(K.live_entries(log)).first()[0] == "z:2,y:1,x:0"
    lines = M.info(log, K.live_entries(log), counters(log, "lfu", 2048), 2048, "lfu", "v").orderBy("line").collect()
    assert len(lines) == 26 and lines[0]["value"] == "lfu" and lines[-1]["value"] == "z:2,y:1,x:0"


def test_victims_free_until_the_rest_fits(spark):
    state = spark.createDataFrame([(k, "default", 40, 0, t, 1000) for t, k in enumerate("abc")], "key string, owner string, size_bytes long, hit_count long, last_access_ms long, as_of_ms long")
    for policy in ("lru", "lfu", "cost"):
        assert [r.key for r in P.victims(state, policy, F.lit(96)).collect()] == ["a"]
        assert P.next_victim(state, policy).first()["key"] == "a"
    with pytest.raises(ValueError):
        P.victim_order("other")


def test_running_sum_over_pieces_equals_one_window(spark, monkeypatch):
    rng = random.Random(3)
    state = spark.createDataFrame([(f"k{i}", "default", rng.randint(1, 90), rng.randint(0, 3), rng.randint(0, 50), 1000) for i in range(200)], "key string, owner string, size_bytes long, hit_count long, last_access_ms long, as_of_ms long")
    whole = {p: P.victims(state, p, F.lit(3000)).orderBy("key").collect() for p in ("lru", "lfu", "cost")}
    monkeypatch.setattr(P, "SLICE", 17)
    assert all(P.victims(state, p, F.lit(3000)).orderBy("key").collect() == rows and rows for p, rows in whole.items())


def test_quota(spark):
    state = spark.createDataFrame([("a", "default", 10)], "key string, owner string, size_bytes long")
    writes = spark.createDataFrame([("b", "default", 32), ("a", "default", 16), ("c", "rag", 16)], "key string, owner string, size_bytes long")
    assert [r.key for r in P.quota_rejections(state, writes, 16).collect()] == ["b"]


def test_artifacts(spark):
    puts = spark.createDataFrame([("prompt", "k1", "prompt", "m", "ep1", "data"), ("prompt", "k2", "prompt", "m", "ep1", "data"), ("response", "rsp:1", "response", "m2", "e2", "same"), ("response", "rsp:2", "response", "m3", "e3", "same")], "type string, key string, owner string, model_id string, snapshot_epoch string, payload string")
    arts = A.with_defaults(puts)
    assert A.dedup_hits(arts).where("type = 'prompt'").first()["dedup_hits"] == 1
    gone = A.invalidated(arts, "EPOCH", "e2")
    stay, released = A.after_invalidation(arts, gone)
    assert gone.count() == 1 and released.count() == 0 and stay.where("key = 'rsp:2'").count() == 1
    assert A.invalidated(stay, "MODEL", "m3").count() == 1
    assert A.invalidated(arts, "PREFIX", "").count() == 0 and A.invalidated(arts, "PREFIX", "k" * 33, compat=True).count() == 0 and A.invalidated(arts, "PREFIX", "rsp:").count() == 2
    asked = spark.createDataFrame([("k1",), ("no",)], "key string")
    assert {r.key: r.explain for r in A.explained(asked, arts).collect()} == {"k1": "admit:score>threshold owner=prompt type=prompt", "no": "MISS:no metadata"}


def test_metadata(spark):
    texts = ['{"artifact_type":"prompt","owner":"o"}', '{"artifact_type":"prompt","owner":"o","schema_version":"1","miss_cost":2.5,"ttl_deadline":70}', '{"artifact_type":"rag_chunk","owner":"o","schema_version":"1"}', None]
    rows = A.parsed_meta(spark.createDataFrame([("prompt", t) for t in texts], "type string, meta_json string")).collect()
    assert [r.error for r in rows] == ["missing required metadata fields", None, "artifact type mismatch", "missing required metadata fields"]
    assert (rows[1].m_miss_cost, rows[1].m_ttl_ms) == (2.5, 70)


def test_parser():
    p = Parser()
    p.feed(b"*1\r\n$4\r\nPI")
    assert p.next_command() is None
    p.feed(b"NG\r\n")
    assert p.next_command() == [b"PING"] and p.next_command() is None
    p.feed(b"hello\r\n*1\r\n$-5\r\n*1\r\n$1048576\r\n" + b"x" * 1048576 + b"\r\n*2000\r\n")
    assert [p.next_command() for _ in range(4)] == [[MALFORMED], [MALFORMED], [b"x" * 1048576], [MALFORMED]]


def test_percentiles_take_the_lower_rank(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(10)] + [("h", 5.0)], "g string, v double")
    got = {r.g: (r.p50, r.p99) for r in M.lower_percentiles(df, "v", "g", {"p50": 0.5, "p99": 0.99}).collect()}
    assert got == {"g": (4.0, 8.0), "h": (5.0, 5.0)}


def test_params_and_reports(spark, tmp_path):
    good = tmp_path / "params.json"
    good.write_text('{"w_mem": -9999, "evict_pressure": 99, "max_admissions_per_second": 0, "version": "v-test"}')
    p = files.load_params(spark, str(good))
    assert (p.w_mem, p.evict_pressure, p.max_admissions_per_second, p.version, p.w_miss) == (0.0, 1.0, 1, "v-test", 1.0)
    bad = tmp_path / "bad.txt"
    bad.write_text("not-json")
    with pytest.raises(ValueError):
        files.load_params(spark, str(bad), p)
    snap = tmp_path / "snap.json"
    snap.write_text('{"miss_rate": 0.5}')
    row = M.tuned(files.load_snapshot(spark, str(snap))).first()
    assert (row.w_miss, row.w_mem) == (3.5, 0.125)
    files.save_tuned(M.tuned(files.load_snapshot(spark, str(snap))), str(tmp_path / "out"))
    report = files.parse_report(spark.createDataFrame([("hits:3\nhits:4\nname:a:b\n",)], "report string")).first()["values"]
    assert report == {"hits": "3", "name": "a:b"}


def test_tuned_file(spark):
    import json

    from pyspark.sql import functions as F

    snapshot = spark.range(1).select(F.lit(0.2).alias("miss_rate"), F.lit(4096.0).alias("avg_size_bytes"))
    got = json.loads(files.tuned_json(M.tuned(snapshot)).first()["value"])
    assert got["version"] == "tuner-v1" and got["weights"] == {"w_miss": 2.0, "w_reuse": 1.0, "w_mem": 0.5, "w_risk": 1.0}
    assert got["thresholds"] == {"admit_threshold": 0.0, "evict_pressure": 0.85} and got["ranges"]["evict_pressure"] == [0.1, 1.0] and got["per_owner_priors"]["premium"] == {"p_reuse_prior": 0.7}


def test_segments_recover_to_the_first_bad_record(spark, tmp_path):
    data = b"".join(segments.pack(i, f"k{i % 3}".encode(), b"v" * i, tombstone=i == 5) for i in range(8))
    (tmp_path / "segment_1.log").write_bytes(data)
    (tmp_path / "segment_2.log").write_bytes(data[:-1])
    broken = bytearray(segments.pack(9, b"k9", b"value"))
    broken[-1] ^= 1
    (tmp_path / "segment_3.log").write_bytes(bytes(broken))
    got = segments.read_segments(spark, str(tmp_path))
    assert {r.segment_id: r.n for r in got.groupBy("segment_id").agg(F.count("*").alias("n")).collect()} == {1: 8, 2: 7}
    now = spark.createDataFrame([(0,)], "now_ms long")
    assert {r.key: r.seq for r in store.live(got, now).collect()} == {"k0": 6, "k1": 7}
    (tmp_path / "MANIFEST").write_text("segment=1\nsegment=2\nactive=2\nnoise\n")
    assert {r.segment_id: r.active for r in segments.read_manifest(spark, str(tmp_path / "MANIFEST")).collect()} == {1: False, 2: True}
    assert store.compact(got, now, str(tmp_path / "new"), 0.1) and spark.read.parquet(str(tmp_path / "new")).count() == 2


def test_cache_rules():
    c = Cache(CacheConfig(policy="cost", memory_limit_bytes=96, max_value_bytes=1024, params=PolicyParams()))
    assert [c.set(k, 40, "default", None, 0)[0] for k in "abc"] == ["ok"] * 3 and c.used <= 96
    q = Cache(CacheConfig(policy="lru", params=PolicyParams(owner_cap_bytes=16)))
    assert q.set("a", 32, "", None, 0)[0] == "rejected"
    t = Cache(CacheConfig(policy="lru", ttl_cleanup_per_tick=8))
    for i in range(32):
        t.set(f"k{i}", 1, "default", 1, 0)
    assert t.tick(5) == 8
    s = Cache(CacheConfig(policy="lru", ssd_enabled=True, ssd_value_min_bytes=64, memory_limit_bytes=50))
    s.set("big", 128, "default", None, 0)
    s.set("x", 40, "default", None, 1)
    s.set("y", 40, "default", None, 2)
    assert set(s.ssd) == {"big"} and list(s.demote) == ["x"]
    s.tick(2)
    assert set(s.ssd) == {"big", "x"} and set(s.ram) == {"y"} and s.stats["demotions"] == s.stats["evictions"] == 1
    assert [s.get("x", i) for i in range(2, 5)] == ["hit"] * 3 and list(s.promote) == ["x"]
    assert s.get("big", 9) == "hit" and set(s.ram) == {"x"} and set(s.ssd) == {"big", "y"} and s.stats["promotions"] == 1


def test_second_tier_ends_and_budgets():
    c = Cache(CacheConfig(policy="lru", ssd_enabled=True, ssd_value_min_bytes=10, ttl_cleanup_per_tick=2, ssd_max_bytes=100))
    for i in range(5):
        assert c.set(f"k{i}", 20, "default", 10, 0) == ("ok", 0)
    assert c.set("more", 20, "default", None, 0)[0] == "rejected" and c.ssd_used == 100
    assert c.get("k4", 20) == "miss" and len(c.ssd) == 3 and c.expire("k4", 90, 20) == "absent" and len(c.ssd) == 1
    assert c.set("a", 20, "default", None, 30) == ("ok", 0) and c.left("a", 30) == "-1" and c.expire("a", 5030, 31) == "moved" and c.left("a", 31) == "4" and c.left("b", 31) == "-2"
    slow = Cache(CacheConfig(policy="lru", ssd_enabled=True, ssd_value_min_bytes=10, ssd_write_mb_per_s=30 / 2**20))
    assert [slow.set(f"k{i}", 20, "default", None, t)[0] for i, t in enumerate((0, 0, 1000))] == ["ok", "rejected", "ok"]
    e = Cache(CacheConfig(policy="lru"))
    rows = [(1, 0, "a", "SET", 5, "o", None), (2, 1, "a", "EXPIRE", None, None, 50), (3, 2, "a", "TTL", None, None, None), (4, 60, "a", "GET", None, None, None), (5, 61, "a", "EXPIRE", None, None, 99)]
    assert [(r[1], r[3]) for r in fold(iter(rows), e)] == [("ok", 0), ("moved", 0), ("0", 0), ("miss", 1), ("absent", 0)]


def test_victims_by_cost_are_the_least_worth_of_all_but_few_are_looked_at(monkeypatch):
    """Against a look at every entry, also while time goes back or reuse counts against an entry."""
    from tidemark.operators import replay as module

    for reuse in (1.0, 3.0, -0.5):
        rng, looked = random.Random(8), []
        params = PolicyParams(w_reuse=reuse, admit_threshold=-1e9)
        c = Cache(CacheConfig(policy="cost", memory_limit_bytes=60_000, params=params))
        monkeypatch.setattr(module, "_benefit", lambda *a: looked.append(0) or _benefit(*a))
        now, victims, held = 0, 0, 0
        for i in range(3000):
            now += rng.choice([5, 400, 90_000, -20_000])
            key = f"k{rng.randrange(800)}"
            if rng.random() < 0.6:
                c.set(key, rng.choice([64, 64, 100, rng.randrange(3000)]), "default", None if i % 3 else now + 500_000, now)
            elif rng.random() < 0.7:
                c.get(key, now)
            else:
                c.delete(key, now)
            if c.used >= 48_000:
                want = min(c.ram, key=lambda k: (_benefit(c.ram[k].size, c.ram[k].hits, now - c.ram[k].touched, 1.0, params), k))
                before, window = len(looked), dict(c.window)
                assert c._victim(now) == want
                c.window = window
                victims, held = victims + len(looked) - before, held + len(c.ram)
        assert [k for _, k in sorted(c.bounds, key=lambda b: b[1])] == sorted(c.ram)
        if reuse == 1.0:
            assert held > 10_000 and victims < held / 3


def test_replay_sorts_blocks_not_rows(spark):
    """The one task of a shard has a row for each block, and the order of the log whatever the order of its rows."""
    rows = [(i, i, f"k{i % 7}", "SET" if i % 3 else "GET", 5 if i % 3 else None, "rag", None) for i in range(25_000)]
    log = spark.createDataFrame(rows, "seq long, ts_ms long, key string, cmd string, size_bytes long, owner string, deadline_ms long").repartition(5, "ts_ms")
    assert _by_shard(log, 1).count() <= 25 and [r.nr for r in _by_shard(log.limit(0), 1).collect()] == []
    got = [(r.seq, r.outcome, r.memory_used) for r in replay(log, "lru", 1000).collect()]
    want = [(r[0], r[1], r[4]) for r in fold(iter(rows), Cache(CacheConfig(policy="lru", memory_limit_bytes=1000)))]
    assert got == want
    shards = {r.shard: r.n for r in replay(log, "lru", 1000, shards=3).groupBy("shard").agg({"seq": "count"}).toDF("shard", "n").collect()}
    assert sum(shards.values()) == 25_000 and len(shards) > 1


def test_replay_equals_the_fold_and_the_query(spark):
    rng = random.Random(5)
    rows = [(i * 10, f"k{rng.randint(0, 9)}", rng.choice(["SET", "GET", "GET", "DEL"]), rng.randint(1, 60), rng.choice([None, 50, 500]), "default") for i in range(400)]
    log = log_of(spark, rows)
    for policy in ("lru", "lfu", "cost"):
        got = [(r.seq, r.outcome, r.memory_used) for r in replay(log, policy, 200).orderBy("seq").collect()]
        plain = [(r.seq, r.ts_ms, r.key, r.cmd, r.size_bytes, r.owner, r.deadline_ms) for r in log.orderBy("seq").collect()]
        want = list(fold(iter(plain), Cache(CacheConfig(policy=policy, memory_limit_bytes=200))))
        assert got == [(x[0], x[1], x[4]) for x in want]
    # without a limit the fold is the query
    free = {r.seq: r.outcome == "hit" for r in replay(log, "lru", 1 << 30).where("outcome IN ('hit', 'miss')").collect()}
    assert free == {r.seq: r.hit for r in K.reads(log).collect()}


def test_token_bucket(spark):
    log = log_of(spark, [(0, "a", "SET", 60, None, "o"), (10, "b", "SET", 60, None, "o"), (700, "c", "SET", 60, None, "o"), (9000, "d", "SET", 101, None, "o")])
    assert [r.allowed for r in token_bucket(log, 100.0).orderBy("seq").collect()] == [True, False, True, False]


def test_workloads_repeat(spark):
    for name in ("hotset", "pipeline", "ttlheavy"):
        assert workload(spark, name, 100, 50).collect() == workload(spark, name, 100, 50).collect()
    assert artifact_workload(spark, "mixed_rag_pipeline", 10).count() == 50


def test_library_does_not_import_the_training_operators():
    import pathlib

    import tidemark

    top = pathlib.Path(tidemark.__file__).parent
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "tidemark.llm" in p.read_text()]


def test_start_up_options():
    from tidemark.model import configured

    config, others = configured(["x", "--memory", "1000", "--ssd-enabled", "--policy", "lru", "--policy", "lfu", "--port", "7000", "--demotion-pressure", "0.5", "--fsync"])
    assert (config.memory_limit_bytes, config.ssd_enabled, config.policy, config.demotion_pressure) == (1000, True, "lfu", 0.5)
    assert others == {"port": "7000"} and configured([]) == (CacheConfig(), {})


def test_reads_of_artifacts_need_a_live_key_and_a_live_blob(spark):
    keys = spark.createDataFrame([("a", "1", None), ("b", "1", 50), ("c", "2", None), ("d", "9", None)], "key string, blob_hash string, expires_ms long")
    content = spark.createDataFrame([("1", 7, None), ("2", 8, 100)], "blob_hash string, size_bytes long, expires_ms long")
    asked = spark.createDataFrame([(1, "a", 60), (2, "b", 49), (3, "b", 50), (4, "c", 99), (5, "c", 100), (6, "d", 0), (7, "e", 0), (8, None, 0)], "req long, key string, now_ms long")
    got = {r.req: (r.hit, r.payload_bytes, r.engine_hits) for r in A.get_live(asked, keys, content).collect()}
    assert got == {1: (True, 7, 2), 2: (True, 7, 2), 3: (False, None, 0), 4: (True, 8, 2), 5: (False, None, 1), 6: (False, None, 1), 7: (False, None, 0), 8: (False, None, 0)}


def test_report_of_an_empty_artifact_layer(spark):
    puts = spark.createDataFrame([], "key string, type string, blob_hash string")
    lines = A.stats_lines(puts, spark.createDataFrame([], "hit boolean")).orderBy("nr").collect()
    assert [r.line for r in lines] == ["puts:0", "gets:0", "hits:0", "misses:0", "dedup_hits:0", "blob_count:0"]


def test_parameters_are_reloaded_or_refused(spark, tmp_path):
    first = PolicyParams(w_mem=3.0)
    (tmp_path / "good.json").write_text('{"version": "v7", "w_miss": 2.5, "evict_pressure": 9}')
    (tmp_path / "bad.json").write_text("w_miss: 2.5")
    assert files.reload_params(spark, str(tmp_path / "none.json"), first) == (first, "params file not found")
    assert files.reload_params(spark, str(tmp_path / "bad.json"), first) == (first, "invalid schema")
    found, error = files.reload_params(spark, str(tmp_path / "good.json"), first)
    assert error is None and (found.version, found.w_miss, found.w_mem, found.evict_pressure) == ("v7", 2.5, 3.0, 1.0)
