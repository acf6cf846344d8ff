"""What the server makes of requests (seq, args: array of text) before it looks at any state.

Everything is an expression over ``args``: which command it is, whether its arguments are in order,
what a refused one is answered, and what the options of a SET say. A null ``args`` is a malformed request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

# Fewest and most arguments, the command itself included (None: any number), and the answer to others.
ARITY = {
    "PING": (1, None, ""),
    "SET": (3, None, "SET key value [EX sec|PX ms] [OWNER name]"),
    "GET": (2, 2, "GET key"),
    "MGET": (2, None, "MGET key [key...]"),
    "DEL": (2, None, "DEL key [key...]"),
    "EXPIRE": (3, 3, "EXPIRE key seconds"),
    "TTL": (2, 2, "TTL key"),
    "INFO": (1, None, ""),
    "CONFIG": (2, None, "CONFIG GET|SET"),
    "AI.PUT": (5, 5, "AI.PUT <type> <key> <meta_json> <payload_bytes>"),
    "AI.GET": (2, 2, "AI.GET <key>"),
    "AI.MGET": (2, None, "AI.MGET <key...>"),
    "AI.EMB.PUT": (7, 7, "AI.EMB.PUT <key> <model_id> <dim> <dtype> <ttl_sec> <vector_bytes>"),
    "AI.EMB.GET": (2, 2, "AI.EMB.GET <key>"),
    "AI.INVALIDATE": (3, 3, "AI.INVALIDATE EPOCH|MODEL|PREFIX <value>"),
    "AI.STATS": (1, None, ""),
    "AI.TOP": (2, None, "AI.TOP HOT|COSTLY [N]"),
    "AI.EXPLAIN": (2, 2, "AI.EXPLAIN <key>"),
}
DTYPES = ("float", "float16", "int8")
POLICIES = ("lru", "lfu", "cost")
BAD_NUMBER = "invalid numeric argument"
#: Requests whose policy changes a window takes together.
SLICE = 1 << 20


def arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def command() -> Column:
    """The command's name in upper case; null for an empty or malformed request."""
    return F.upper(arg(0))


def set_options() -> Column:
    """ttl_ms, owner and valid from the option pairs of a SET: the last of a kind counts, a bad number ends it, all else is passed over."""
    start = F.struct(F.lit(None).cast("bigint").alias("ttl_ms"), F.lit("default").alias("owner"), F.lit(True).alias("valid"))
    pairs = F.when(F.size("args") >= 5, F.sequence(F.lit(3), F.size("args") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, i: Column) -> Column:
        name, value = F.upper(F.get("args", i)), F.get("args", i + 1)
        number = S.unsigned(value)
        timed = name.isin("EX", "PX")
        ttl = F.when(name == "EX", F.try_multiply(number, F.lit(1000).cast("bigint"))).when(name == "PX", number).otherwise(s["ttl_ms"])
        after = F.struct(ttl.alias("ttl_ms"), F.when(name == "OWNER", value).otherwise(s["owner"]).alias("owner"), (~timed | number.isNotNull()).alias("valid"))
        return F.when(s["valid"], after).otherwise(s)

    return F.aggregate(pairs, start, step)


def config_error() -> Column:
    kind, what, n = F.upper(arg(1)), F.upper(arg(2)), F.size("args")
    asked = F.when((n == 3) & (what == "POLICY"), F.lit(None).cast("string")).otherwise("unsupported CONFIG GET")
    changed = F.when((n == 4) & what.isin("POLICY", "PARAMS"), F.lit(None).cast("string")).otherwise("unsupported CONFIG SET")
    return F.when(kind == "GET", asked).when(kind == "SET", changed).otherwise(ARITY["CONFIG"][2])


def error() -> Column:
    """Why a request is refused for its form; null if it is not."""
    n, name = F.size("args"), command()
    found = F.when(F.col("args").isNull(), "malformed RESP").when(n == 0, "empty command").when(~name.isin(*ARITY), "unknown command")
    for c, (least, most, usage) in ARITY.items():
        outside = n < least if most is None else ~n.between(least, most)
        found = found.when((name == c) & outside, usage)
    bad = lambda i: S.unsigned(arg(i)).isNull()
    found = found.when((name == "SET") & ~set_options()["valid"], BAD_NUMBER)
    found = found.when((name == "EXPIRE") & bad(2), BAD_NUMBER)
    found = found.when((name == "AI.EMB.PUT") & (bad(3) | bad(5)), BAD_NUMBER)
    found = found.when((name == "AI.EMB.PUT") & ~arg(4).isin(*DTYPES), "invalid vector header")
    found = found.when((name == "AI.INVALIDATE") & ~F.upper(arg(1)).isin("EPOCH", "MODEL", "PREFIX"), ARITY["AI.INVALIDATE"][2])
    found = found.when((name == "AI.TOP") & (n == 3) & bad(2), BAD_NUMBER)
    found = found.when((name == "AI.TOP") & ~F.upper(arg(1)).isin("HOT", "COSTLY"), ARITY["AI.TOP"][2])
    return found.when(name == "CONFIG", config_error())


def dispatched(requests: DataFrame) -> DataFrame:
    """``requests`` with command, error, and the reply where that needs no state."""
    rows = requests.withColumn("command", command()).withColumn("error", error())
    done = F.when(F.col("error").isNotNull(), S.reply_error(F.col("error"))).when(F.col("command") == "PING", S.reply_simple(F.lit("PONG")))
    return rows.withColumn("reply", done.when((F.col("command") == "CONFIG") & (F.upper(arg(1)) == "SET") & (F.upper(arg(2)) == "POLICY"), S.reply_simple(F.lit("OK"))))


def writes(requests: DataFrame) -> DataFrame:
    """seq, key, value, size_bytes, ttl_ms, owner of every SET that is in order, with the size guard's verdict (error)."""
    rows = dispatched(requests).where("command = 'SET' AND error IS NULL").withColumn("o", set_options())
    size = F.octet_length(arg(2)).cast("long")
    return rows.select("seq", arg(1).alias("key"), arg(2).alias("value"), size.alias("size_bytes"), F.col("o.ttl_ms").alias("ttl_ms"), S.owner_or_default(F.col("o.owner")).alias("owner"), S.write_error(arg(1), size).alias("error"))


def vector_puts(requests: DataFrame) -> DataFrame:
    """seq, key, meta_json, payload of every AI.EMB.PUT that is in order; a time to live of 0 is left to the owner's default."""
    rows = dispatched(requests).where("command = 'AI.EMB.PUT' AND error IS NULL")
    meta = F.concat(F.lit('{"artifact_type":"embedding","owner":"vector","schema_version":"v1","model_id":"'), arg(2), F.lit('","dim":'), S.unsigned(arg(3)).cast("string"), F.lit(',"dtype":"'), arg(4), F.lit('","ttl_deadline":'), (S.unsigned(arg(5)) * 1000).cast("string"), F.lit("}"))
    return rows.select("seq", arg(1).alias("key"), meta.alias("meta_json"), arg(6).alias("payload"))


def policy_in_force(requests: DataFrame, first: str = "cost", slice_rows: int = SLICE) -> DataFrame:
    """seq, policy, reply of every CONFIG GET POLICY: the policy that the last CONFIG SET POLICY before it named, an unknown name being cost.

    Changes are looked up within slices of seq, and between slices by one row for each.
    """
    rows = dispatched(requests).where("command = 'CONFIG' AND error IS NULL").withColumn("slice", F.floor(F.col("seq") / slice_rows))
    named = F.when((F.upper(arg(1)) == "SET") & (F.upper(arg(2)) == "POLICY"), F.when(arg(3).isin(*POLICIES), arg(3)).otherwise("cost"))
    rows = rows.select("seq", "slice", named.alias("named"), (F.upper(arg(1)) == "GET").alias("asked"))
    ends = rows.groupBy("slice").agg(F.max(F.when(F.col("named").isNotNull(), F.struct("seq", "named"))).alias("last"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select("slice", F.last("last", ignorenulls=True).over(before)["named"].alias("earlier"))
    within = Window.partitionBy("slice").orderBy("seq")
    found = rows.join(left, "slice").withColumn("policy", F.coalesce(F.last("named", ignorenulls=True).over(within), "earlier", F.lit(first)))
    return found.where("asked").select("seq", "policy", S.reply_array(F.array(S.reply_bulk(F.lit("policy")), S.reply_bulk(F.col("policy")))).alias("reply"))


def request_counters(requests: DataFrame) -> DataFrame:
    """request_count and rejected_requests, of requests refused for their form or their size."""
    refused = F.when(command() == "SET", S.write_error(arg(1), F.octet_length(arg(2)).cast("long")))
    return requests.agg(F.count("*").alias("request_count"), F.count_if(F.coalesce(error(), refused).isNotNull()).alias("rejected_requests"))
