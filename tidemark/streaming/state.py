"""Cache state on a stream of commands: one keyed state, ended by event-time timeouts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder, ship

OUT = "key string, seq long, cmd string, hit boolean, expired boolean"
STATE = "deadline long, present boolean, size long"


def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Applies a key's commands in order; a timeout ends its entry and says so once."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "seq": [None], "cmd": ["EXPIRED"], "hit": [None], "expired": [True]})
        return
    deadline, present, size = state.get if state.exists else (-1, False, 0)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, ts, cmd, n, ttl in zip(rows["seq"], rows["ts_ms"], rows["cmd"], rows["size_bytes"], rows["deadline_ms"], strict=True):
        if present and 0 <= deadline <= ts:
            present = False
        hit = None
        if cmd == "SET":
            present, size, deadline = True, int(n), -1 if pd.isna(ttl) else int(ttl)
        elif cmd == "DEL":
            hit, present = present, False
        else:
            hit = present
        out.append((key[0], int(seq), cmd, hit, False))
    if present:
        state.update((deadline, True, size))
        if deadline >= 0 and deadline > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(deadline)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["key", "seq", "cmd", "hit", "expired"])


def live_state(commands: DataFrame) -> DataFrame:
    """The outcome of every command of a stream with ts (timestamp) besides the log's columns."""
    ship(commands.sparkSession)
    rows = commands.withWatermark("ts", "0 seconds")
    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def command_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The ``events`` table as a stream of commands; files per trigger bound a batch."""
    from tidemark.sources.tables import OWNERS

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    kind, is_set = F.col("event_type"), F.col("event_type").isin("purchase", "signup")
    ts_ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    ttl = F.when(kind == "signup", (F.get_json_object("props", "$.k").cast("long") + 1) * 3_600_000)
    return e.select(
        F.timestamp_millis(ts_ms).alias("ts"),
        F.col("event_id").alias("seq"),
        ts_ms.alias("ts_ms"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.when(is_set, "SET").when(kind == "error", "DEL").otherwise("GET").alias("cmd"),
        F.when(is_set, F.floor(F.col("value") * 10) + 1).cast("long").alias("size_bytes"),
        F.get(F.array(*(F.lit(o) for o in OWNERS)), (F.col("user_id") % len(OWNERS)).cast("int")).alias("owner"),
        (ts_ms + ttl).alias("deadline_ms"),
    )


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is there now, through the stream: outcomes as a table in the shared folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = live_state(command_stream(spark, sf_dir)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out").where("NOT expired")


def windowed_counts(commands: DataFrame, width: str = "1 second") -> DataFrame:
    """Commands of each window of event time: the aligned form of rate windows, on a stream or a table."""
    return commands.withWatermark("ts", "0 seconds").groupBy(F.window("ts", width), "cmd").agg(F.count("*").alias("n"))
