"""Streams: session logs with compaction, telemetry windows, first images, and changed files."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import session
from ..sources.shared import shared_folder

LOG_STATE = "idx array<bigint>, role array<string>, name array<string>, content array<string>"
LOG_OUT = "session_id string, messages int, tokens bigint, compacted boolean, prompt string"


def _placeholder(name: str | None) -> str:
    return (name or "tool").join(session.PLACEHOLDER)


def compact_log(log: list[tuple], more: list[tuple], keep_recent: int, least_length: int, threshold: int, rate: float) -> tuple[list[tuple], bool]:
    """(the log, whether it became a summary) after `more` messages (idx, role, name, content), one by one: a tool result that is no longer
    among the last keep_recent becomes a placeholder if it has least_length characters, and at `threshold` tokens all of the log one summary. A
    message with role `reset` empties it. Each message is looked at once, the log again only for a summary."""
    log, compacted = list(log), False
    tools = deque([i for i, m in enumerate(log) if m[1] == "tool"][-keep_recent:] if keep_recent else [])
    tokens = sum(len(m[3]) // 4 for m in log)
    for m in more:
        if m[1] == "reset":
            log, tokens = [], 0
            tools.clear()
            continue
        log.append(m)
        tokens += len(m[3]) // 4
        if m[1] == "tool":
            tools.append(len(log) - 1)
            if len(tools) > keep_recent:
                old = tools.popleft()
                if len(log[old][3]) >= least_length:
                    note = _placeholder(log[old][2])
                    tokens += len(note) // 4 - len(log[old][3]) // 4
                    log[old] = (*log[old][:3], note)
        if tokens >= threshold:
            text = "\n".join(f"[{x[1] or 'unknown'}] {x[3]}" for x in log[-session.WINDOW_MESSAGES:] if x[3].strip())
            log = [(m[0], "system", None, session.SUMMARY_PREFIX + text[:int(len(text) * rate)])]
            tokens, compacted = len(log[0][3]) // 4, True
            tools.clear()
    return log, compacted


def session_log(messages: DataFrame, keep_recent: int = 3, least_length: int = 100, threshold: int = 4000, rate: float = 0.3, idle: str = "1 hour") -> DataFrame:
    """Streaming messages (session_id, idx, role, name, content) kept by session; every batch puts out the changed sessions.

    A session's state is bounded by the threshold: at that size it is one summary. Idle sessions end. A message with role
    `reset` empties its session. Messages of a batch go in idx order; a null content counts as empty. Idle timeouts always call for
    another batch: under an availableNow trigger, set spark.sql.streaming.noDataMicroBatches.enabled to false.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = [tuple(m) for m in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(frames)).sort_values("idx", kind="stable")
        more = [(int(i), role, name, content or "") for i, role, name, content in zip(rows["idx"], rows["role"], rows["name"], rows["content"], strict=True)]
        log, compacted = compact_log(log, more, keep_recent, least_length, threshold, rate)
        state.update(tuple([m[i] for m in log] for i in range(4)))
        state.setTimeoutDuration(wait)
        prompt = "\n".join(f"[{m[1]}] {m[3]}" for m in log)
        yield pd.DataFrame({"session_id": [key[0]], "messages": [len(log)], "tokens": [sum(len(m[3]) // 4 for m in log)], "compacted": [compacted], "prompt": [prompt]})

    return messages.groupBy("session_id").applyInPandasWithState(step, LOG_OUT, LOG_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def telemetry_windows(rows: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by window and processor; rows later than `late` are left out, windows come when they are final."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    w = rows.withWatermark("ts", late).groupBy(F.window("ts", size), "processor")
    out = w.agg(F.count("*").alias("count"), F.sum("token_count").alias("total_tokens"), F.avg("latency_ms").alias("avg_latency_ms"))
    return out.select(F.col("window.start").alias("start"), "processor", "count", "total_tokens", "avg_latency_ms")


def first_images(images: DataFrame, late: str = "1 day") -> DataFrame:
    """images (phash, ts, ...) without hashes seen in the last `late`; the state is bounded by it."""
    return images.withWatermark("ts", late).dropDuplicatesWithinWatermark(["phash"])


def sync_files(files: DataFrame, read_seen: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Start a stream of files (path, content): each batch passes on the files whose md5 is not in read_seen() (path, md5). It takes what is there
    and ends (for a sync before a search or a session), or looks again at an interval, such as `10 minutes`."""
    def batch(df: DataFrame, number: int) -> None:
        new = df.withColumn("md5", F.md5(F.col("content").cast("binary"))).dropDuplicates(["path", "md5"])
        apply(new.join(read_seen(), ["path", "md5"], "left_anti"), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def compressed_stream(rows: DataFrame, level: str = "L0") -> DataFrame:
    """Any stream with text: the column functions work on it as they are."""
    return rows.withColumn("text", X.compress(F.col("text"), level))


def run_to_table(stream: DataFrame, spark: SparkSession, key: str = "session_id") -> DataFrame:
    """Run an updating stream over what is there now and give the last row of every key. Its state and rows are in the folder that
    driver and executors share, spark.checkpoint.dir."""
    at, idle = shared_folder(spark, "stream"), "spark.sql.streaming.noDataMicroBatches.enabled"

    def keep(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/n={number}")

    before = spark.conf.get(idle, None)
    spark.conf.set(idle, "false")
    try:
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(idle, before) if before is not None else spark.conf.unset(idle)
    rows = spark.read.parquet(f"{at}/rows").drop("n")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("last")).select(key, "last.*")
