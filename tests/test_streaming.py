"""Streams end with what the batch operators give."""

from pyspark.sql import functions as F

from ctxloom.operators import telemetry
from ctxloom.streaming import sessions

MSG = "session_id string, idx bigint, role string, name string, content string"


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.stop()


def test_session_log(spark, tmp_path):
    # idle timeouts always call for another batch, so availableNow ends only without batches that have no data
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    at = str(tmp_path / "in")
    rows = [("a", 0, "user", None, "hello"), ("a", 1, "tool", "t", "r" * 120), ("a", 2, "tool", "t", "q" * 120), ("b", 0, "user", None, "x" * 2000), ("c", 0, "user", None, "gone"), ("c", 1, "reset", None, None)]
    spark.createDataFrame(rows, MSG).coalesce(1).write.parquet(at)
    run(sessions.session_log(spark.readStream.schema(MSG).parquet(at), keep_recent=1, threshold=400), "log", "update")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = {r.session_id: r for r in spark.table("log").collect()}
    assert got["a"].messages == 3 and "[Previous: used t]" in got["a"].prompt and "q" * 120 in got["a"].prompt
    assert got["b"].compacted and got["b"].messages == 1 and got["b"].prompt.startswith("[system] Previous conversation summary: [user] x")
    assert got["c"].messages == 0


def test_windows_equal_batch(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = spark.range(500).select(F.timestamp_seconds(F.col("id") * 60 + 1_700_000_000).alias("ts"), F.concat(F.lit("p"), F.col("id") % 3).alias("processor"), (F.col("id") % 7).alias("token_count"), (F.col("id") * 0.5).alias("latency_ms"))
    rows.coalesce(1).write.parquet(at)
    run(sessions.telemetry_windows(spark.readStream.schema(rows.schema).parquet(at)), "win", "append")
    got = {(r.start, r.processor): (r["count"], r.total_tokens) for r in spark.table("win").collect()}
    w = rows.groupBy(F.window("ts", "1 hour"), "processor").agg(F.count("*").alias("n"), F.sum("token_count").alias("t")).collect()
    expected = {(r.window.start, r.processor): (r.n, r.t) for r in w}
    assert got and got.items() <= expected.items()


def test_first_images(spark, tmp_path):
    at = str(tmp_path / "in")
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "phash string, t int").select("phash", F.timestamp_seconds(F.col("t")).alias("ts"))
    rows.coalesce(1).write.parquet(at)
    run(sessions.first_images(spark.readStream.schema(rows.schema).parquet(at)), "img", "append")
    assert sorted(r.phash for r in spark.table("img").collect()) == ["x", "y"]


def test_sync_skips_seen_files(spark, tmp_path):
    at, seen, out = str(tmp_path / "in"), str(tmp_path / "seen"), []
    spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "path string, content string").write.parquet(at)
    spark.createDataFrame([("a.md", "one")], "path string, content string").select("path", F.md5(F.col("content").cast("binary")).alias("md5")).write.parquet(seen)
    q = sessions.sync_files(spark.readStream.schema("path string, content string").parquet(at), lambda: spark.read.parquet(seen), lambda df, n: out.extend(r.path for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert out == ["b.md"]


def test_compaction_equals_a_look_at_the_whole_log():
    import random

    rng = random.Random(8)
    for keep in (0, 1, 3):
        messages = [(i, rng.choice(["user", "tool", "tool", "reset" if rng.random() < 0.1 else "user"]), rng.choice([None, "t"]), "w" * rng.choice([0, 5, 40, 90])) for i in range(200)]
        log, any_summary = [], False
        for m in messages:
            if m[1] == "reset":
                log = []
                continue
            log = [*log, m]
            tools = [i for i, x in enumerate(log) if x[1] == "tool"]
            old = tools[:max(0, len(tools) - keep)]
            log = [(*x[:3], f"[Previous: used {x[2] or 'tool'}]") if i in old and len(x[3]) >= 30 else x for i, x in enumerate(log)]
            if sum(len(x[3]) // 4 for x in log) >= 90:
                text = "\n".join(f"[{x[1]}] {x[3]}" for x in log[-50:] if x[3].strip())
                log, any_summary = [(m[0], "system", None, "Previous conversation summary: " + text[:len(text) // 2])], True
        cut = rng.randrange(200)
        first, a = sessions.compact_log([], messages[:cut], keep, 30, 90, 0.5)
        last, b = sessions.compact_log(first, messages[cut:], keep, 30, 90, 0.5)
        assert last == log and (a or b) == any_summary and any_summary
