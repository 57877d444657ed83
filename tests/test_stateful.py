"""The session log in states of its own equals the log as a whole, over many batches and restarts."""

import random

from ctxloom.streaming import sessions, stateful

MSG = "session_id string, idx bigint, role string, name string, content string"


def test_equals_the_whole_log(spark, tmp_path):
    rng, at, said, last = random.Random(5), str(tmp_path / "in"), {}, {}
    with stateful.states(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for batch in range(3):
            rows = []
            for s in "abcd":
                n = len(said.setdefault(s, []))
                more = [(n + i, rng.choice(["user", "tool", "tool", "assistant"]), rng.choice([None, "t"]), rng.choice(["", "w" * 30, "q" * 120, "z" * 200])) for i in range(rng.randrange(3, 12))]
                said[s] += more
                rows += [(s, *m) for m in more]
            if batch == 1:
                said["d"].append((len(said["d"]), "reset", None, None))
                rows.append(("d", *said["d"][-1]))
            rng.shuffle(rows)
            spark.createDataFrame(rows, MSG).coalesce(1).write.mode("append").parquet(at)
            out = []
            log = stateful.session_log(spark.readStream.schema(MSG).parquet(at), 2, 100, 150, prompts=True)
            q = log.writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()  # noqa: B023
            assert q.awaitTermination(180), q.stop()
            last |= {r.session_id: r for r in out}
    summaries = 0
    for s, messages in said.items():
        log, compacted = sessions.compact_log([], [(i, r, n, c or "") for i, r, n, c in messages], 2, 100, 150, 0.3)
        summaries += compacted
        assert last[s].messages == len(log) and last[s].tokens == sum(len(m[3]) // 4 for m in log), s
        assert last[s].prompt == "\n".join(f"[{m[1]}] {m[3]}" for m in log), s
    assert summaries
