"""The session log with a state of its own for each message, so that a batch reads and writes only what it touches.

A session's messages are a map from their numbers; beside it are its counters and the numbers of its last tool results. A new message is one entry; a tool result that is no
longer among the last `keep_recent` is rewritten as a placeholder; the summary of a log at `threshold` tokens reads the last WINDOW_MESSAGES entries and
replaces all. A message with role `reset`, and a timer when a session has been idle, delete the session's state. Every batch's messages go in idx order; a null
content counts as empty. Results are those of `sessions.compact_log`. The state store must be RocksDB's: start
such streams within `states`.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import session
from .sessions import LOG_OUT, _placeholder

#: What the session must say when such a stream starts.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_COUNTERS = "first bigint, next bigint, tokens bigint"
_MESSAGE = "idx bigint, role string, name string, content string"


@contextlib.contextmanager
def states(spark: SparkSession, **more: str) -> Iterator[None]:
    """The session's settings for states of this kind, and back after it."""
    before = {k: spark.conf.get(k, None) for k in STORE | more}
    for k, v in (STORE | more).items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class SessionLog(StatefulProcessor):
    def __init__(self, keep_recent: int, least_length: int, threshold: int, rate: float, idle: int, prompts: bool):
        self.keep_recent, self.least_length, self.threshold, self.rate = keep_recent, least_length, threshold, rate
        self.idle, self.prompts = idle, prompts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", _COUNTERS)
        self.tools = handle.getListState("tools", "n bigint")
        self.log = handle.getMapState("log", "n bigint", _MESSAGE)

    def _delete(self) -> None:
        self.counters.clear()
        self.tools.clear()
        self.log.clear()

    def _messages(self, first: int, after: int) -> Iterator[tuple]:
        return (self.log.getValue((n,)) for n in range(first, after))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, after, tokens = self.counters.get() if self.counters.exists() else (0, 0, 0)
        tools = [n for (n,) in self.tools.get()] if self.tools.exists() else []
        compacted = False
        new = pd.concat(list(rows)).sort_values("idx", kind="stable")
        for idx, role, name, content in zip(new["idx"], new["role"], new["name"], new["content"], strict=True):
            if role == "reset":
                self._delete()
                first, after, tokens, tools = 0, 0, 0, []
                continue
            content = content or ""
            self.log.updateValue((after,), (int(idx), role, name, content))
            tokens += len(content) // 4
            if role == "tool":
                tools.append(after)
                if len(tools) > self.keep_recent:
                    old = tools.pop(0)
                    was = self.log.getValue((old,))
                    if len(was[3]) >= self.least_length:
                        note = _placeholder(was[2])
                        tokens += len(note) // 4 - len(was[3]) // 4
                        self.log.updateValue((old,), (was[0], was[1], was[2], note))
            after += 1
            if tokens >= self.threshold:
                last = self._messages(max(first, after - session.WINDOW_MESSAGES), after)
                text = "\n".join(f"[{m[1] or 'unknown'}] {m[3]}" for m in last if m[3].strip())
                summary = session.SUMMARY_PREFIX + text[:int(len(text) * self.rate)]
                self._delete()
                first, after, tokens, tools, compacted = 0, 1, len(summary) // 4, [], True
                self.log.updateValue((0,), (int(idx), "system", None, summary))
        if after:
            self.counters.update((first, after, tokens))
            self.tools.put([(n,) for n in tools]) if tools else self.tools.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        prompt = "\n".join(f"[{m[1]}] {m[3]}" for m in self._messages(first, after)) if self.prompts else None
        yield pd.DataFrame({"session_id": [key[0]], "messages": [after - first], "tokens": [tokens], "compacted": [compacted], "prompt": [prompt]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._delete()
        return iter(())

    def close(self) -> None:
        pass


def session_log(messages: DataFrame, keep_recent: int = 3, least_length: int = 100, threshold: int = 4000, rate: float = 0.3, idle: str = "1 hour", prompts: bool = False) -> DataFrame:
    """As `sessions.session_log`; the prompt, for which a whole log is read, is put out only with `prompts`."""
    log = SessionLog(keep_recent, least_length, threshold, rate, int(pd.Timedelta(idle).total_seconds() * 1000), prompts)
    return messages.groupBy("session_id").transformWithStateInPandas(log, LOG_OUT, "Update", "ProcessingTime")
