"""Session compaction over messages (session_id, idx, role, name, content) and transcripts (session_id, ts, idx, ...).

Windows are partitioned by session, so one shuffle and one sort serve a query; a session's text is bounded by its window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X

# Texts that other programs look for in compacted sessions.
SUMMARY_PREFIX = "Previous conversation summary: "
PLACEHOLDER = ("[Previous: used ", "]")
NO_TRANSCRIPT, EMPTY_TRANSCRIPT = "No transcript found for session ", "Empty transcript for session "

KEEP_RECENT, LEAST_LENGTH, WINDOW_MESSAGES, SUMMARY_LINES = 3, 100, 50, 10


def text_of_parts(parts: Column) -> Column:
    """The text parts of a multimodal content (array<struct<type, text>>), one a line."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")


def micro_compact(messages: DataFrame, keep_recent: int = KEEP_RECENT, least_length: int = LEAST_LENGTH, role: str = "tool") -> DataFrame:
    """Long contents of a role's messages, but for the last keep_recent of a session, become placeholders."""
    is_role = F.col("role").eqNullSafe(F.lit(role))
    from_end = F.sum(is_role.cast("int")).over(W.partitionBy("session_id").orderBy(F.desc("idx")))
    old = is_role & (from_end > keep_recent) & (F.length("content") >= least_length)
    note = F.concat(F.lit(PLACEHOLDER[0]), F.coalesce("name", F.lit("tool")), F.lit(PLACEHOLDER[1]))
    return messages.withColumn("content", F.when(old, note).otherwise(F.col("content")))


def session_tokens(messages: DataFrame) -> DataFrame:
    """The token estimate of a session: the sum of its messages' estimates."""
    return messages.groupBy("session_id").agg(F.sum(F.coalesce(X.tokens(F.col("content")), F.lit(0))).alias("tokens"), F.count("*").alias("messages"))


def session_text(messages: DataFrame, last: int = WINDOW_MESSAGES) -> DataFrame:
    """session_id, text: the last messages that are not blank, as `[role] content` lines."""
    rn = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("idx")))
    rows = messages.withColumn("rn", rn).where(F.col("rn") <= last)
    line = F.when(X.strip(F.coalesce("content", F.lit(""))) != "", F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("] "), "content"))
    parts = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("idx", line.alias("line")))))
    return rows.groupBy("session_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def fallback_summary(text: Column) -> Column:
    """A header with the line count and the last lines of users and assistants (of all, without any)."""
    def of(lines: Column) -> Column:
        said = F.filter(lines, lambda x: x.startswith("[user]") | x.startswith("[assistant]"))
        kept = F.when(F.size(said) == 0, lines).otherwise(said)
        last = X.let(kept, lambda k: F.slice(k, F.greatest(F.size(k) - SUMMARY_LINES + 1, F.lit(1)), F.lit(SUMMARY_LINES)))
        return F.concat(F.lit("Conversation summary ("), F.size(lines).cast("string"), F.lit(" lines total):\n"), F.array_join(last, "\n"))
    return X.let(F.split(X.strip(text), "\n"), of)


def summary(text: Column, strategy: str = "lingua", level: str = "L2", rate: float = 0.3, llm: Column | None = None) -> Column:
    """The first result that is not blank: lingua, llm, fallback; or llm first; or the fallback alone."""
    lingua = X.compress(text, level if level in ("L0", "L1", "L2", "L3") else "L2", rate)
    llm = F.lit(None).cast("string") if llm is None else llm
    chain = {"lingua": [lingua, llm], "llm": [llm, lingua]}.get(strategy, [])
    return F.coalesce(*[F.when(X.strip(c) != "", c) for c in chain], fallback_summary(text))


def summaries(transcripts: DataFrame, asked: DataFrame, strategy: str = "lingua", level: str = "L2", rate: float = 0.3, llm: Column | None = None) -> DataFrame:
    """asked (session_id) -> session_id, summary of the newest transcript. A session without a transcript, and one whose newest
    transcript has no message (a row with a null idx stands for it), get a note instead."""
    asked = asked.select("session_id").distinct()
    newest = latest_transcript(transcripts.join(asked, "session_id", "left_semi"))
    there = newest.groupBy("session_id").agg(F.count("idx").alias("n"))
    said = session_text(newest.where("idx is not null"))
    out = asked.join(there, "session_id", "left").join(said, "session_id", "left")
    note = F.when(F.col("n").isNull(), F.concat(F.lit(NO_TRANSCRIPT), "session_id")).when(F.col("n") == 0, F.concat(F.lit(EMPTY_TRANSCRIPT), "session_id"))
    return out.select("session_id", F.coalesce(note, summary(F.coalesce("text", F.lit("")), strategy, level, rate, llm)).alias("summary"))


def auto_compact(messages: DataFrame, threshold: int, strategy: str = "lingua", level: str = "L2", rate: float = 0.3) -> DataFrame:
    """Sessions of `threshold` tokens or more become one system message with their summary; others stay."""
    big = session_tokens(messages).where(F.col("tokens") >= threshold).select("session_id")
    stay = messages.join(big, "session_id", "left_anti")
    said = session_text(messages.join(big, "session_id", "left_semi"))
    made = said.select("session_id", F.lit(0).cast("long").alias("idx"), F.lit("system").alias("role"), F.lit(None).cast("string").alias("name"),
                       F.concat(F.lit(SUMMARY_PREFIX), summary(F.col("text"), strategy, level, rate)).alias("content"))
    return stay.select("session_id", F.col("idx").cast("long").alias("idx"), "role", "name", "content").unionByName(made)


def session_summaries_as_memories(messages: DataFrame, threshold: int, **how) -> DataFrame:
    """What auto_compact stores for later: content, source `summary:{session}`, category session_history, in the session's scope."""
    made = auto_compact(messages, threshold, **how).where((F.col("idx") == 0) & (F.col("role") == "system") & F.col("content").startswith(SUMMARY_PREFIX))
    return made.select(F.substring("content", len(SUMMARY_PREFIX) + 1, 1 << 30).alias("content"), F.concat(F.lit("summary:"), "session_id").alias("source"), F.lit("session_history").alias("category"))


def latest_transcript(transcripts: DataFrame) -> DataFrame:
    """The messages of each session's newest transcript."""
    newest = transcripts.groupBy("session_id").agg(F.max("ts").alias("ts"))
    return transcripts.join(newest, ["session_id", "ts"])


def sessions(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("session_id").distinct()


def replay(transcripts: DataFrame, from_turn: int) -> DataFrame:
    return latest_transcript(transcripts).where(F.col("idx") >= from_turn)
