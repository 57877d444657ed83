"""Working views over the supplied tables: memories, messages, telemetry rows and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, where its files have fewer splits: one row group is read by one task, however long the
    work on its rows takes. Tables with more splits than cores stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables of texts and vectors, on whose rows work takes long; rows of others are only counted, looked up and cut.
HEAVY = frozenset(("documents", "pages", "benchmark", "conversations", "embeddings"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True, heavy: bool = True) -> DataFrame:
    """Documents as memories; without vectors no join is made, and embedding is null. Lookups that don't work on the texts are not heavy."""
    d = table(spark, sf_dir, "documents") if heavy else spark.read.parquet(f"{sf_dir}/documents.parquet")
    if vectors:
        e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        d = d.join(e, d.doc_id == e.vec_id, "left")
    else:
        d = d.withColumn("embedding", F.lit(None).cast("array<float>"))
    agent = F.when(F.floor(F.col("doc_id") / 30) % 2 == 0, "coder").otherwise("writer")
    kinds = F.array(*[F.lit(x) for x in ("fact", "preference", "rule", "profile", "note", "system")])
    return d.select(
        (F.col("doc_id") + 1).alias("id"), F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")).alias("user_id"), agent.alias("agent_id"),
        F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("category"), F.col("text").alias("content"),
        F.concat("source", F.lit(".md#L"), (F.col("doc_id") + 1).cast("string")).alias("source"),
        F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')).alias("metadata"), "embedding", (F.lit(1704067200) + F.col("doc_id") * 60).alias("updated_at"),
    )


MEMORIES_SQL = """memories AS (
  SELECT d.doc_id + 1 AS id, concat('u', CAST(d.doc_id % 5 AS VARCHAR)) AS user_id,
    CASE WHEN CAST(floor(d.doc_id / 30) AS BIGINT) % 2 = 0 THEN 'coder' ELSE 'writer' END AS agent_id,
    CASE d.doc_id % 6 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'rule' WHEN 3 THEN 'profile' WHEN 4 THEN 'note' ELSE 'system' END AS category,
    d.text AS content, concat(d.source, '.md#L', CAST(d.doc_id + 1 AS VARCHAR)) AS source, concat('{"lang":"', d.lang, '"}') AS metadata,
    e.embedding AS embedding, 1704067200 + d.doc_id * 60 AS updated_at
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the assistant's turns in the place of tool results."""
    return _messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's files."""
    at = f"{sf_dir}/conversations.parquet"
    return _messages(spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{at}*"))


def _messages(turns: DataFrame) -> DataFrame:
    said = F.col("role") == "assistant"
    return turns.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.col("turn").alias("idx"),
        F.when(said, "tool").otherwise(F.col("role")).alias("role"), F.when(said, F.concat(F.lit("t"), (F.col("turn") % 3).cast("string"))).alias("name"), F.col("text").alias("content"),
    )


MESSAGES_SQL = """messages AS (
  SELECT concat('s', CAST(conv_id AS VARCHAR)) AS session_id, turn AS idx, CASE WHEN role = 'assistant' THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'assistant' THEN concat('t', CAST(turn % 3 AS VARCHAR)) END AS name, text AS content
  FROM conversations)"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = F.array(*[F.lit(x) for x in ("speed", "selective", "balanced", "accuracy")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("token_count"), (F.col("value") / F.lit(500.0)).alias("compression_ratio"),
        F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("oom_fallback_count"), F.col("event_type").alias("processor"),
        F.get(profiles, (F.col("user_id") % 4).cast("int")).alias("profile"), F.col("ts").cast("timestamp").alias("ts"),
    )


TELEMETRY_SQL = """telemetry AS (
  SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS token_count, value / 500.0e0 AS compression_ratio, value AS latency_ms,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS oom_fallback_count, event_type AS processor,
    CASE user_id % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'selective' WHEN 2 THEN 'balanced' ELSE 'accuracy' END AS profile, ts
  FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of every kind, made of the pages."""
    p, n = F.col("page_id"), F.col("page_id").cast("string")
    item = (
        F.when(p % 6 == 0, F.col("url")).when(p % 6 == 1, F.concat(F.lit("upload_"), n, F.lit(".PDF"))).when(p % 6 == 2, F.concat(F.lit("img_"), n, F.lit(".png")))
        .when(p % 6 == 3, F.concat(F.lit("a_"), n, F.lit(".mp3"))).when(p % 6 == 4, F.concat(F.lit("data:image/png;base64,"), n)).otherwise(F.col("html"))
    )
    return table(spark, sf_dir, "pages").select(p.alias("pos"), item.alias("item"))


ITEMS_SQL = """items AS (
  SELECT page_id AS pos, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN concat('upload_', CAST(page_id AS VARCHAR), '.PDF')
    WHEN 2 THEN concat('img_', CAST(page_id AS VARCHAR), '.png') WHEN 3 THEN concat('a_', CAST(page_id AS VARCHAR), '.mp3')
    WHEN 4 THEN concat('data:image/png;base64,', CAST(page_id AS VARCHAR)) ELSE html END AS item
  FROM pages)"""
