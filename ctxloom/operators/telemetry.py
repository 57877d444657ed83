"""Telemetry rollups: totals, by processor, since a time, the last rows, and the text exposition format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 10_000


def since(rows: DataFrame, start) -> DataFrame:
    """Rows from `start` on; a falsy start keeps all."""
    return rows.where(F.col("ts") >= F.lit(start)) if start else rows


def _measures() -> list:
    return [
        F.count("*").alias("count"), F.sum("token_count").alias("total_tokens"), F.avg("compression_ratio").alias("avg_compression"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.sum("oom_fallback_count").alias("oom_count"),
    ]


def stats(rows: DataFrame) -> DataFrame:
    """One row of totals; none for no rows."""
    return rows.agg(*_measures(), F.min("ts").alias("ts_from"), F.max("ts").alias("ts_to")).where("count > 0")


def by_processor(rows: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("processor"), F.lit("")), F.lit("unknown"))
    return rows.groupBy(name.alias("processor")).agg(*_measures())


def totals_and_processors(rows: DataFrame) -> DataFrame:
    """Both in one pass, by grouping sets; the total has a null processor."""
    name = F.coalesce(F.nullif(F.col("processor"), F.lit("")), F.lit("unknown"))
    return rows.withColumn("processor", name).rollup("processor").agg(*_measures())


def ring(rows: DataFrame, most: int = RING) -> DataFrame:
    """The last rows by (ts, id)."""
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def exposition(rows: DataFrame, prefix: str = "ctxloom") -> DataFrame:
    """One text of metrics; processors in name order. No row for no rows."""
    t = stats(rows)
    gauge = lambda name, text, kind, value: F.concat_ws("\n", F.lit(f"# HELP {prefix}_{name} {text}"), F.lit(f"# TYPE {prefix}_{name} {kind}"), F.concat(F.lit(f"{prefix}_{name} "), value), F.lit(""))
    head = F.concat_ws(
        "\n",
        gauge("tokens_total", "Tokens of all recorded requests", "counter", F.col("total_tokens").cast("string")),
        gauge("compression_ratio", "Mean share of tokens saved by a request", "gauge", F.format_string("%.4f", "avg_compression")),
        gauge("latency_ms", "Mean time of a request, in milliseconds", "gauge", F.format_string("%.2f", "avg_latency_ms")),
        gauge("oom_fallback_total", "Requests that fell back for lack of memory", "counter", F.col("oom_count").cast("string")),
    )
    line = F.concat_ws(
        "\n",
        F.format_string(prefix + '_processor_latency_ms{processor="%s"} %.2f', "processor", "avg_latency_ms"),
        F.format_string(prefix + '_processor_compression{processor="%s"} %.4f', "processor", "avg_compression"),
    )
    lines = by_processor(rows).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("processor", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    return t.select(head.alias("head")).join(F.broadcast(lines)).select(F.concat("head", F.lit("\n"), "lines", F.lit("\n")).alias("exposition"))  # one row each
