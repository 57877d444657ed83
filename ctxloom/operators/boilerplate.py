"""Boilerplate of a source: the lines that many of its documents have, found without a shuffle of all lines, and taken out.

A line counts once a document; lines are compared without spaces, tabs and carriage returns around them, and empty lines never count. A line is common
where LEAST documents or more of a source have it, and PERCENT or more of the source's documents.

First every task counts its lines in a count-min sketch: for each source ROWS times WIDTH counters. Counters add up, so they are an ordinary
sum that meets before the shuffle and is at most ROWS * WIDTH rows a source and task. A line's least counter is never below its true count, so no
common line is lost; it is above it by more than 2.72 / WIDTH of all lines with a chance of exp(-ROWS). Lines whose ROWS counters all reach the
limit are candidates, and only those are shuffled and counted exactly. Where more than COUNTERS counters reach it (very many sources), a broadcast
has no bound, and all lines are counted exactly, with the same result.

A null source is the empty one, a null text has no lines. Repeated rows count as documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

LEAST, PERCENT = 5, 10
ROWS, WIDTH = 4, 1 << 16
#: Rows up to which the counters over the limit are broadcast, and bytes up to which the common lines are.
COUNTERS, LINE_BYTES = 300_000, 32 << 20
#: Parts of a source where its lines are joined by a shuffle, so that a large source is no single key.
SALTS = 64
_AROUND = " \t\r\v\f"


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(_AROUND))


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def _reach(n: Column, docs: Column, least: int, percent: int) -> Column:
    return (n >= least) & (n * 100 >= docs * percent)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, since it is counted before it is joined; it stays until the folder is cleared."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _slots(line: Column) -> Column:
    """The line's counter in each row, the rows one behind the other."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(r), line), F.lit(WIDTH)) + r * WIDTH for r in range(ROWS)])


def sketch(docs: DataFrame) -> DataFrame:
    """source, slot, n: the counters of docs (source, text). Sketches of parts of a corpus are merged by summing n by source and slot."""
    lines = docs.select(_source().alias("source"), F.explode(_distinct_lines()).alias("line"))
    return lines.select("source", F.explode(_slots(F.col("line"))).alias("slot")).groupBy("source", "slot").agg(F.count("*").alias("n"))


def _distinct_lines() -> Column:
    return F.filter(F.array_distinct(F.transform(F.split("text", "\n"), _trim)), lambda x: x != "")


def common_lines(docs: DataFrame, least: int = LEAST, percent: int = PERCENT, counters: DataFrame | None = None) -> DataFrame:
    """source, line, documents (that have it), docs (of the source). `counters` is a merged sketch of docs, made anew where it is not given."""
    per_source = docs.groupBy(_source().alias("source")).agg(F.count("*").alias("docs"))
    high = (counters if counters is not None else sketch(docs)).join(per_source, "source").where(_reach(F.col("n"), F.col("docs"), least, percent))
    high = _stored(high.select("source", "slot"), "counters")
    lines = docs.select(_source().alias("source"), F.explode(_distinct_lines()).alias("line"))
    if high.count() <= COUNTERS:
        lines = lines.withColumn("slots", _slots(F.col("line")))
        for r in range(ROWS):
            of_row = F.broadcast(high.where(F.floor(F.col("slot") / WIDTH) == r).withColumnRenamed("source", "of"))
            lines = lines.join(of_row, (F.col("source") == F.col("of")) & (F.col("slots")[r] == F.col("slot")), "left_semi")
    counts = lines.groupBy("source", "line").agg(F.count("*").alias("documents"))
    return counts.join(per_source, "source").where(_reach(F.col("documents"), F.col("docs"), least, percent)).select("source", "line", "documents", "docs")


def stripped(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs (source, text, ...) with the common lines of their source taken out of `text`, and `n_removed`, how many lines went (null for a
    null text). The other lines stay as they are. The common lines of a source are at most 100 / PERCENT times the lines of its average document."""
    common = _stored(common.select(F.col("source").alias("__of"), "line"), "lines")
    small = common.agg(F.coalesce(F.sum(F.octet_length("line") + 16), F.lit(0))).first()[0] <= LINE_BYTES
    held = common.groupBy("__of").agg(F.collect_set("line").alias("__held"))
    if small:
        rows = docs.join(F.broadcast(held), _source() == F.col("__of"), "left")
    else:
        held = held.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        part = F.pmod(F.xxhash64(*[F.col(c) for c in docs.columns if c != "text"]), F.lit(SALTS))
        rows = docs.join(held, (_source() == F.col("__of")) & (part == F.col("__part")), "left").drop("__part")
    own = F.array_intersect(_distinct_lines(), F.col("__held"))

    def without(lines: Column) -> Column:
        return F.when(F.size(F.col("__own")) > 0, F.filter(lines, lambda x: ~F.array_contains(F.col("__own"), _trim(x)))).otherwise(lines)
    rows = rows.withColumn("__own", F.coalesce(own, F.array().cast("array<string>"))).withColumn("__lines", F.split("text", "\n"))
    rows = rows.withColumn("__left", without(F.col("__lines")))
    out = {"text": F.array_join("__left", "\n")}
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns], (F.size("__lines") - F.size("__left")).cast("long").alias("n_removed"))
