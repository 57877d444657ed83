"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and BPE encoding of `documents`.

Each stage takes all rows that the one before kept, and all but the last return the columns of documents. Null or wordless
texts go in the first stage. Null and shared doc_ids are allowed: near-dedup and decontamination remove rows, not ids. Of
repeated rows one stays after near-dedup; of rows that tie for the smallest doc_id any one, as they differ in place only. Columns
beside those of documents are carried along, whatever their names. Empty tables give no rows. Each
stage's result is stored in spark.checkpoint.dir before the next stage is called; a stage deletes what stages before it have left
there, unless its docs read it.

Line dedup comes before near-dedup, so it empties most copies: on sf0.1 near-dedup finds 41 copies where it finds 718 in
the raw documents, and line dedup removes 665 documents that are copies as a whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import bpe, decontaminate, lang_id, line_dedup, near_dedup
from ctxloom.llm.common import drop_all, drop_unread, free_shuffles, mark, materialize, table

#: Below this mean window probability no learned language is credible; such texts are rejected like those without letters.
LEAST_SCORE = 0.3
#: Percent of five-word shingles that near-duplicates share.
NEAR_SHARE = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The column of row keys inside a stage.
ROW = "__row"
#: The columns of a row's file and of its place there, and the rows that a file can have: keys are file number * FILE_ROWS + place.
FILE, PLACE, FILE_ROWS = "__file", "__place", 1 << 40
#: Keys of removed rows or groups up to this many are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


#: Marks of the tables that stages have made and not deleted yet.
_made: list[tuple[int, int]] = []


def _tidy(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Tables of the stages before are deleted when a stage begins."""
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _made[:] = drop_unread(docs, _made)
        free_shuffles(spark)
        begin = mark()
        out = work(spark, docs, sf_dir)
        _made.append((begin, mark()))
        return out
    return stage


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Columns other than those of documents get names of their own while a stage works, and theirs back after it."""
    @_tidy
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in COLUMNS else f"__other_{i}" for i, c in enumerate(docs.columns)}
        out = work(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])
    return stage


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a key of its own for each row: ids can be null or shared. Rows of a stored table are known by their file's number and their
    place in it, without a copy; any other frame is stored with its keys, as it may give other rows when it is read again."""
    files = _plain_files(docs)
    if files is None:
        return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), name)
    at = F.col("_metadata")
    placed = files.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(files.columns, docs.columns, strict=True)], at["file_path"].alias(FILE), at["row_index"].alias(PLACE))
    paths = sorted(r[0] for r in placed.select(FILE).distinct().collect())  # the driver has listed them anyway
    numbers = docs.sparkSession.createDataFrame(list(enumerate(paths)), f"{ROW} long, {FILE} string")
    keyed = placed.join(F.broadcast(numbers), FILE)
    return keyed.select(*docs.columns, (F.col(ROW) * FILE_ROWS + F.col(PLACE)).alias(ROW))


def _plain_files(docs: DataFrame) -> DataFrame | None:
    """The table of Parquet files, in one folder or one file, that docs reads whole and as they are, but for names of columns; None where docs is
    anything else. Frames are the same only if their paths are spelt alike, with the store's name or without."""
    paths = docs.inputFiles()
    roots = {p.rpartition("/")[0] for p in paths}
    for root in [r for at in (roots, set(paths)) if len(at) == 1 for r in (*at, re.sub(r"^\w+://[^/]*", "", *at))]:
        try:
            files = docs.sparkSession.read.parquet(root)
            same = files.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(files.columns, docs.columns, strict=True)])
            if docs.sameSemantics(same):
                return files
        except (AnalysisException, ValueError):  # of another format, or other columns
            continue
    return None


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _without(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The keyed rows whose key is not in keys, without it."""
    keys = materialize(keys.select(ROW).distinct(), name)
    return rows.join(_small(keys), ROW, "left_anti").drop(ROW)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; null lang is filled with the predicted one."""
    net = lang_id.train(lang_id.sample_windows(docs.select("doc_id", "text", "lang")))
    said = lang_id.predict(docs, net, tuple(docs.columns)).where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return said.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@_stage
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; documents with no word left go."""
    out = line_dedup.dedup_lines(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_stage
def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id; null ids come last."""
    rows = _keyed(docs, "cp-near-rows")
    near = near_dedup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), NEAR_SHARE)
    near = near.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW)
    near = materialize(near.select(ROW, "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", ROW).alias("place")), "cp-near-groups")
    first = near.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("component_id", F.col(f"first.{ROW}").alias("stays")), "cp-near-first")
    return _without(rows, near.join(_small(first), "component_id").where(F.col(ROW) != F.col("stays")), "cp-near")


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = _keyed(docs, "cp-leak-rows")
    hits = decontaminate.contaminations(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(rows, hits.select(F.col("doc_id").alias(ROW)), "cp-leaks")


@_tidy
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", decontamination),
    ("bpe_encoding", encoding),
]

#: SQL can express none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"cp-{name}")
        drop_all(spark, since, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
