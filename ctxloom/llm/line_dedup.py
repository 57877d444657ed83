"""Line dedup by winnowing over line hashes.

A line with a word weighs its words; other lines weigh nothing and are skipped. A window is the shortest run of lines,
from a given line on, with at least RUN_WORDS words. Winnowing keeps each window's smallest line hash: any run of lines
of RUN_WORDS words or more holds a whole window, so its fingerprint is taken wherever the run occurs. Fingerprints at two
or more positions of the corpus are joined back to their documents. There each is extended both ways, to all shortest
runs of RUN_WORDS words (forwards from a line and backwards from a line) inside windows that hold it, and a run's hash
is joined across documents. The first occurrence in (doc_id, line) order stays; later ones, unless they overlap the first
in its own document, are deleted. Together the overlapping runs cover exactly the lines of every repeated run of RUN_WORDS
words or more, to its first and last line.

Lines are compared without leading and trailing white space. A document is a doc_id with a text: rows with one doc_id
and different texts are documents of their own, and repeated rows (same id, same text) are one document whose rows all get
its result. Documents come in the order of doc_id, null last, then of a hash of their text. Null texts stay null, and empty
ones and those without a repeat stay as they are. doc_id has any type that can be ordered. Extra columns are carried along
by `dedup_lines`, whatever their names; input columns called n_lines or n_deleted give way to the operator's. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import wordhash as wh
from .common import column_of, drop_tables, map_slices, materialize

RUN_WORDS = 50
#: Lists of fingerprints or line numbers with up to this many entries in all (8 bytes each) are broadcast; beyond it the join is
#: a shuffle.
BROADCAST_ENTRIES = 2_000_000

_U = np.uint64


class _Lines:
    """Lines with a word of a batch: hash, number in the text, words before each, and each text's first."""

    def __init__(self, texts: pa.Array):
        buf, offsets = wh.text_buffer(texts)
        start, end, first = wh.split(buf, offsets, wh._NEWLINE)
        ws, we, _ = wh.split(buf, offsets)
        lo, hi = np.searchsorted(ws, start), np.searchsorted(ws, end)
        some = hi > lo
        breaks = np.concatenate([[0], np.cumsum(buf == 0x0A)])
        text = np.searchsorted(first, np.arange(len(start)), side="right") - 1
        self.number = (breaks[start] - breaks[offsets[text]])[some] if len(start) else np.zeros(0, int)
        self.hash = wh.span_hash(buf, ws[lo[some]], we[hi[some] - 1]) if some.any() else np.zeros(0, _U)
        self.text = text[some] if len(start) else np.zeros(0, int)
        self.words = np.concatenate([[0], np.cumsum((hi - lo)[some])])
        self.first = np.searchsorted(self.text, np.arange(len(offsets)))

    def forward(self) -> tuple[np.ndarray, np.ndarray]:
        """(from, to): the shortest runs of RUN_WORDS words from each line on, inside its text."""
        at = np.arange(len(self.hash))
        to = np.searchsorted(self.words, self.words[:-1] + RUN_WORDS)
        ok = to <= self.first[1:][self.text] if len(at) else np.zeros(0, bool)
        return at[ok], to[ok]

    def backward(self) -> tuple[np.ndarray, np.ndarray]:
        to = np.arange(1, len(self.hash) + 1)
        start = np.searchsorted(self.words, self.words[1:] - RUN_WORDS, side="right") - 1
        ok = start >= self.first[:-1][self.text] if len(to) else np.zeros(0, bool)
        return start[ok], to[ok]

    def minima(self, start: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The line with the smallest hash of each run (the first of equals)."""
        if not len(start):
            return start
        pairs = np.column_stack([start, to]).reshape(-1)
        order = np.argsort(self.hash, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return order[np.minimum.reduceat(np.append(rank, 0), pairs)[::2]]


def _documents(batch: pa.RecordBatch, rows: np.ndarray) -> dict:
    return {c: column_of(batch, c).take(pa.array(rows)) for c in ("doc_id", "h")}


def _fingerprints(batch: pa.RecordBatch) -> dict:
    lines = _Lines(column_of(batch, "text"))
    at = np.unique(lines.minima(*lines.forward()))
    return {**_documents(batch, lines.text[at]), "fp": lines.hash[at].view(np.int64)}


def _runs(batch: pa.RecordBatch) -> dict:
    """The runs that hold one of the text's repeated fingerprints (column fps)."""
    lines = _Lines(column_of(batch, "text"))
    wanted = [np.array(x, np.int64).view(_U) for x in column_of(batch, "fps").to_pylist()]
    hit = np.zeros(len(lines.hash), bool)
    for t, fps in enumerate(wanted):
        a, b = lines.first[t], lines.first[t + 1]
        hit[a:b] = np.isin(lines.hash[a:b], fps)
    before = np.concatenate([[0], np.cumsum(hit)])
    runs = [lines.forward(), lines.backward()]
    start, to = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    keep = before[to] > before[start]
    both = np.unique(np.column_stack([start[keep], to[keep]]), axis=0)
    start, to = both[:, 0], both[:, 1]
    place = wh._power(wh._P, len(lines.hash), "p")
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(lines.hash * place, dtype=_U)])
    h = wh.mix((prefix[to] - prefix[start]) * wh._power(wh._PI, len(lines.hash) + 1, "i")[start] + (to - start).astype(_U)) if len(start) else np.zeros(0, _U)
    return {
        **_documents(batch, lines.text[start]),
        "run": h.view(np.int64),
        "lo": lines.number[start],
        "hi": lines.number[to - 1],
    }


def _small(lists: DataFrame, column: str) -> DataFrame:
    """lists, broadcast where they have few entries in all."""
    entries = lists.agg(F.sum(F.size(column) + 1)).first()[0] or 0
    return F.broadcast(lists) if entries <= BROADCAST_ENTRIES else lists


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Whether rows of the two frames belong to one document."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def _spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, h) without null texts -> doc_id, h, lo, hi: runs of lines to delete, which may overlap."""
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long"
    fps = materialize(map_slices(docs, _fingerprints, f"{key}, fp long"), "ld-fps")
    twice = materialize(fps.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "ld-twice")
    found = materialize(fps.join(twice, "fp", "left_semi").groupBy("doc_id", "h").agg(F.collect_set("fp").alias("fps")), "ld-found")
    near = _small(found, "fps")
    runs = docs.join(near, _same(docs, near)).select(docs["doc_id"], docs["h"], "text", "fps")
    runs = materialize(map_slices(runs, _runs, f"{key}, run long, lo long, hi long"), "ld-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    first = runs.groupBy("run").agg(F.min(F.struct(place.alias("doc"), "lo", "hi")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("run", F.col("f.doc").alias("fd"), F.col("f.hi").alias("fh")), "ld-first")
    spans = materialize(runs.join(first, "run").where((place != F.col("fd")) | (F.col("lo") > F.col("fh"))).select("doc_id", "h", "lo", "hi").distinct(), "ld-spans")
    drop_tables(fps, twice, found, runs, first)
    return spans


def _islands(spans: DataFrame) -> DataFrame:
    """doc_id, h, gone: the spans of each document merged into sorted ones (lo, hi) apart from each other."""
    w = W.partitionBy("doc_id", "h").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = spans.withColumn("new", (F.coalesce(reach + 1 < F.col("lo"), F.lit(True))).cast("int"))
    rows = rows.withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.groupBy("doc_id", "h", "part").agg(F.min("lo").cast("int").alias("lo"), F.max("hi").cast("int").alias("hi"))
    return rows.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines outside the merged spans: one slice before each span and one behind the last."""
    start = lambda i: F.coalesce(F.get(gone, i - 1)["hi"] + 1, F.lit(0))
    before = F.transform(gone, lambda g, i: F.slice(lines, start(i) + 1, g["lo"] - start(i)))
    tail = F.element_at(gone, -1)["hi"] + 2
    behind = F.slice(lines, tail, F.greatest(F.size(lines) - tail + 1, F.lit(0)))
    return F.concat(F.flatten(before), behind)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text")).where("text is not null")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, h (hash of the text), gone: sorted spans (lo, hi) of the lines to delete, counted from 0; documents
    without any have no row."""
    return _islands(_spans(_hashed(docs)))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with repeated runs deleted from text, and n_lines, n_deleted."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    inner = docs.select(*[F.col(f"`{c}`").alias({"doc_id": "doc_id", "text": "text"}.get(c, f"__other{i}")) for i, c in enumerate(names)])
    inner = inner.withColumn("text", F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    found = materialize(repeated_lines(inner), "ld-deleted")
    near = _small(found, "gone")
    out = inner.join(near, _same(inner, near), "left").select(*[inner[c] for c in inner.columns], "gone")
    lines = F.split("text", "\n")
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.transform(F.array(lines), lambda x: F.array_join(_without(x, F.col("gone")), "\n"))[0])
    n_deleted = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, g: n + g["hi"] - g["lo"] + 1), F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    said = out.withColumns({"n_lines": n_lines, "n_deleted": n_deleted, "left": left})
    back = {"text": "left"}
    return said.select(*[F.col(back.get(i, i)).alias(c) for i, c in zip(inner.columns, names)], "n_lines", "n_deleted")
