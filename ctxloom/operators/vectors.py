"""A stored vector index with exact pruning: vectors in cells around centres, and the triangle inequality.

Centres are fitted once, on a sample of at most SAMPLE vectors; every vector is then stored in the cell of its nearest centre, with its distance r
to it, in a folder a cell. For a query at distance d from a centre, no vector of the cell is nearer than |d - r|. A search reads the nearest cells of each query until
they hold top_k rows; the k-th best distance found is the query's bound. Then the cells that the bound leaves open are read, and in them only rows
whose own |d - r| is within the bound are compared. What is left out can't be among the best, so the rows are those of `search.nearest`, whatever the
centres; the worse the centres fit, the more rows are compared. `search` can report how many.

Rows go in batches: `add` and `remove` as in any index of `Batches`. The driver holds the centres, and of one block of queries (VECTOR_BYTES) the vectors
and a bound each. Rows and queries without a vector are left out; all vectors must have one length. Ties go to the smaller id. Rows that repeat an id are
rows of their own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import Batches
from . import search

#: Vectors from which centres are fitted, and the most cells.
SAMPLE, CELLS = 20_000, 1024
ROUNDS = 5
#: Bounds are loosened by this share of the distances, so that rounding never cuts a row off.
SLACK = 1e-9

_ROWS = "id bigint, embedding array<double>, gap double, batch int, cell int"
_GONE = "id bigint, batch int"


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], axis=1) if len(centres) else np.zeros((len(x), 0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by some rounds of k-means from the sample's first vectors; a centre without vectors stays."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _in_cells(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            d = _distances(_matrix(batch.column(1), batch.num_rows), centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d[np.arange(len(d)), cell]), pa.array(cell.astype(np.int32))], names=["id", "embedding", "gap", "cell"])


def _compared(batches: Iterator[pa.RecordBatch], shared, top_k: int) -> Iterator[pa.RecordBatch]:
    """rows (id, embedding, gap, cell) -> each query's best rows of this task, and a row without an id that says how many were compared. shared has the
    queries' names and vectors, their distances to the centres, which cells each reads, and the bounds."""
    names, q, far, reads, bound = shared.value
    best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in names]
    counts = np.zeros(len(names), np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, gap, cell = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        x = _matrix(batch.column(1), batch.num_rows)
        for c in np.unique(cell):
            here = np.flatnonzero(cell == c)
            for k in np.flatnonzero(reads[:, c]):
                at = here[np.abs(far[k, c] - gap[here]) <= bound[k] + SLACK * (far[k, c] + gap[here])]
                if not len(at):
                    continue
                counts[k] += len(at)
                d = np.concatenate([best[k][0], np.sqrt(((x[at] - q[k]) ** 2).sum(1))])
                i = np.concatenate([best[k][1], ids[at]])
                keep = np.lexsort((i, d))[:top_k]
                best[k] = d[keep], i[keep]
    for k, (d, i) in enumerate(best):
        if counts[k]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i) + 1, names[k])), pa.array([*i.tolist(), None], pa.int64()), pa.array([*d.tolist(), None], pa.float64()), pa.array([0] * len(i) + [int(counts[k])], pa.int64())],
                names=["query_id", "id", "distance", "compared"])


class VectorIndex(Batches):
    """The index in a folder; the first batch fits the centres."""

    TABLES = ("rows", "gone", "docs")

    def _centres(self) -> np.ndarray | None:
        found = self._read("centres", "cell int, vector array<double>, batch int").orderBy("batch", "cell").collect()  # CELLS
        first = [r.vector for r in found if r.batch == found[0].batch]
        return np.array(first) if first else None

    def add(self, memories: DataFrame, replace: bool = False, cells: int | None = None) -> None:
        """Add memories (id, embedding, ...) as a batch; with `replace`, take their ids away from earlier batches."""
        number, centres = self._batches()[1], self._centres()
        rows = memories.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        if centres is None:
            sample = np.array([r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
            if len(sample):
                centres = fit_centres(sample, cells or min(CELLS, max(1, round(len(sample) ** 0.5))))
                made = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, vector array<double>")
                self._write(made.coalesce(1), "centres", number)
        if centres is not None:
            placed = rows.mapInArrow(functools.partial(_in_cells, centres=centres), "id bigint, embedding array<double>, gap double, cell int")
            # a cell may hold a third of all rows: eight tasks a cell
            self._write(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "gap"), "rows", number, "cell")
        if replace:
            self._write(memories.select(F.col("id").cast("long").alias("id")), "gone", number)
        self._write(self.spark.createDataFrame([], "id bigint"), "docs", number)

    def remove(self, ids: DataFrame) -> None:
        """Take ids (id, ...) away."""
        number = self._batches()[1]
        self._write(ids.select(F.col("id").cast("long").alias("id")), "gone", number)
        self._write(self.spark.createDataFrame([], "id bigint"), "docs", number)

    def search(self, queries: DataFrame, scoped: DataFrame | None = None, top_k: int = 10) -> DataFrame:
        """queries (query_id, vector) -> query_id, id, distance, score, rank, as `search.nearest`; hits are those in `scoped` (default: all)."""
        found = self.candidates(queries, scoped, top_k).where("id is not null").select("query_id", "id", "distance").distinct()
        return search._top(found.withColumn("score", 1 / (1 + F.col("distance"))), top_k)

    def compared(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """query_id, compared: how many rows a search compares with each query."""
        return self.candidates(queries, None, top_k).groupBy("query_id").agg(F.sum("compared").alias("compared"))

    def candidates(self, queries: DataFrame, scoped: DataFrame | None, top_k: int) -> DataFrame:
        spark, centres = self.spark, self._centres()
        kind = "query_id bigint, id bigint, distance double, compared bigint"
        gone = self._read("gone", _GONE)
        rows = self._there(self._read("rows", _ROWS), None if gone.isEmpty() else gone)
        if scoped is not None:
            rows = rows.join(scoped.select("id"), "id", "left_semi")
        rows = rows.select("id", "embedding", "gap", "cell")
        vectors = queries.where("vector is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
        out = spark.createDataFrame([], kind)
        if centres is None:
            return out
        stats = self._read("rows", _ROWS).groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most")).collect()  # CELLS
        n, least, most = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
        for r in stats:
            n[r.cell], least[r.cell], most[r.cell] = r.n, r.least, r.most
        size = vectors.agg(F.sum(F.size("vector").cast("long") * 8)).first()[0] or 0
        passes = -(-size // search.VECTOR_BYTES) or 1
        for p in range(passes):
            block = vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).collect()  # VECTOR_BYTES
            if not block:
                continue
            names, q = np.array([r.query_id for r in block]), np.array([r.vector for r in block])
            far = _distances(q, centres)
            order = np.argsort(np.where(n > 0, far, np.inf), axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            first = np.zeros(far.shape, bool)
            np.put_along_axis(first, order, (before < top_k) & (n[order] > 0), axis=1)
            near = self._pass(rows, (names, q, far, first, np.full(len(names), np.inf)), top_k, kind).persist()
            kth = search._top(near.where("id is not null").select("query_id", "id", (-F.col("distance")).alias("score")), top_k)
            bounds = {r.query_id: -r.score for r in kth.where(F.col("rank") == top_k).select("query_id", "score").collect()}  # a number a query of the block
            bound = np.array([bounds.get(x, np.inf) for x in names.tolist()])[:, None]
            gap = np.maximum(far - most, least - far)
            rest = ~first & (n > 0) & (gap <= bound + SLACK * (far + np.where(n > 0, most, 0)))
            out = out.unionByName(near).unionByName(self._pass(rows, (names, q, far, rest, bound[:, 0]), top_k, kind))
        return out

    def _pass(self, rows: DataFrame, shared: tuple, top_k: int, kind: str) -> DataFrame:
        cells = np.flatnonzero(shared[3].any(axis=0)).tolist()
        sent = self.spark.sparkContext.broadcast(shared)
        return rows.where(F.col("cell").isin(cells)).mapInArrow(functools.partial(_compared, shared=sent, top_k=top_k), kind)
