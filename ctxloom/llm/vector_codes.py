"""Vector compression by product quantisation, with codebooks fitted in whole numbers.

Components become floor(4096 * x); a vector is cut into PARTS equal parts, each part position has a codebook of ENTRIES entries. The
codebooks start as the parts of the smallest vec_ids; in each round every part goes to its nearest entry (squared Euclidean distance, ties to the
lower index), and each entry becomes its parts' componentwise floor(sum / count). An entry without parts stays.

1. The kept vectors are stored once as whole numbers.
2. A round is one pass in Arrow batches: per task, the sums and counts of each entry, summed again over the tasks. The driver gets PARTS * ENTRIES rows, as
   many for any table, and makes the next codebooks.
3. Nearest entries: |c|^2 - 2 x.c by a float32 matrix product. With k = width + 2 roundings of at most u = 2 ** -24 each, x.c is off by at
   most k * u / (1 - k * u) * |x| * |c| (two roundings for the conversions to float32); that gives an interval around each value. Entries whose interval overlaps that of
   the best are computed again in int64, and equal ones go to the lower index. So the codes are those of exact arithmetic.

Rows go whose vector is null, or holds null or non-finite components; so do those that whole numbers can't hold here: components beyond
+-2 ** 26 / 4096, whose squares would not fit a long, and vectors whose length differs from that of the smallest kept vec_id's vector or isn't a positive
multiple of PARTS. Rows that repeat a vec_id stay, each with its code; of one id's, the smallest vector starts the codebooks. A null vec_id is coded but starts
no codebook. With fewer than ENTRIES ids the codebooks have that many entries; with none there are no codebooks and no rows. A sum of
errors that doesn't fit a long is null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, drop_all, mark, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components are at most so large: sums of their squared differences over a part fit a long.
LARGEST = 1 << 26
#: Labels up to this many (two longs each) are broadcast with their sums; beyond it, only those with more than HOT rows are.
BROADCAST_LABELS, HOT = 1_000_000, 1_000_000
#: Vectors of a batch that are held in numpy arrays at once.
ROWS = 4096

_UNIT = 2.0 ** -24


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, label, v array<long> of the rows that can be coded, but for the length."""
    v = F.transform("embedding", lambda x: x.cast("double") * SCALE)
    most = float(LARGEST)
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & F.abs(x.cast("double") * SCALE).between(0.0, most))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(v, lambda x: F.floor(x)).alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The index of the nearest entry of book (entries, width) to each row of x (rows, width), both int64; ties to the lower index."""
    k = (x.shape[1] + 2) * _UNIT
    exact = (book * book).sum(axis=1)
    near = exact.astype(np.float64) - 2.0 * (x.astype(np.float32) @ book.astype(np.float32).T)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    # a float64 has 2 ** -53 of relative rounding; 1e-12 stands for all of these together
    off = 2 * k / (1 - k) * length[:, None] * np.sqrt(exact.astype(np.float64)) * (1 + 1e-12) + 1e-12 * (np.abs(near) + exact)
    open_ = near - off <= (near + off).min(axis=1, keepdims=True)
    best = open_.argmax(axis=1)
    again = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(again):
        row, entry = np.nonzero(open_[again])
        d = np.full((len(again), len(book)), np.iinfo(np.int64).max)
        d[row, entry] = ((x[again[row]] - book[entry]) ** 2).sum(axis=1)
        best[again] = d.argmin(axis=1)
    return best


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        yield some, column_of(some, "v").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, PARTS, width)


def _sum_entries(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sums and counts of the parts nearest to each entry, by part and entry."""
    n, width = books.shape[1:]
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for batch in batches:
        for _, x in _parts(batch, width):
            for p in range(PARTS):
                code = nearest(x[:, p], books[p])
                counts[p] += np.bincount(code, minlength=n)
                np.add.at(sums[p], code, x[:, p])
    place = np.indices(counts.shape).reshape(2, -1)
    yield pa.RecordBatch.from_pydict({"part": place[0].astype(np.int32), "entry": place[1].astype(np.int32), "n": counts.reshape(-1), "sums": list(sums.reshape(-1, width))})


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")
    for batch in batches:
        for some, x in _parts(batch, books.shape[2]):
            codes = np.stack([nearest(x[:, p], books[p]) for p in range(PARTS)], axis=1)
            error = ((x - books[np.arange(PARTS), codes]) ** 2).sum(axis=(1, 2))
            code = digits[codes].view(f"S{2 * PARTS}").reshape(-1).astype(str)
            yield pa.RecordBatch.from_arrays([column_of(some, "vec_id"), column_of(some, "label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])


def first_books(vectors: DataFrame) -> np.ndarray | None:
    """Codebooks (part, entry, position) of the smallest ids' vectors; none without an id that has a vector."""
    known = vectors.where("vec_id is not null")
    one = known.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if one is None or one.n == 0 or one.n % PARTS:
        return None
    known = known.where(F.size("v") == one.n)
    ids = [r.vec_id for r in known.select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    rows = known.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def fit(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """vectors (v, of the books' length) -> the codebooks after some rounds."""
    n, width = books.shape[1:]
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(functools.partial(_sum_entries, books=books), "part int, entry int, n long, sums array<long>")
        sums = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        new = books.copy()
        for r in sums.where("n > 0").collect():  # parts times entries, whatever the table
            new[r.part, r.entry] = [s // r.n for s in r.sums]
        books = new
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, code, error, label_error, codebooks_sha256, label."""
    since = mark()
    whole = materialize(whole_vectors(vectors), "vc-whole")
    books = first_books(whole)
    kind = whole.schema["label"].dataType.simpleString()
    if books is None:
        return whole.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label")
    whole = whole.where(F.size("v") == PARTS * books.shape[2])
    books = fit(whole, books)
    coded = materialize(whole.mapInArrow(functools.partial(_encode, books=books), f"vec_id long, label {kind}, code string, error long"), "vc-coded")
    sums = materialize(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count("*").alias("n")), "vc-labels")
    drop_all(vectors.sparkSession, since, keep=(coded, sums))
    out = with_label_sums(coded, sums, sums.count() <= BROADCAST_LABELS)
    return out.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"), "label")


def with_label_sums(coded: DataFrame, sums: DataFrame, few: bool) -> DataFrame:
    """Each row with its label's sum. Labels of more than HOT rows, at most a millionth of the rows, are broadcast; the others are joined
    by a shuffle. Where all labels are few, all are broadcast."""
    sums = sums.withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    hot = F.broadcast(sums if few else sums.where(F.col("n") > HOT))
    out = coded.join(hot, same)
    if not few:
        out = out.unionByName(coded.join(hot, same, "left_anti").join(sums.where(F.col("n") <= HOT), same))
    return out.drop("of", "n")
