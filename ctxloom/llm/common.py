"""Helpers shared by the training-data operators: tables, materialising and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..plans.views import table  # noqa: F401  read by the queries and the pipeline

#: Bytes of text that a Python task holds in numpy arrays at once (one longer text is one slice).
SLICE_BYTES = 1 << 20
#: The same where a slice is turned into many numbers or strings a byte.
SMALL_SLICE = 1 << 18
#: Bytes of an Arrow batch between an executor's JVM and its Python worker, where the session sets none (one longer row is one batch);
#: Spark's own bound is 10,000 rows, whatever their length, and both sides hold a whole batch.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a
    folder of its own; a cluster's executors could not see one, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ctxloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Paths of the tables written by `materialize` and not dropped since, with their numbers.
_tables: dict[str, int] = {}
_numbers = itertools.count()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    The table stays until `drop_tables` or `drop_all` takes it away."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables[path] = next(_numbers)
    out = spark.read.schema(df.schema).parquet(path)
    out._ctxloom_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = path_of(path)
        at.getFileSystem(conf).delete(at, True)
        _tables.pop(path, None)


def drop_tables(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        _delete(t.sparkSession, [t._ctxloom_path])


def mark() -> int:
    """The number from which `drop_all` counts."""
    return next(_numbers)


def drop_all(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables materialised after a `mark`, but for those in `keep`: call it once their readers are stored or done."""
    held = {t._ctxloom_path for t in keep}
    _delete(spark, [p for p, n in _tables.items() if n >= since and p not in held])
    free_shuffles(spark)


def drop_unread(docs: DataFrame, made: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Delete the tables made between pairs of marks, but for those that docs reads; the pairs that are left."""
    if not made:
        return []
    read = docs.inputFiles()
    names = {part for f in read for part in f.split("/")}
    kept = []
    for a, b in made:
        paths = [p for p, n in _tables.items() if a <= n < b]
        if any(p.rsplit("/", 1)[1] in names for p in paths):
            kept.append((a, b))
        else:
            _delete(docs.sparkSession, paths)
    return kept


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about `most` bytes; row order stays."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        n, start, held = batch.num_rows, 0, 0
        lengths = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if held and held + lengths[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(lengths[i])
        if start < n:
            yield batch.slice(start, n - start)


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and where the C library can trim its heap, numpy's and Python's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | pa.RecordBatch], schema: str, column: str = "text", most: int = SLICE_BYTES, state: dict | None = None) -> DataFrame:
    """mapInArrow over bounded slices; fn gives a dict of columns in the order of `schema`. `state` is what fn keeps during a task; it goes
    before the worker returns its memory. Sets the session's bytes of an Arrow batch where they are not set."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    if df.sparkSession.conf.get(_BATCH_CONF, None) is None:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, most):
            out = fn(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            del part, out
        if state is not None:
            state.clear()
        give_back()  # workers live on for later stages

    return df.mapInArrow(run, schema)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
