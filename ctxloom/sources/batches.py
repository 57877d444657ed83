"""Tables of an index that grows by numbered batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Batches:
    """Tables in a folder, each with a folder for each batch. A batch counts once its table `docs` is written, so that is written last; `gone`
    (id) takes ids away from earlier batches. Written batches are not written again, and of two writers of one number the second fails."""

    TABLES = ("gone", "docs")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> tuple[list[int], int]:
        """(the numbers of the batches that count, the next number)."""
        conf, path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(conf)
        names = {k: [f.getPath().getName() for f in fs.listStatus(path(f"{self.path}/{k}"))] if fs.exists(path(f"{self.path}/{k}")) else [] for k in self.TABLES}
        numbers = {k: sorted(int(n.removeprefix("batch=")) for n in found if n.startswith("batch=")) for k, found in names.items()}
        return [n for n in numbers["docs"] if fs.exists(path(f"{self.path}/docs/batch={n}/_SUCCESS"))], max((n for found in numbers.values() for n in found), default=0) + 1

    def _read(self, kind: str, schema: str) -> DataFrame:
        conf, path = self.spark._jsc.hadoopConfiguration(), self.spark._jvm.org.apache.hadoop.fs.Path
        paths = [f"{self.path}/{kind}/batch={n}" for n in self._batches()[0]]
        paths = [p for p in paths if path(p).getFileSystem(conf).exists(path(p))]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, number: int, *by: str) -> None:
        df.write.partitionBy(*by).parquet(f"{self.path}/{kind}/batch={number}")

    def _there(self, rows: DataFrame, gone: DataFrame | None) -> DataFrame:
        """rows (id, batch, ...) without those taken away later."""
        if gone is None:
            return rows
        last = gone.groupBy(F.col("id").alias("of")).agg(F.max("batch").alias("until"))
        return rows.join(last, (F.col("id") == F.col("of")) & (F.col("batch") < F.col("until")), "left_anti")
