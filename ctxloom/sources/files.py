"""Sources and sinks: transcripts as JSON lines, markdown memory files, binary documents by a reader hook, the memory table."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory, search

TRANSCRIPT = "idx bigint, role string, name string, content string"


def write_transcripts(messages: DataFrame, path: str, ts: int) -> None:
    """One folder a session and time; the same second overwrites."""
    out = messages.withColumn("ts", F.lit(ts))
    out.repartition("session_id").sortWithinPartitions("session_id", "idx").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "ts").json(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """session_id, ts, idx, role, name, content; session and time come from the folders, so filters on them prune files."""
    rows = spark.read.schema(f"{TRANSCRIPT}, session_id string, ts bigint").option("basePath", path).json(path)
    return rows.where("idx is not null").select("session_id", "ts", "idx", "role", "name", "content")


def delete_transcripts(transcripts: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame]:
    """(the transcripts that stay, one row with the number of transcripts of the session that go)."""
    gone = transcripts.where(F.col("session_id") == session_id)
    return transcripts.where(F.col("session_id") != session_id), gone.agg(F.count_distinct("ts").alias("deleted"))


def read_markdown(spark: SparkSession, *globs: str) -> DataFrame:
    """path, content of whole text files."""
    return spark.read.text(list(globs), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def read_documents(spark: SparkSession, path: str, *readers: Callable[[str, bytes], str], glob: str = "*") -> DataFrame:
    """path, text of binary files by readers (path, bytes) -> text, the first that gives a text that is not blank; if all fail, an
    empty text. Without a reader, UTF-8 text."""
    tried = readers or (lambda at, data: data.decode("utf-8", "replace"),)

    def text(at: str, data: bytes) -> str:
        for reader in tried:
            try:
                if (found := reader(at, data)) and found.strip():
                    return found
            except Exception:
                continue
        return ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [text(at, bytes(data)) for at, data in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string")


class ParquetMemoryStore(memory.MemoryStore):
    """Memories in Parquet folders and a log of versions: a version is a file that names the folders of its rows and its largest id.

    An insert writes the new rows alone; a change of rows writes the table anew. The version's file is then moved to the
    next number, which fails if another writer was faster: OSError, and nothing is changed. Readers of a version are
    not disturbed until `vacuum`."""

    SCHEMA = "id bigint, user_id string, agent_id string, category string, content string, source string, metadata string, embedding array<float>, updated_at bigint"

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], int] = lambda: int(time.time())):
        self.spark, self.path, self.now = spark, path.rstrip("/"), now

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(self._at("log"))] if fs.exists(self._at("log")) else []
        return max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0)

    def _state(self, version: int) -> dict:
        if not version:
            return {"folders": [], "top": 0}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/log/{version:08d}.json").collect()))

    def read(self) -> DataFrame:
        return self._rows(self._state(self.version()))

    def _rows(self, state: dict) -> DataFrame:
        folders = [f"{self.path}/{f}" for f in state["folders"]]
        return self.spark.read.schema(self.SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], self.SCHEMA)

    def _write(self, df: DataFrame) -> str:
        folder = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _commit(self, version: int, folders: list[str], top: int) -> None:
        """Make the version that follows `version`, or fail if there is one."""
        jvm, fs = self.spark._jvm, self._fs()
        staged, final = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{version + 1:08d}.json")
        out = fs.create(staged)
        out.write(bytearray(json.dumps({"folders": folders, "top": top}).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(staged, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(staged, False)
            raise OSError(f"version {version + 1} is there already: another writer was faster") from e

    def _append(self, version: int, state: dict, rows: DataFrame) -> None:
        made = memory.numbered(rows if "pos" in rows.columns else rows.withColumn("pos", F.monotonically_increasing_id()), "pos", state["top"])
        folder = self._write(memory.completed(made, self.spark.createDataFrame([], self.SCHEMA), self.now()))
        top = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/{folder}").agg(F.max("id")).first()[0]
        if top is not None:
            self._commit(version, [*state["folders"], folder], top)

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        version = self.version()
        state = self._state(version)
        self._commit(version, [self._write(change(self._rows(state)))], state["top"])

    def store(self, rows: DataFrame) -> None:
        version = self.version()
        self._append(version, self._state(version), rows)

    def update(self, changes: DataFrame) -> None:
        self._change(lambda rows: memory.update(rows, changes, self.now()))

    def forget(self, ids: DataFrame) -> None:
        self._change(lambda rows: memory.forget(rows, ids))

    def vacuum(self) -> None:
        """Delete the folders that the last version does not name; readers of earlier versions must be done."""
        fs, held = self._fs(), set(self._state(self.version())["folders"])
        for f in fs.listStatus(self._at("")):
            name = f.getPath().getName()
            if name.startswith("rows-") and name not in held:
                fs.delete(f.getPath(), True)

    def get(self, source: str, user_id: str | None = None, agent_id: str | None = None) -> DataFrame:
        return memory.get_by_source(self.read(), user_id, agent_id, source)

    def list(self, user_id: str | None = None, agent_id: str | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return memory.list_page(self.read(), user_id, agent_id, category, limit, offset)

    def search(self, query: str, top_k: int = 5, user_id: str | None = None, agent_id: str | None = None, category: str | None = None, vector: list[float] | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        vectors = self.spark.createDataFrame([(0, vector)], "query_id bigint, vector array<double>") if vector else None
        return search.hybrid(self.read(), asked, vectors, user_id, agent_id, category, top_k).orderBy("rank")

    def sync(self, chunks: DataFrame) -> int:
        """Insert and update chunks (user_id, agent_id, source, content) by source; gives the number of changed rows."""
        version = self.version()
        state = self._state(version)
        now = self._rows(state)
        diff = memory.sync_diff(now, chunks).where("action != 'unchanged'").persist()
        n = diff.count()
        if n:
            kept = memory.update(now, diff.where("action = 'update'").select("id", "user_id", "agent_id", "content"), self.now())
            new = diff.where("action = 'insert'").select("user_id", "agent_id", "source", "content", F.lit("system").alias("category")).withColumn("pos", F.monotonically_increasing_id())
            changed = diff.where("action = 'update'").isEmpty()
            self._append(version, state if changed else {"folders": [self._write(kept)], "top": state["top"]}, new) if not new.isEmpty() else self._commit(version, [self._write(kept)], state["top"])
        diff.unpersist()
        return n


class PostFilterStore(memory.MemoryStore):
    """A store over another one that searches a tenant's rows first and filters categories among the top k afterwards, so fewer than k
    can remain. An absent user or agent does not restrict; sources are `external:{id}`."""

    PREFIX = "external:"

    def __init__(self, inner: ParquetMemoryStore):
        self.inner = inner

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("source", F.concat(F.lit(self.PREFIX), F.col("id").cast("string")))

    def _scoped(self, user_id: str | None, agent_id: str | None) -> DataFrame:
        rows = self.inner.read()
        rows = rows.where(F.col("user_id") == user_id) if user_id else rows
        return rows.where(F.col("agent_id") == agent_id) if agent_id else rows

    def search(self, query: str, top_k: int = 5, user_id: str | None = None, agent_id: str | None = None, category: str | None = None) -> DataFrame:
        asked = self.inner.spark.createDataFrame([(0, query)], "query_id bigint, query string")
        rows = self._scoped(user_id, agent_id)
        best = search.bm25(rows, asked, None, top_k).join(rows.select(*memory.COLUMNS), "id").select("query_id", "rank", "score", *memory.COLUMNS)
        return memory.of_category(self._named(best), category).orderBy("rank")

    def store(self, rows: DataFrame) -> None:
        self.inner.store(rows)

    def update(self, changes: DataFrame) -> None:
        """changes (id, content), whatever the tenant."""
        self.inner.update(self._owners(changes, "content"))

    def forget(self, ids: DataFrame) -> None:
        self.inner.forget(self._owners(ids))

    def _owners(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.select("id", *more).join(self.inner.read().select("id", "user_id", "agent_id"), "id")

    def get(self, source: str, user_id: str | None = None, agent_id: str | None = None) -> DataFrame:
        return self._named(self.inner.read().where(F.col("id").cast("string") == source.removeprefix(self.PREFIX)).select(*memory.COLUMNS))

    def list(self, user_id: str | None = None, agent_id: str | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = memory.of_category(self._scoped(user_id, agent_id), category)
        return self._named(memory.page(rows, limit, offset))


_STORES: dict[str, Callable[..., memory.MemoryStore]] = {"parquet": ParquetMemoryStore, "post_filter": lambda **how: PostFilterStore(ParquetMemoryStore(**how))}


def register_store(kind: str, make: Callable[..., memory.MemoryStore]) -> None:
    """Give a store a name for `memory_store`."""
    _STORES[kind] = make


def memory_store(kind: str = "parquet", **how) -> memory.MemoryStore:
    """A store by its name."""
    if kind not in _STORES:
        raise ValueError(f"no memory store is called {kind}")
    return _STORES[kind](**how)


class TelemetryLog:
    """Telemetry rows appended to Parquet by day."""

    SCHEMA = "id string, token_count bigint, compression_ratio double, latency_ms double, oom_fallback_count bigint, processor string, profile string, ts timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, rows: DataFrame) -> None:
        """Append rows; columns that they lack get defaults: no tokens, no fallback, now, an id of their own."""
        has = set(rows.columns)
        defaults = {"id": F.expr("uuid()"), "token_count": F.lit(0), "compression_ratio": F.lit(0.0), "latency_ms": F.lit(0.0), "oom_fallback_count": F.lit(0), "processor": F.lit(""), "profile": F.lit(""), "ts": F.current_timestamp()}
        kinds = [part.split(" ") for part in self.SCHEMA.split(", ")]
        out = rows.select(*[(F.coalesce(F.col(c), defaults[c]) if c in has else defaults[c]).cast(k).alias(c) for c, k in kinds])
        out.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(f"{self.SCHEMA}, day date").parquet(self.path).drop("day")

    def reset(self) -> None:
        """Forget all rows."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
