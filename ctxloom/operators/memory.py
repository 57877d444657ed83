"""Multi-tenant memory: scoped reads, listing, and changes as whole-table transformations (merge by join)."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COLUMNS = ["id", "user_id", "agent_id", "category", "content", "source", "metadata"]
ID_BLOCK = 1 << 16


def in_scope(user_id: str | None, agent_id: str | None, category: str | None = None) -> Column:
    """Whether a row is a tenant's; null is the empty tenant. Plain equalities, so that they reach the Parquet scan."""
    out = (F.coalesce("user_id", F.lit("")) == "") if not user_id else (F.col("user_id") == user_id)
    out = out & ((F.coalesce("agent_id", F.lit("")) == "") if not agent_id else (F.col("agent_id") == agent_id))
    return out & (F.col("category") == category) if category else out


def scope(df: DataFrame, user_id: str | None, agent_id: str | None, category: str | None = None) -> DataFrame:
    """The rows of a tenant."""
    return df.where(in_scope(user_id, agent_id, category))


def page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page by updated_at, newest first, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    best = rows.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(limit).select(*COLUMNS)
    return best.join(F.broadcast(total)).withColumn("score", F.lit(1.0))  # one row of totals


def list_page(df: DataFrame, user_id: str | None, agent_id: str | None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a scope, with the scope's total."""
    return page(scope(df, user_id, agent_id, category), limit, offset)


def load_ids(df: DataFrame, ranked: DataFrame, user_id: str | None, agent_id: str | None) -> DataFrame:
    """ranked (query_id, id, score, rank): those ids that are in the scope, with the memories' columns; ranks are counted anew, total is how many of
    a query's ids there are. Null, unknown and other tenants' ids are left out; an id that is ranked twice comes twice."""
    rows = ranked.select("query_id", "id", "score", F.col("rank").alias("place")).join(scope(df, user_id, agent_id).select(*COLUMNS), "id")
    of_query = W.partitionBy("query_id")
    rank = F.row_number().over(of_query.orderBy("place", "id")).cast("long")
    return rows.select("query_id", rank.alias("rank"), "score", *COLUMNS, F.count("*").over(of_query).alias("total"))


def of_category(df: DataFrame, category: str | None) -> DataFrame:
    """The rows of a category among those found, which leaves fewer."""
    return df.where(F.coalesce("category", F.lit("fact")) == category) if category else df


def with_embeddings(df: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """df with `embedding` by a function of a list of texts, called once a batch. Where it fails, and for null contents, the embedding is null."""
    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        try:
            made = dict(zip(known.index, embed(known.tolist()), strict=True))
        except Exception:  # a model that is not there must not stop keyword search
            made = {}
        return pd.Series([made.get(i) for i in texts.index], index=texts.index, dtype=object)

    return df.withColumn("embedding", vectors("content"))


def tool_rows(df: DataFrame) -> DataFrame:
    """What agents see of memories: id, content, source, category, and a score or total where there is one."""
    more = [c for c in ("query_id", "rank", "score", "total") if c in df.columns]
    return df.select(*more, F.col("id").cast("string").alias("id"), "content", "source", "category")


def found_or_error(df: DataFrame) -> DataFrame:
    """The tool rows of a lookup with a null error, or one row that says `Not found`."""
    found = tool_rows(df).select("id", "content", "source", "category", F.lit(None).cast("string").alias("error"))
    none = df.agg(F.count("*").alias("n")).where("n = 0")
    return found.unionByName(none.select(*[F.lit(None).cast("string").alias(c) for c in ("id", "content", "source", "category")], F.lit("Not found").alias("error")))


def count_scopes(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "agent_id", "category").agg(F.count("*").alias("total"))


def get_by_source(df: DataFrame, user_id: str | None, agent_id: str | None, source: str) -> DataFrame:
    """The row of a source in the scope; the smallest id of several."""
    return scope(df, user_id, agent_id).where(F.col("source") == source).orderBy("id").limit(1).select(*COLUMNS)


def numbered(new: DataFrame, order_by: str, top: int) -> DataFrame:
    """new with ids behind `top`, in the order of a unique integer column. Numbering goes by blocks of that column, so that no
    task holds all new rows."""
    rows = new.withColumn("__b", F.floor(F.col(order_by) / ID_BLOCK))
    blocks = rows.groupBy("__b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a block
    rows = rows.join(blocks.select("__b", before.alias("__before")), "__b")
    return rows.withColumn("id", F.lit(top) + F.col("__before") + F.row_number().over(W.partitionBy("__b").orderBy(order_by)))


def completed(rows: DataFrame, like: DataFrame, now: int) -> DataFrame:
    """rows with the columns of `like`; absent ones get defaults."""
    has = set(rows.columns)
    made = rows.select(*[_value(c, has, now).alias(c) for c in like.columns])
    return made.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in like.columns])


def store(df: DataFrame, new: DataFrame, order_by: str, now: int) -> DataFrame:
    """df and the rows of `new` with ids behind the largest, in the order of a unique integer column."""
    top = df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return df.unionByName(completed(numbered(new, order_by, top), df, now))


def _value(column: str, has: set[str], now: int):
    if column == "id":
        return F.col("id")
    if column in ("updated_at", "created_at"):
        return F.lit(now)
    default = {"category": "fact", "metadata": "{}"}.get(column, None if column in ("embedding",) else "")
    if column in has:
        return F.coalesce(column, F.lit(default)) if default is not None else F.col(column)
    return F.lit(default)


def update(df: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes (id, user_id, agent_id, content): contents of ids in the scope that says so; other rows stay."""
    c = changes.select(F.col("id").alias("__id"), F.coalesce("user_id", F.lit("")).alias("__u"), F.coalesce("agent_id", F.lit("")).alias("__a"), F.col("content").alias("__content"))
    joined = df.join(c, (F.col("id") == F.col("__id")) & (F.coalesce("user_id", F.lit("")) == F.col("__u")) & (F.coalesce("agent_id", F.lit("")) == F.col("__a")), "left")
    hit = F.col("__id").isNotNull()
    out = joined.withColumn("content", F.when(hit, F.col("__content")).otherwise(F.col("content"))).withColumn("updated_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")))
    return out.select(*df.columns)


def forget(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df without the ids (id, user_id, agent_id) in their scopes."""
    c = ids.select(F.col("id").alias("__id"), F.coalesce("user_id", F.lit("")).alias("__u"), F.coalesce("agent_id", F.lit("")).alias("__a"))
    return df.join(c, (F.col("id") == F.col("__id")) & (F.coalesce("user_id", F.lit("")) == F.col("__u")) & (F.coalesce("agent_id", F.lit("")) == F.col("__a")), "left_anti")


def sync_diff(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks (user_id, agent_id, source, content) against stored rows by scope and source: action insert, update or unchanged."""
    s = stored.groupBy("user_id", "agent_id", "source").agg(F.min(F.struct("id", "content")).alias("s"))
    action = F.when(F.col("s").isNull(), "insert").when(F.md5(F.col("content")) != F.md5(F.col("s.content")), "update").otherwise("unchanged")
    return chunks.join(s, ["user_id", "agent_id", "source"], "left").select("user_id", "agent_id", "source", "content", F.col("s.id").alias("id"), action.alias("action"))


class MemoryStore(ABC):
    """What a memory backend offers."""

    @abstractmethod
    def search(self, query: str, top_k: int = 5, user_id: str | None = None, agent_id: str | None = None, category: str | None = None) -> DataFrame: ...

    @abstractmethod
    def store(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def update(self, changes: DataFrame) -> None: ...

    @abstractmethod
    def forget(self, ids: DataFrame) -> None: ...

    @abstractmethod
    def get(self, source: str, user_id: str | None = None, agent_id: str | None = None) -> DataFrame: ...

    @abstractmethod
    def list(self, user_id: str | None = None, agent_id: str | None = None, category: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame: ...
