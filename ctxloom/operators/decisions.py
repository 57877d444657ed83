"""Memory decisions for a batch of candidate facts: ADD, UPDATE, DELETE or NOOP, each made as if the candidates came one by one.

A candidate is matched with the nearest memory of its scope among the TOP most similar, if that is within `limit`; candidates that match
none are matched with those of equal words in their scope. The candidates of one memory are applied in the order of cand_id: a retraction
deletes the memory (NOOP where it is gone already); the first other candidate of a memory that is gone adds it anew; a candidate whose words the
memory has had since it was last deleted is NOOP; others update it. Nothing loops over candidates: retractions before a candidate are counted
in blocks of cand_id, so no task holds all candidates of a memory, and the rest are aggregates joined by cand_id.

Null contents are empty, null vectors match no memory, a null `retracts` is false. cand_id is unique. Equal distances go to the smaller memory id.
Candidates that match no memory don't see similar ones of their own batch, only equal ones; a later batch does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..sources.shared import shared_folder
from . import memory, search

TOP = 10
LIMIT = 0.5
#: Apart by this much, scopes are farther from each other than vectors within one.
_FAR = 1e6


def _key(content: Column) -> Column:
    return F.md5(F.array_join(X.search_terms(F.coalesce(content, F.lit(""))), " "))


def _owner() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("user_id", "agent_id")]


def _placed(embedding: Column) -> Column:
    """A vector with two components for its scope: none between vectors of one scope, so their distance stays as it is."""
    at = lambda seed: F.pmod(F.xxhash64(F.lit(seed), *_owner()), F.lit(1 << 20)) * F.lit(_FAR)
    return F.when(embedding.isNotNull(), F.concat(embedding.cast("array<double>"), F.array(at(1), at(2))))


def similar(memories: DataFrame, candidates: DataFrame, limit: float = LIMIT, top: int = TOP) -> DataFrame:
    """cand_id, id, distance, place: the most similar memories of each candidate's scope within the limit."""
    m = memories.select("id", *_owner(), F.col("embedding"))
    c = candidates.select("cand_id", *_owner(), F.col("embedding"))
    near = search.nearest(m.select("id", _placed(F.col("embedding")).alias("embedding")), c.select(F.col("cand_id").alias("query_id"), _placed(F.col("embedding")).alias("vector")), top)
    near = near.where(F.col("distance") <= limit).select(F.col("query_id").alias("cand_id"), "id", "distance", F.col("rank").alias("place"))
    owned = near.join(m.drop("embedding"), "id").join(c.drop("embedding"), ["cand_id", "user_id", "agent_id"])  # hashes of scopes may meet
    return owned.select("cand_id", "id", "distance", "place")


def _nearest_one(found: DataFrame) -> DataFrame:
    return found.groupBy("cand_id").agg(F.min_by("id", "place").alias("id"))


def decide(memories: DataFrame, candidates: DataFrame, limit: float = LIMIT, choose: Callable[[DataFrame], DataFrame] = _nearest_one) -> DataFrame:
    """candidates (cand_id, user_id, agent_id, content, embedding, retracts) -> cand_id, id (null for a new memory), group (the first
    candidate of a new memory), action, user_id, agent_id, content. `choose` takes similar(...) and gives (cand_id, id); a model's choice is passed in here."""
    c = candidates.select("cand_id", *_owner(), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("retracts", F.lit(False)).alias("retracts"), _key(F.col("content")).alias("key"))
    c = c.join(choose(similar(memories, candidates, limit)).select("cand_id", "id"), "cand_id", "left")
    alone = c.where("id is null")
    group = alone.groupBy("user_id", "agent_id", "key").agg(F.min("cand_id").alias("group"))
    c = c.where("id is not null").withColumn("group", F.lit(None).cast("long")).unionByName(alone.join(group, ["user_id", "agent_id", "key"]))
    epochs = _stored(_epochs(_stored(c)))
    # What each memory has had: its own words first, then those of the candidates between two retractions.
    spoken = epochs.where("not retracts")
    first = spoken.groupBy("id", "group", "epoch", "key").agg(F.min("cand_id").alias("cand_id")).select("cand_id", F.lit(True).alias("new_words"))
    ends = epochs.groupBy("id", "group", "epoch").agg(F.min(F.when(~F.col("retracts"), F.col("cand_id"))).alias("opens"), F.min(F.when(F.col("retracts"), F.col("cand_id"))).alias("closes"))
    opens = ends.where("opens is not null and (epoch > 0 or id is null)").select(F.col("opens").alias("cand_id"), F.lit(True).alias("adds"))
    closes = ends.where("closes is not null and (opens is not null or (epoch = 0 and id is not null))").select(F.col("closes").alias("cand_id"), F.lit(True).alias("deletes"))
    own = memories.select("id", _key(F.col("content")).alias("own"))
    rows = epochs.join(own, "id", "left").join(first, "cand_id", "left").join(opens, "cand_id", "left").join(closes, "cand_id", "left")
    known = F.col("new_words").isNull() | ((F.col("epoch") == 0) & F.col("own").eqNullSafe(F.col("key")))
    action = F.when(F.col("retracts"), F.when(F.col("deletes"), "DELETE").otherwise("NOOP")).when(F.col("adds"), "ADD").when(known, "NOOP").otherwise("UPDATE")
    return rows.select("cand_id", "id", "group", action.alias("action"), "user_id", "agent_id", "content")


def _stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, since several branches read it; it stays until the folder is cleared."""
    at = shared_folder(df.sparkSession, "decisions")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _epochs(c: DataFrame) -> DataFrame:
    """c with `epoch`, the retractions of the same memory before a candidate. A window sees one block of cand_id; sums of blocks come before."""
    of = ["id", "group"]
    rows = c.withColumn("__b", F.floor(F.col("cand_id") / memory.ID_BLOCK))
    n = F.col("retracts").cast("long")
    blocks = rows.groupBy(*of, "__b").agg(F.sum(n).alias("n"))
    upto = W.partitionBy(*of).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    before = blocks.select(*[F.col(k).alias(f"__{k}") for k in of], F.col("__b").alias("__block"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    same = (F.col("__b") == F.col("__block")) & F.col("id").eqNullSafe(F.col("__id")) & F.col("group").eqNullSafe(F.col("__group"))
    within = W.partitionBy(*of, "__b").orderBy("cand_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(n).over(within), F.lit(0))).join(before, same)
    return rows.withColumn("epoch", F.col("__before") + F.col("__in")).drop("__b", "__in", "__before", "__block", "__id", "__group")


def apply(memories: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """memories after the decisions: the last ADD or UPDATE of a memory says its content, unless a DELETE comes later. New memories get ids
    behind the largest, in the order of their first candidates. Changed contents have a null embedding until they are embedded again."""
    did = decisions.where("action <> 'NOOP'").withColumn("x", F.struct("action", "content"))
    last = did.groupBy("id", "group").agg(F.max_by("x", "cand_id").alias("x"), F.min_by(F.struct("user_id", "agent_id"), "cand_id").alias("who")).where("id is not null or x.action <> 'DELETE'")
    old = memories.join(last.where("id is not null").select(F.col("id").alias("__id"), "x"), F.col("id") == F.col("__id"), "left").where("x is null or x.action <> 'DELETE'")
    hit = F.col("x").isNotNull()
    made = {"content": F.when(hit, F.col("x.content")).otherwise(F.col("content")), "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}
    made["embedding"] = F.when(~hit, F.col("embedding"))
    kept = old.select(*[made[c].cast(memories.schema[c].dataType).alias(c) if c in made else F.col(c) for c in memories.columns])
    top = memories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = last.where("id is null").select(F.col("group").alias("__first"), "who.user_id", "who.agent_id", F.col("x.content").alias("content"))
    return kept.unionByName(memory.completed(memory.numbered(new, "__first", top), memories, now))
