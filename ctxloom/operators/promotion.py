"""Promotion of memories: a score of importance, persistence and uniqueness, with access counts that fade.

An access weighs one when it happens and half of it every `half_life` seconds later. Faded weights add up whenever they are brought to the same
time, so the state (id, weight, n, as_of) is brought forward and the new accesses are added to it: one sum by id, combined before the shuffle.
The result is that of the whole log, in whatever order and however late accesses arrive, up to rounding.

score = w1 * importance + w2 * persistence + w3 * uniqueness, each from 0 to 1: importance is a category's (`importance`, OTHER for unknown and
null ones); persistence is weight / (1 + weight); uniqueness is the distance to the nearest other memory of the scope over `far`, one at most, and
one where a memory has no vector or no neighbour. Null ids and times of accesses count nothing; memories without access have persistence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decisions

HALF_LIFE = 7 * 86_400
WEIGHTS = (0.4, 0.4, 0.2)
IMPORTANCE = {"rule": 1.0, "preference": 0.9, "profile": 0.8, "fact": 0.6, "note": 0.4}
OTHER = 0.2
THRESHOLD = 0.6
STATE = "id long, weight double, n long, as_of long"


def _faded(weight: Column, seconds: Column, half_life: float) -> Column:
    return weight * F.pow(F.lit(2.0), -seconds / F.lit(float(half_life)))


def counted(state: DataFrame | None, accesses: DataFrame, as_of: int, half_life: float = HALF_LIFE) -> DataFrame:
    """The state at `as_of` (seconds) after accesses (id, at in seconds): id, weight, n, as_of. state is the last call's result, stored; None at first."""
    now = F.lit(as_of).cast("long")
    rows = accesses.where("id is not null and at is not null").select("id", _faded(F.lit(1.0), now - F.col("at"), half_life).alias("weight"), F.lit(1).cast("long").alias("n"))
    if state is not None:
        rows = rows.unionByName(state.select("id", _faded(F.col("weight"), now - F.col("as_of"), half_life).alias("weight"), "n"))
    return rows.groupBy("id").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).withColumn("as_of", now)


def uniqueness(memories: DataFrame, candidates: DataFrame, far: float = 1.0) -> DataFrame:
    """id, uniqueness of the candidates (rows of memories), each among all memories of its scope."""
    near = decisions.similar(memories, candidates.withColumnRenamed("id", "cand_id"), limit=float("inf"), top=2)  # itself and one more
    nearest = near.where("id <> cand_id").groupBy("cand_id").agg(F.min("distance").alias("d"))
    found = candidates.select("id").join(nearest, F.col("id") == F.col("cand_id"), "left")
    return found.select("id", F.coalesce(F.least(F.col("d") / F.lit(float(far)), F.lit(1.0)), F.lit(1.0)).alias("uniqueness"))


def promoted(memories: DataFrame, candidates: DataFrame, state: DataFrame, threshold: float = THRESHOLD, weights: tuple[float, float, float] = WEIGHTS,
             importance: dict[str, float] | None = None, far: float = 1.0) -> DataFrame:
    """id, importance, persistence, uniqueness, score, promote for each candidate (memories' columns, ids unique)."""
    of = IMPORTANCE if importance is None else importance
    known = F.create_map(*[F.lit(x) for kv in of.items() for x in kv]) if of else F.create_map().cast("map<string,double>")
    worth = F.when(F.col("category").isNotNull(), F.try_element_at(known, F.col("category")))
    rows = candidates.select("id", F.coalesce(worth, F.lit(OTHER)).alias("importance")).join(uniqueness(memories, candidates, far), "id")
    rows = rows.join(state.select("id", "weight"), "id", "left").withColumn("persistence", F.coalesce(F.col("weight") / (1 + F.col("weight")), F.lit(0.0)))
    score = sum(w * F.col(c) for w, c in zip(weights, ("importance", "persistence", "uniqueness"), strict=True))
    return rows.select("id", "importance", "persistence", "uniqueness", score.alias("score"), (score >= threshold).alias("promote"))
