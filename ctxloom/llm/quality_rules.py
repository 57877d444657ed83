"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

All of it is DataFrame functions. Words and word pairs of every whole text fall into BUCKETS hash buckets; the raw
multinomial counts all documents, the target one the documents in `trusted`, both with add-one smoothing. A document's
ratio is the mean over its n-grams of log target - log raw; `kept` needs the base rules and ratio >= THRESHOLD.
Bucket counts are summed before the shuffle; what reaches the driver and goes back as a literal is BUCKETS numbers,
whatever the corpus.

Null text: no words, fails the base. Texts without words have ratio 0. Repeated rows count as often as they occur.
Extra columns are not read. Without trusted documents all ratios are 0. Window hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
THRESHOLD = -0.1
MIN_WORDS, REPEAT_PERCENT, SPAN = 20, 30, 8
#: Trusted ids up to this many (8 bytes each) are broadcast; beyond it the target's texts are found by a shuffle, in a pass of their own.
BROADCAST_IDS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _repeat_words(w: Column) -> Column:
    """Words in SPAN-word windows found twice or more."""
    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
            reach = lambda p: F.transform(p, lambda v, i: F.least(F.lit(SPAN), F.coalesce(F.get(p, i + 1) - v, F.lit(SPAN))))
            return let(at, lambda p: F.aggregate(reach(p), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted))
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - SPAN + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(SPAN))))
    return F.when(F.size(w) <= SPAN, F.lit(0)).otherwise(let(hashes, of_hashes))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, w (words) and the base columns."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", F.col("text"), words(F.col("text")).alias("w"))
    d = d.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return d.withColumn("base_failed", failed)


def _one(x: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int")


def _two(w: Column, x: Column, i: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), x, F.coalesce(F.get(w, i + 1), F.lit(""))), F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log target - log raw for every bucket, counted over all documents; trusted has the doc_ids of the target."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("good", F.lit(1))
    docs = docs.select("doc_id", "text")
    if ids.count() <= BROADCAST_IDS:  # one pass
        parts = [docs.join(F.broadcast(ids), "doc_id", "left").select("text", F.lit(1).alias("raw"), F.coalesce("good", F.lit(0)).alias("target"))]
    else:  # the raw corpus without a join; only texts of the target are joined
        parts = [docs.select("text", F.lit(1).alias("raw"), F.lit(0).alias("target")), docs.join(ids, "doc_id", "left_semi").select("text", F.lit(0).alias("raw"), F.lit(1).alias("target"))]
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for part in parts:
        w = part.select(words(F.col("text")).alias("w"), "raw", "target")
        grams = F.concat(F.transform("w", lambda x: _one(x, buckets)), F.transform("w", lambda x, i: _two(F.col("w"), x, i, buckets)))
        counts = w.select("raw", "target", F.explode(grams).alias("b")).groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        for r in counts.collect():  # at most `buckets` rows
            raw[r["b"]] += r["raw"]
            target[r["b"]] += r["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def score(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, base columns, base_failed, ratio, kept."""
    d, table, n = base_rules(docs), F.lit(ratios), len(ratios)
    w = F.col("w")
    each = F.transform(w, lambda x, i: table[_one(x, n)] + table[_two(w, x, i, n)])
    ratio = F.coalesce(F.aggregate(each, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.col("n_words") * 2, F.lit(0)), F.lit(0.0))
    d = d.withColumn("ratio", ratio).drop("w")
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return score(docs, log_ratios(docs, trusted), threshold)
