"""Toxicity: a counterfactual-regularised word-presence classifier.

Features are the words (letter runs, lower-cased) of a whole text and their beginnings of PREFIXES letters (for inflected
forms; written with a trailing `-`), present or not. Fitting takes a bounded, hash-chosen
sample of labelled texts, PER_CLASS of each class (expected), and sends only their distinct words on; Spark counts them by
class, and the FEATURES words whose class counts differ most (by a z-score of the log odds, LEAST_Z at least) are kept, besides
IDENTITY terms. One more feature is the logarithm of the number of distinct words, since a long text has some features by chance. A
logistic regression is fitted in numpy on the driver.

Its loss adds counterfactual pairs of every labelled text: each identity term in it is dropped, and swapped for SWAPS other
terms; and INSERTS terms that it lacks are written into it, so that the penalty acts where the labels mention no group. A pair compares the
whole feature vectors before and after, words and beginnings, those that other words of the text keep on included. Of each
term the mean squared change of the score's logit is taken, and SWAP times the sum over terms is added to the loss. So what a
term adds goes to nothing, a neutral mention of a group does not raise a score, and words that insult do.

Every text is scored whole. Null, empty and wordless texts get the score of a text without features. Rows with a null
label are not learned from; without both classes all scores are 0. Ties in the choice of features go to the smaller word.
Of a doc_id with several labels the largest counts; of several texts the smallest is learned from. Repeated rows get equal scores; extra columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_of, drop_tables, map_slices, materialize

PER_CLASS, FEATURES, MIN_TEXTS = 4000, 2048, 6
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: The least |z| of a feature: words of either class by chance stay out, so that few labels do not mislead.
LEAST_Z = 3.0
SWAP, SWAPS, INSERTS = 4.0, 4, 3
DECAY, STEPS, RATE = 5e-4, 400, 0.1
THRESHOLD = 0.7

# Words for groups of people, which by themselves say nothing bad.
IDENTITY = (
    "women woman men man girls boys muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics black white asian "
    "asians african africans arab arabs latino latinos european europeans american americans gay gays lesbian lesbians bisexual transgender trans queer straight immigrant "
    "immigrants refugee refugees migrant migrants foreigner foreigners disabled deaf blind elderly old young poor "
    "frauen männer juden muslime christen ausländer flüchtlinge behinderte schwule lesben femmes hommes juifs musulmans chrétiens étrangers réfugiés handicapés "
    "mujeres hombres judíos musulmanes cristianos extranjeros refugiados discapacitados"
).split()

_WORD = re.compile(r"[^\W\d_]+")


def plain_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def switched(word: str) -> list[str]:
    """The features that a word switches on."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) >= n]]


def distinct_words(text: str | None) -> set[str]:
    return {f for w in plain_words(text) for f in switched(w)}


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, text, toxic) of a bounded, hash-chosen sample of the labelled documents: labels choose, then texts follow."""
    ids = docs.select("doc_id").join(labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    chosen = materialize(_bounded(ids.distinct(), per_class).select(F.col("doc_id").alias("id"), "toxic"), "tox-ids")
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # about 2 * per_class ids
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def _bounded(rows: DataFrame, per_class: int) -> DataFrame:
    """About per_class rows of each class, by a hash of the id."""
    share = {r["toxic"]: min(1.0, per_class / r["n"]) for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    limit = F.when(F.col("toxic") == 1, int(share.get(1, 0) * (1 << 30))).otherwise(int(share.get(0, 0) * (1 << 30)))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)


def _sampled_words(labelled: DataFrame) -> DataFrame:
    """(doc_id, toxic, words): the distinct words of (doc_id, text, toxic)."""
    rows = labelled.where("toxic in (0, 1)")
    rows = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text"))

    def words(batch: pa.RecordBatch) -> dict:
        return {"doc_id": column_of(batch, "doc_id"), "toxic": column_of(batch, "toxic"), "words": [sorted(distinct_words(t)) for t in column_of(batch, "text").to_pylist()]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_slices(rows, words, f"doc_id {kind}, toxic int, words array<string>")


def choose_features(words: DataFrame, most: int = FEATURES) -> list[str]:
    """The words with the largest |z| of the log odds ratio between the classes (Spark counts, the driver gets `most`)."""
    totals = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    c = words.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    odds = F.log(a / (n1 + 1 - a)) - F.log(b / (n0 + 1 - b))
    z = F.abs(odds) / F.sqrt(1 / a + 1 / b)
    return [r["w"] for r in c.where(z >= LEAST_Z).orderBy(F.desc(z), "w").limit(most).select("w").collect()]


def counterfactuals(rows: list[tuple[int, dict[int, int], int]], features: list[str], identity: list[str]) -> tuple[np.ndarray, ...]:
    """The changes of feature vectors under swaps: (pair, feature, change) entries, and (pairs, weights) of their terms.

    A row has, for each feature on, the number of its words that switch it on; a term takes one away or adds one."""
    at = {w: k for k, w in enumerate(features)}
    terms = [t for t in identity if t in at]
    on = [[at[f] for f in switched(t) if f in at] for t in terms]
    place = {at[t]: k for k, t in enumerate(terms)}
    pair, feature, change, of_term = [], [], [], []

    def add(counts: dict[int, int], gone: int | None, new: int | None) -> None:
        moved: dict[int, int] = {}
        for k, step in ((gone, -1), (new, 1)):
            for f in on[k] if k is not None else ():
                moved[f] = moved.get(f, 0) + step
        for f, step in moved.items():
            before = counts.get(f, 0)
            if (d := (before + step > 0) - (before > 0)):
                pair.append(len(of_term))
                feature.append(f)
                change.append(d)
        of_term.append(gone if new is None else new)

    for i, (_, counts, _) in enumerate(rows):
        said = [place[f] for f in counts if f in place]
        others = [k for k in range(len(terms)) if k not in said]
        for j, t in enumerate(said):
            add(counts, t, None)
            for n in range(min(SWAPS, len(others))):
                add(counts, t, others[(i * SWAPS + j + n) % len(others)])
        for n in range(min(INSERTS, len(others))):
            add(counts, None, others[(i * INSERTS + n) % len(others)])
    term = np.array(of_term, int)
    each = np.bincount(term, minlength=len(terms))
    return np.array(pair, int), np.array(feature, int), np.array(change, float), 1 / each[term] if len(term) else np.zeros(0)


def fit(rows: list[tuple[int, dict[int, int], int]], features: list[str], identity: list[str] = IDENTITY, swap: float = SWAP) -> dict:
    """rows: (label, {index of a feature on: words of the text that switch it on}, distinct words). The weights of a
    counterfactual-regularised logistic regression."""
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    for i, (_, counts, n) in enumerate(rows):
        x[i, list(counts)], x[i, -1] = 1, np.log1p(n)
    y = np.array([r[0] for r in rows], np.float32)
    pair, feature, change, share = counterfactuals(rows, features, identity)
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
    w, b, decay = np.zeros(x.shape[1], np.float32), np.float32(0), np.append(np.full(len(features), DECAY), 0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - y) * balance
        gw = x.T @ g + decay * w
        if len(share) and swap:  # the sum over pairs of share * (score after - score before) ** 2
            moved = np.bincount(pair, change * w[feature], len(share))
            gw += 2 * swap * np.bincount(feature, change * (share * moved)[pair], len(w))
        grad = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))  # the last half of the steps grow smaller
        move = rate * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return {"bias": float(b), "length": float(w[-1]), "weights": {f: float(k) for f, k in zip(features, w[:-1], strict=True)}}


def learn(sample: DataFrame, features: int = FEATURES) -> dict | None:
    """sample (doc_id, text, toxic), bounded (see `labelled`) -> model, or None without both classes."""
    sample = materialize(sample, "tox-sample")
    words = materialize(_sampled_words(sample), "tox-words")
    chosen = sorted({*choose_features(words, features), *(f for t in IDENTITY for f in switched(t))})
    at = {w: k for k, w in enumerate(chosen)}

    def counts(batch: pa.RecordBatch) -> dict:
        on, n, size = [], [], []
        for text in column_of(batch, "text").to_pylist():
            words = plain_words(text)
            c = Counter(at[f] for w in words for f in switched(w) if f in at)
            size.append(len(words))
            on.append(sorted(c))
            n.append([c[k] for k in sorted(c)])
        return {"doc_id": column_of(batch, "doc_id"), "toxic": column_of(batch, "toxic"), "on": on, "n": n, "size": size}

    kind = sample.schema["doc_id"].dataType.simpleString()
    texts = sample.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("text").cast("string").alias("text"))
    rows = map_slices(texts, counts, f"doc_id {kind}, toxic int, on array<int>, n array<int>, size int").collect()  # the bounded sample
    drop_tables(sample, words)
    if {r["toxic"] for r in rows} != {0, 1}:
        return None
    rows.sort(key=lambda r: (str(r["doc_id"]), r["toxic"], r["on"], r["n"]))
    return fit([(r["toxic"], dict(zip(r["on"], r["n"], strict=True)), r["size"]) for r in rows], chosen)


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, score, predicted."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    weights = {w: k for w, k in model["weights"].items() if abs(k) > 1e-6}

    begins = [(n, frozenset(w[:-1] for w in weights if len(w) == n + 1 and w[-1] == "-")) for n in PREFIXES]

    def logit(text: str | None) -> float:
        words = set(_WORD.findall((text or "").lower()))
        present = words & weights.keys()
        for n, known in begins:
            present.update([w + "-" for w in {w[:n] for w in words} & known])
        return model["bias"] + model["length"] * math.log1p(len(words)) + sum(weights[w] for w in sorted(present))

    def run(batch: pa.RecordBatch) -> dict:
        z = np.array([logit(t) for t in column_of(batch, "text").to_pylist()])
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return {"doc_id": column_of(batch, "doc_id"), "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, run, f"doc_id {kind}, score double, predicted int")
