"""How five filters interact: what each removes at each step of each of their 120 orders, by part of the corpus.

Failure conditions over a document's whole text (null: empty; words: maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive): A: under 50 words;
B: 100 * distinct words < 65 * words; C: 100 * `[A-Z]` characters > 5 * code points; D: holds any `[#$%&*|]`; E: identical to the text of any
document with a smaller doc_id, removed or not.

1. One pass over the texts gives each document's failures of A to D as bits and a SHA-256 of its text; only these are stored and shuffled.
2. A text's smallest doc_id by a grouping on the hash, summed up before the shuffle. A document passes E if (hash, doc_id) is such a pair, so
   the join's keys are as many as the documents, however often a text repeats.
3. mapInArrow looks up the step of the first failure in FIRST, a table of 32 sets of failures by 120 orders; np.bincount counts the documents by part, order, step and
   label. A task holds PARTS parts at most and gives out its arrays when it meets more.
4. The partial arrays are summed for each part and order.

Null doc_id: neither fails E nor makes others fail it, and has no label. Rows that repeat a doc_id and a text are documents of their own and
don't make each other fail. Of several labels of one doc_id, quality 1 and toxic 1 win. Null source: the empty part. Labels of no document, and other
columns, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import column_of, drop_all, map_slices, mark, materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 50, 65, 5, "#$%&*|"
#: Parts whose arrays a task holds at once.
PARTS = 256

ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: The filter's number at each step of each order.
AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
_FAILS = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)
_STEPS = len(FILTERS)
#: By failures (bit i: the filter i) and order: the step of the first failure, and one more than the last step without any.
FIRST = np.array([[next((s for s, f in enumerate(order) if fails[f]), _STEPS) for order in AT] for fails in _FAILS])

_UPPER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def text_failures(texts: pa.Array) -> np.ndarray:
    """The failures of A to D of each text, as bits."""
    buf, offsets = wh.text_buffer(texts)
    w = wh.words(texts, lower=False)
    count = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
    n_words = np.diff(w.first)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], np.int64)
    points = count(buf & 0xC0 != 0x80)
    fails = [n_words < MIN_WORDS, 100 * distinct < DISTINCT_SHARE * n_words, 100 * count(_UPPER[buf]) > UPPER_SHARE * points, count(_SYMBOL[buf]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _features(batch: pa.RecordBatch) -> dict:
    return {c: column_of(batch, c) for c in ("doc_id", "part", "h")} | {"fails": text_failures(column_of(batch, "text"))}


def _counted(parts: list[str], counts: np.ndarray) -> pa.RecordBatch:
    """counts (part, order, step, label): a row for each part and order, of arrays by step. Labels: bit 0 good, bit 1 toxic."""
    counts = counts.reshape(-1, len(ORDERS), _STEPS + 1, 4)[:len(parts)]
    removed = counts.sum(axis=3)
    by_filter = lambda step: np.stack([removed[:, np.flatnonzero(AT[:, step] == f)[0], step] for f in range(_STEPS)], axis=1)
    fails, unique = by_filter(0), by_filter(_STEPS - 1)  # the first filter removes all that fails it, the last what fails it alone
    shapley = np.stack([(removed[:, :, :_STEPS] * (AT == f)).sum(axis=(1, 2)) for f in range(_STEPS)], axis=1)
    good, toxic = counts[:, :, :_STEPS, 1] + counts[:, :, :_STEPS, 3], counts[:, :, :_STEPS, 2] + counts[:, :, :_STEPS, 3]
    arrays = [removed, good, toxic, fails[:, AT], unique[:, AT], shapley[:, AT]]
    names = pa.array(parts, pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), len(ORDERS))))
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[-1]).cast(pa.list_(pa.int64())) for x in arrays]
    return pa.RecordBatch.from_arrays([names, pa.array(ORDERS * len(parts), pa.string()), *lists], schema=_ARROW)


#: Arrays by step of a part and order, and their lengths.
_ARRAYS = {"removed": _STEPS + 1, "good": _STEPS, "toxic": _STEPS, "fails": _STEPS, "unique": _STEPS, "shapley": _STEPS}
_PARTIAL = "part string, filter_order string, " + ", ".join(f"{c} array<long>" for c in _ARRAYS)
_ARROW = pa.schema([("part", pa.string()), ("filter_order", pa.string()), *((c, pa.list_(pa.int64())) for c in _ARRAYS)])


def _count_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, fails, label) -> partial arrays by part and order."""
    size, base = len(ORDERS) * (_STEPS + 1) * 4, np.arange(len(ORDERS)) * (_STEPS + 1)
    held: dict[str, int] = {}
    counts = np.zeros(PARTS * size, np.int64)
    for batch in batches:
        names = column_of(batch, "part").dictionary_encode()
        code, known = names.indices.to_numpy(), names.dictionary.to_pylist()
        fails, label = (column_of(batch, c).to_numpy() for c in ("fails", "label"))
        for start in range(0, len(known), PARTS):
            now = known[start:start + PARTS]
            if len(held.keys() | set(now)) > PARTS:
                yield _counted(list(held), counts)
                held, counts = {}, np.zeros(PARTS * size, np.int64)
            place = np.array([held.setdefault(x, len(held)) for x in now])
            rows = np.flatnonzero((code >= start) & (code < start + PARTS))
            at = (base + FIRST[fails[rows]]) * 4 + label[rows][:, None] + place[code[rows] - start][:, None] * size
            counts += np.bincount(at.reshape(-1), minlength=counts.size)
    if held:
        yield _counted(list(held), counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...), labels (doc_id, quality, toxic, ...) -> part, filter_order, step, filter_name, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley."""
    since = mark()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("h"))
    features = materialize(map_slices(docs, _features, "doc_id long, part string, h binary, fails int"), "fa-features")
    known = features.where("doc_id is not null")
    firsts = known.groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = lambda column: F.coalesce(F.max(F.col(column) == 1), F.lit(False)).cast("int")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    labels = labels.groupBy("doc_id").agg((marked("quality") + 2 * marked("toxic")).alias("label"))
    known = known.join(labels, "doc_id", "left").join(firsts, ["h", "doc_id"], "left")
    fails = F.col("fails") + F.when(F.col("first"), 0).otherwise(1 << FILTERS.index("E"))
    rows = known.select("part", fails.alias("fails"), F.coalesce("label", F.lit(0)).alias("label"))
    rows = rows.unionByName(features.where("doc_id is null").select("part", "fails", F.lit(0).alias("label")))

    partial = rows.mapInArrow(_count_steps, _PARTIAL)
    sums = partial.groupBy("part", "filter_order").agg(*[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)]).alias(c) for c, n in _ARRAYS.items()])
    sums = materialize(sums, "fa-sums")
    drop_all(docs.sparkSession, since, keep=(sums,))
    here = lambda c: F.get(c, F.col("step") - 1)
    kept = F.aggregate(F.slice("removed", F.col("step") + 1, _STEPS + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return sums.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(_STEPS)))).select(
        "part", "filter_order", "step", F.substring("filter_order", F.col("step"), F.lit(1)).alias("filter_name"), kept.alias("kept"), here("removed").alias("removed"),
        (here("fails") - here("removed")).alias("redundant"), here("unique").alias("unique_fails"), here("good").alias("good_lost"), here("toxic").alias("toxic_lost"), here("shapley").alias("shapley"),
    )
