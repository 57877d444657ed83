"""The filter audit against filters that run one after the other."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """Every order, with real removals."""
    texts = [(i, s or "", t or "") for i, t, s in docs]

    def fails(f, row):
        i, _, t = row
        w = WORD.findall(t)
        return {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and t == u for j, _, u in texts),
        }[f]

    failing = [{f for f in "ABCDE" if fails(f, row)} for row in texts]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    out = {}
    for part in {s for _, s, _ in texts}:
        own = [(i, f) for (i, s, _), f in zip(texts, failing, strict=True) if s == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                lost = lambda ids: sum(i in ids for i, _ in gone if i is not None)  # noqa: E731, B023
                out[part, "".join(order), step] = [f, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), lost(good), lost(toxic)]
    for (part, order, step), row in out.items():
        row.append(sum(r[2] for (p, _, _), r in out.items() if p == part and r[0] == row[0]))
    return {k: tuple(v) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r.filter_order, r.step): (r.filter_name, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus(rng, n):
    docs = []
    for i in range(n):
        w = [f"w{rng.randrange(rng.choice([5, 500]))}" for _ in range(rng.choice([3, 49, 50, 80]))]
        text = " ".join(w) + rng.choice(["", "", " é|", " ABCDEFGHIJ KLMNOP"])
        docs.append((i, rng.choice([text, text, *([d[1] for d in docs[-20:]] or [text]), None, ""]), rng.choice(["hot", "hot", "x", "", None])))
    return docs


def test_equals_filters_run_in_turn(spark):
    rng = random.Random(4)
    docs = corpus(rng, 150)
    docs += [(None, docs[3][1], "x"), (None, "few words", "x"), docs[5], docs[5], (7, "another text of id 7", "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(2, 1, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("z") for c in ("part", "h", "fails", "label", "first")}).repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("label", F.lit("z"))
    got = rows_of(filter_audit.audit(d, lab))
    assert len(got) == 600 * 3
    assert got == brute(docs, labels)


def test_more_parts_than_a_task_holds(spark, monkeypatch):
    rng = random.Random(8)
    docs = [(i, t, f"s{rng.randrange(40)}") for i, t, _ in corpus(rng, 120)]
    parts = {s for _, _, s in docs}
    counted = []
    monkeypatch.setattr(filter_audit, "PARTS", 3)

    def batches():
        import pyarrow as pa

        for at in range(0, 120, 25):
            some = docs[at:at + 25]
            yield pa.RecordBatch.from_pydict({"part": [s for _, _, s in some], "fails": pa.array([i % 32 for i, _, _ in some], pa.int32()), "label": pa.array([i % 4 for i, _, _ in some], pa.int32())})

    for batch in filter_audit._count_steps(batches()):
        counted += batch.select(["part", "filter_order", "removed", "good", "unique"]).to_pylist()
    assert {r["part"] for r in counted} == parts
    total = {}
    for r in counted:
        total[r["filter_order"]] = total.get(r["filter_order"], 0) + np.array(r["removed"])
    for order, removed in total.items():
        expected = np.zeros(6, int)
        for i, _, _ in docs:
            expected[next((k for k, f in enumerate(order) if i % 32 >> "ABCDE".index(f) & 1), 5)] += 1
        assert removed.tolist() == expected.tolist()


def test_table_of_first_failures():
    assert filter_audit.FIRST.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            assert filter_audit.FIRST[mask, k] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


def test_empty_tables(spark):
    empty, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).count() == 0
    one = rows_of(filter_audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), labels))
    assert one == brute([(1, None, None)], [])
