"""Common lines against a count in Python, whatever the sketch's size; sketches merge."""

import random
from collections import Counter, defaultdict

import pytest

from ctxloom.operators import boilerplate as B

SCHEMA = "doc_id long, source string, text string, line string"


def counted(rows, least, percent):
    docs, n = Counter(), defaultdict(Counter)
    for _, source, text, _ in rows:
        docs[source or ""] += 1
        n[source or ""].update({x for x in (y.strip(" \t\r\v\f") for y in (text or "").split("\n")) if x})
    return {(s, x, k, docs[s]) for s, c in n.items() for x, k in c.items() if k >= least and 100 * k >= percent * docs[s]}


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice(["hot", "hot", "s1", "s2", "", None])
        lines = [f"{source} footer", "\t© all rights \r", "", "  "] * rng.randrange(3) + [f"line {rng.randrange(300)}" for _ in range(rng.randrange(6))] + [f" menu {rng.randrange(4)}"]
        rng.shuffle(lines)
        rows.append((i, source, rng.choice(["\n".join(lines)] * 9 + [None, "", "\n"]), "x"))
    return rows + rows[:20]  # repeated rows


@pytest.mark.parametrize(("width", "counters", "line_bytes"), [(1 << 16, 10**6, 1 << 20), (16, 10**6, 0), (1 << 16, 0, 0)])
def test_lines_and_texts_equal_a_count(spark, monkeypatch, width, counters, line_bytes):
    monkeypatch.setattr(B, "WIDTH", width)
    monkeypatch.setattr(B, "COUNTERS", counters)
    monkeypatch.setattr(B, "LINE_BYTES", line_bytes)
    rows = corpus(width)
    docs = spark.createDataFrame(rows, SCHEMA)
    common = B.common_lines(docs, 5, 10)
    want = counted(rows, 5, 10)
    assert {tuple(r) for r in common.collect()} == want and len(want) > 8
    held = {(s, x) for s, x, *_ in want}
    expect = []
    for i, source, text, line in rows:
        left = None if text is None else [x for x in text.split("\n") if (source or "", x.strip(" \t\r\v\f")) not in held]
        expect.append((i, source, left if left is None else "\n".join(left), line, None if left is None else len(text.split("\n")) - len(left)))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = B.stripped(docs, common)
    assert got.columns == ["doc_id", "source", "text", "line", "n_removed"]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expect, key=key)


def test_sketches_merge_and_never_count_low(spark, monkeypatch):
    monkeypatch.setattr(B, "WIDTH", 64)
    rows = corpus(3)
    docs = spark.createDataFrame(rows, SCHEMA)
    parts = B.sketch(docs.where("doc_id < 150")).unionByName(B.sketch(docs.where("doc_id >= 150")))
    merged = parts.groupBy("source", "slot").agg({"n": "sum"}).toDF("source", "slot", "n")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, B.sketch(docs).collect()))
    assert {tuple(r) for r in B.common_lines(docs, 5, 10, merged).collect()} == counted(rows, 5, 10)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert B.common_lines(none).count() == 0 and B.stripped(none, B.common_lines(none)).count() == 0
    long = "\n".join(f"own {i}" for i in range(200_000))
    docs = spark.createDataFrame([(i, "s", f"{long}\nshared" if i == 0 else "shared\nx" + str(i), None) for i in range(6)], SCHEMA)
    common = B.common_lines(docs, 5, 90)
    assert [tuple(r) for r in common.collect()] == [("s", "shared", 6, 6)]
    got = {r.doc_id: (r.text, r.n_removed) for r in B.stripped(docs, common).collect()}
    assert got[0] == (long, 1) and got[1] == ("x1", 1)
