"""Vector codes against exact whole-number arithmetic."""

import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.llm import vector_codes as vc


def brute(rows):
    """rows (vec_id, embedding, label) -> {vec_id: (code, error, label_error, digest)} in Python's whole numbers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = lambda v: [v[p * len(v) // 8:(p + 1) * len(v) // 8] for p in range(8)]
    parts = [cut(v) for _, v, _ in kept]
    first = [cut(v) for _, v, _ in sorted(kept)[:16]]
    books = [[f[p] for f in first] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (dist(v[p], books[p][e]), e)) for p in range(8)] for v in parts]  # noqa: E731, B023
    for _ in range(6):
        codes = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(parts, codes, strict=True) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(dist(v[p], books[p][c[p]]) for p in range(8)) for v, c in zip(parts, assign(), strict=True)]
    by = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by[lab] = by.get(lab, 0) + e
    return {i: ("".join(f"{x:02x}" for x in c), e, by[lab], digest) for (i, _, lab), c, e in zip(kept, assign(), errors, strict=True)}


def result(df):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def as_floats(v):
    return [float(np.float32(x)) for x in v]


def test_equals_whole_numbers(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 0.2) for _ in range(24)] for _ in range(9)]
    rows = [(i * 3, as_floats([x + rng.gauss(0, 0.02) for x in rng.choice(centres)]), rng.choice([0, 0, 0, 1, None])) for i in range(300)]
    rows += [(5000 + i, rows[7][1], 2) for i in range(50)]  # many equal vectors
    rows += [(9000, None, 1), (9001, [None] * 24, 1), (9002, [float("nan")] * 24, 1), (9003, [float("inf")] + [0.0] * 23, 1), (9004, [0.0] * 24, 1), (9005, [-1e-9] * 24, 1)]
    df = frame(spark, rows).withColumns({c: F.lit("z") for c in ("v", "n", "of", "part", "entry", "sums")}).repartition(6)
    assert result(vc.compress(df)) == brute(rows)


def test_few_ids_ties_and_other_rows(spark):
    rows = [(2, [1.0] * 8, 1), (1, [0.0] * 8, 1), (5, [0.5] * 8, None), (None, [0.5] * 8, None)]
    got = result(vc.compress(frame(spark, [*rows, (7, [1.0] * 16, 3), (8, [1e9] * 8, 3), (9, [], 3), (10, [1.0] * 7, 3)])))
    assert set(got) == {1, 2, 5, None}  # other lengths and components beyond whole numbers go
    assert {k: v for k, v in got.items() if k is not None}[1][0] == "00" * 8
    again = [(3, [0.25] * 8, 0), (3, [0.75] * 8, 0), (3, [0.25] * 8, 0), (4, [0.25] * 8, 0)]
    out = vc.compress(frame(spark, again)).collect()
    assert len(out) == 4 and {r.label_error for r in out} == {sum(r.error for r in out)}
    for none in ([], [(1, None, 1)], [(None, [0.0] * 8, 1)], [(1, [0.0] * 7, 1)]):
        assert vc.compress(frame(spark, none)).count() == 0


def test_many_labels_are_joined(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, as_floats([rng.gauss(0, 1) for _ in range(8)]), rng.choice([None, 0, 0, i])) for i in range(120)]
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 5)
    monkeypatch.setattr(vc, "HOT", 20)
    assert result(vc.compress(frame(spark, rows))) == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 100, 4096, 2**20, 2**26]), st.integers(1, 12), st.integers(1, 16))
def test_nearest_is_exact(seed, size, width, entries):
    rng = np.random.default_rng(seed)
    book = rng.integers(-size, size + 1, (entries, width))
    # near misses: points halfway between entries, and one step off
    i, j = rng.integers(0, entries, (2, 60))
    x = np.clip((book[i] + book[j]) // 2 + rng.integers(-1, 2, (60, width)), -size, size)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert vc.nearest(x, book).tolist() == d.argmin(axis=1).tolist()
