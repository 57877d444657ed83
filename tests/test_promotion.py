"""Fading counts in many batches equal those of the whole log; scores equal a loop."""

import random

import pytest

from ctxloom.operators import promotion as P

MEMORY = "id long, user_id string, agent_id string, category string, content string, source string, metadata string, embedding array<float>, updated_at long"


def test_batches_equal_the_whole_log(spark):
    rng = random.Random(5)
    log = [(7 if rng.random() < 0.4 else rng.randrange(20), 1_700_000_000 + rng.randrange(40 * 86_400)) for _ in range(600)]
    log += log[:9] + [(None, 5), (3, None)]
    state, ends = None, [1_700_000_000 + d * 86_400 for d in (10, 20, 30, 41)]
    for k, end in enumerate(ends):  # batches mix early and late accesses
        state = P.counted(state, spark.createDataFrame(log[k::4], "id long, at long"), end)
        state = spark.createDataFrame(state.collect(), P.STATE)
    want, n = {}, {}
    for i, at in log:
        if i is not None and at is not None:
            want[i], n[i] = want.get(i, 0) + 2 ** (-(ends[-1] - at) / P.HALF_LIFE), n.get(i, 0) + 1
    got = {r.id: r for r in state.collect()}
    assert {i: r.n for i, r in got.items()} == n and {r.as_of for r in got.values()} == {ends[-1]}
    assert all(got[i].weight == pytest.approx(w, rel=1e-9) for i, w in want.items())


def test_scores_equal_a_loop(spark):
    rng = random.Random(2)
    kinds = [*P.IMPORTANCE, "odd", None]
    rows = [(i, rng.choice(["u", None]), rng.choice(["a", "b"]), rng.choice(kinds), "c", "s", "{}", rng.choice([[rng.randrange(4) / 3, 0.5], [rng.random(), rng.random()], None]), 1) for i in range(40)]
    rows.append((99, "alone", "a", "rule", None, "s", "{}", [0.0, 0.0], 1))
    m = spark.createDataFrame(rows, MEMORY)
    state = spark.createDataFrame([(i, i / 4, 1, 0) for i in range(0, 40, 3)], P.STATE)
    got = {r.id: r for r in P.promoted(m, m, state).collect()}
    assert set(got) == {r[0] for r in rows}
    for r in rows:
        near = [sum((x - y) ** 2 for x, y in zip(r[7], o[7], strict=True)) ** 0.5 for o in rows if r[7] and o[7] and o[0] != r[0] and (o[1], o[2]) == (r[1], r[2])]
        w = r[0] / 4 if r[0] < 40 and r[0] % 3 == 0 else 0.0
        parts = (P.IMPORTANCE.get(r[3], P.OTHER), w / (1 + w), min(1.0, *near, 1.0))
        g = got[r[0]]
        assert (g.importance, g.persistence, g.uniqueness) == pytest.approx(parts, abs=1e-6)
        assert g.score == pytest.approx(sum(a * b for a, b in zip(P.WEIGHTS, parts, strict=True)), abs=1e-6) and g.promote == (g.score >= P.THRESHOLD)


def test_empty(spark):
    none, state = spark.createDataFrame([], MEMORY), spark.createDataFrame([], P.STATE)
    assert P.promoted(none, none, state).count() == 0
    assert P.counted(None, spark.createDataFrame([], "id long, at long"), 5).count() == 0
    one = spark.createDataFrame([(1, "u", "a", "rule", "x", "s", "{}", [1.0], 1)], MEMORY)
    assert [tuple(r)[1:4] for r in P.promoted(one, one, state, importance={}).collect()] == [(P.OTHER, 0.0, 1.0)]
