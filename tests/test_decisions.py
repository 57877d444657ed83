"""Decisions of a batch equal those of a loop over the candidates, one by one."""

import random

import pytest

from ctxloom.operators import decisions, memory

MEMORY = "id long, user_id string, agent_id string, category string, content string, source string, metadata string, embedding array<float>, updated_at long"
CANDIDATE = "cand_id long, user_id string, agent_id string, content string, embedding array<float>, retracts boolean"


def looped(memories, candidates, limit):
    """(cand_id -> action, contents by id of what is stored, contents of new memories in order)."""
    words = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    state = {m[0]: {"alive": True, "had": {words(m[4])}, "content": m[4]} for m in memories}
    new, out = {}, {}
    for cand, user, agent, content, vector, retracts in sorted(candidates):
        near = [] if vector is None else [(sum((x - y) ** 2 for x, y in zip(m[7], vector, strict=True)) ** 0.5, m[0]) for m in memories if m[7] and (m[1] or "", m[2] or "") == (user or "", agent or "")]
        near = [n for n in near if n[0] <= limit]
        if near:
            s = state[min(near)[1]]
        else:
            s = new.setdefault((user or "", agent or "", words(content)), {"alive": False, "had": set(), "content": None})
        if retracts:
            out[cand] = "DELETE" if s["alive"] else "NOOP"
            s |= {"alive": False, "had": set()}
        elif not s["alive"]:
            out[cand] = "ADD"
            s |= {"alive": True, "had": {words(content)}, "content": content or ""}
        elif words(content) in s["had"]:
            out[cand] = "NOOP"
        else:
            out[cand] = "UPDATE"
            s["had"].add(words(content))
            s["content"] = content or ""
    return out, {i: s["content"] for i, s in state.items() if s["alive"]}, [s["content"] for s in new.values() if s["alive"]]


def row(i, user, agent, content, vector):
    return (i, user, agent, "fact", content, f"s{i}", "{}", vector, 5)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_decisions_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "ID_BLOCK", block)
    rng = random.Random(block)
    owners = [("u1", "a"), ("u2", None), (None, "")]
    said = ["likes tea", "Likes: tea", "likes coffee", "", None, "lives in Rome"]
    memories = [row(i, *rng.choice(owners), rng.choice(said[:3]), [float(i % 7), 0.0] if i % 6 else None) for i in range(1, 20)]
    # a hot memory: a third of all candidates are about one place
    candidates = [(c, *(owners[0] if c % 3 == 0 else rng.choice(owners)), rng.choice(said), [1.0, 0.1] if c % 3 == 0 else rng.choice([[float(rng.randrange(9)), 0.2], None]), rng.choice([True, False, False, None])) for c in range(240)]
    m, c = spark.createDataFrame(memories, MEMORY), spark.createDataFrame(candidates, CANDIDATE)
    got = decisions.decide(m, c).cache()
    want, stored, new = looped(memories, candidates, decisions.LIMIT)
    assert {r.cand_id: r.action for r in got.collect()} == want and set(want.values()) == {"ADD", "UPDATE", "DELETE", "NOOP"}
    after = decisions.apply(m, got, 9).collect()
    assert {r.id: r.content for r in after if r.id < 20} == stored
    assert sorted(r.content for r in after if r.id >= 20) == sorted(new) and sorted(r.id for r in after if r.id >= 20) == list(range(20, 20 + len(new)))


def test_empty_tables(spark):
    m, c = spark.createDataFrame([], MEMORY), spark.createDataFrame([(1, "u", "a", "x", [1.0], None), (2, "u", "a", "X!", None, False)], CANDIDATE)
    got = decisions.decide(m, c)
    assert sorted((r.cand_id, r.action) for r in got.collect()) == [(1, "ADD"), (2, "NOOP")]
    assert [(r.id, r.content, r.user_id) for r in decisions.apply(m, got, 9).collect()] == [(1, "x", "u")]
    m = spark.createDataFrame([row(1, "u", "a", "x", [1.0])], MEMORY)
    assert decisions.apply(m, decisions.decide(m, c.where("false")), 9).collect() == m.collect()
