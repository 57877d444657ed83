"""Line dedup against a plain search for the first occurrence of every run."""

import random
import time

from pyspark.sql import functions as F

from ctxloom.llm import line_dedup

N = line_dedup.RUN_WORDS


def brute(rows):
    """rows (doc_id, h, text): the lines to delete by (doc_id, h)."""
    first, runs = {}, []
    for doc, h, text in rows:
        lines = [(i, x.strip(" \t\r\v\f"), len(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]
        for back in (False, True):
            for i in range(len(lines)):
                at, words = [], 0
                order = range(i, -1, -1) if back else range(i, len(lines))
                for j in order:
                    at.append(j)
                    words += lines[j][2]
                    if words >= N:
                        at.sort()
                        runs.append(((doc is None, doc or 0, h), lines[at[0]][0], lines[at[-1]][0], tuple(lines[k][1] for k in at)))
                        break
    for doc, lo, hi, key in sorted(set(runs)):
        first.setdefault(key, (doc, lo, hi))
    gone = {}
    for doc, lo, hi, key in runs:
        d, _, h = first[key]
        if doc != d or lo > h:
            gone.setdefault((None if doc[0] else doc[1], doc[2]), set()).update(range(lo, hi + 1))
    return {d: sorted(x) for d, x in gone.items()}


def lines_of(spans):
    return [i for s in spans for i in range(s.lo, s.hi + 1)]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 8, 20, 60])))
    passages = ["\n".join(line() for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [line() for _ in range(rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(["same line of words " * 15] * 6)), (104, "menu\nhome\n" * 3), (None, passages[0]), (None, "own\n" + passages[1]), (None, passages[0])]
    rows += [(7, passages[2] + "\nmore"), (7, "other " * 60), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "run", "lo", "n_deleted", "__ld_id", "__other0", "h", "gone", "left", "N_LINES", "a.b")})
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = {(r.doc_id, r.h): lines_of(r.gone) for r in line_dedup.repeated_lines(df).collect()}
    assert got == brute([(d, hashes[t], t) for d, t in rows if t is not None]) and len(got) > 20
    out = line_dedup.dedup_lines(df)
    assert out.columns == [c for c in df.columns if c.lower() not in ("n_lines", "n_deleted")] + ["n_lines", "n_deleted"]

    def left(d, t):
        return t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got.get((d, hashes[t]), ()))

    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    said = sorted(((r.doc_id, r.text, r.n_lines - r.n_deleted) for r in out.collect()), key=key)
    assert said == sorted(((d, left(d, t), 0 if t is None else len(t.split("\n")) - len(got.get((d, hashes[t]), ()))) for d, t in rows), key=key)


def test_rows_of_one_id_lose_nothing_of_their_own(spark):
    a, b = ("\n".join(f"{c}{i} " * 10 for i in range(12)) for c in "ab")
    rows = [(1, a), (5, a), (5, b), (None, b + "\nend"), (2, None)]
    got = {(r.doc_id, r.n_deleted): r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0): a, (5, 12): "", (5, 0): b, (None, 12): "end", (2, 0): None}


def test_long_documents_take_time_in_proportion(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(60_000))
    began = time.time()
    rows = line_dedup.dedup_lines(spark.createDataFrame([("x", text), ("y", "first\n" + text + "\nlast")], "doc_id string, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {"x": text, "y": "first\nlast"} and time.time() - began < 60


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
