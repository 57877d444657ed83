"""Decontamination against all windows of all documents."""

import random
import re
from collections import Counter

from ctxloom.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, item in items:
            q = WORD.findall((item or "").lower())
            b = bag(q)
            if q and any(decontaminate.similarity(b, bag(w[s:s + len(q)])) >= (0.8 if len(q) >= 5 else 1) for s in range(len(w) - len(q) + 1)):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    text = lambda n: [f"t{rng.randrange(2000)}" for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([3, 4, 5, 6, 7, 11, 16, 17, 30, 60, 120, 300])] + [(50, None), (51, "")]
    docs = []
    for i in range(40):
        w = text(rng.randrange(0, 400))
        _, item = items[i % 12]
        q = item.upper().split() if i % 3 else item.split()
        if i % 4 == 3 and len(q) >= 60:
            q[len(q) // 2] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join([*w[:at], *q, *w[at:]]) if i % 5 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[9][1] + " end"), (93, items[9][1]), (94, "x " * 60000 + items[10][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'q' as similarity")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "2 as doc_id")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminations(d, b).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and len(got) > 30


def test_all_within_the_radius_are_candidates():
    import numpy as np

    rng = np.random.default_rng(4)
    index = decontaminate.build_index([(0, " ".join(f"a{i}" for i in range(20)))])
    known = next(iter(index["classes"].values()))
    fp = known[0][:1].repeat(300)
    for i in range(300):
        for bit in rng.choice(64, decontaminate.RADIUS, replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(bit)
    window, entry = decontaminate._candidates(fp, known)
    assert {int(w) for w, e in zip(window, entry, strict=True) if e == 0} == set(range(300))


def test_every_edited_copy_near_the_threshold_is_found():
    import pyarrow as pa

    rng = random.Random(5)
    for n, changed in ((20, 0), (50, 1), (60, 1), (80, 2), (100, 2), (150, 3), (160, 4), (300, 6), (600, 12), (15, 0)):
        for edit in ("replace", "drop", "insert", "cut"):
            item = [f"t{rng.randrange(3000)}" for _ in range(n)]
            texts = []
            for _ in range(40 if n <= 160 else 12):
                q = list(item)
                for at in rng.sample(range(1, n - 1), changed):
                    q[at:at + (edit != "insert")] = [] if edit in ("drop", "cut") else ["changed"]
                if edit == "cut":
                    q[-(n // 20):] = []
                texts.append([f"o{rng.randrange(3000)}" for _ in range(rng.randrange(90))] + q + [f"o{rng.randrange(3000)}" for _ in range(rng.randrange(90))])
            index = decontaminate.build_index([(0, " ".join(item))])
            got = {t for t, *_ in decontaminate.find_hits(pa.array([" ".join(t) for t in texts], pa.string()), index)}
            assert brute([(i, " ".join(t)) for i, t in enumerate(texts)], [(0, " ".join(item))]) <= {(t, 0) for t in got}


def test_repeated_shingles_count_as_often_as_they_occur():
    import pyarrow as pa

    docs = [(0, "x " * 3000), (1, "a b c d e f " * 30), (2, "q " + "a b c d e f " * 5 + "g"), (3, "a b c d e f " * 4)]
    items = [(0, "x " * 20), (1, "a b c d e f " * 5), (2, "a b c d e f a b c d e x x x x x x x x x")]
    got = {(docs[t][0], items[i][0]) for t, i, *_ in decontaminate.find_hits(pa.array([t for _, t in docs], pa.string()), decontaminate.build_index(items))}
    assert brute(docs, items) <= got and (3, 2) not in got and (0, 1) not in got


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.contaminations(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contaminations(one, spark.createDataFrame([], "item_id long, text string")).count() == 0
