"""Quality rules against plain Python over words; the ratio against counts of the same buckets."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    count = Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "one", "#|<> 😀é ñ\n#|<> 😀é ñ\n\n\n", "a " * 8, "a " * 9, "a b c d e f g h " * 2 + "x y z", "line one\r\nline one\nline one\n line one", "w\x00x " * 30]
    for _ in range(80):
        w = [f"w{rng.randrange(rng.choice([3, 50, 5000]))}" for _ in range(rng.randrange(200))]
        part = w[:rng.randrange(1, 20)]
        out.append(rng.choice([" ", "\n", " # "]).join(w + part * rng.randrange(3)))
    return [*out, out[-1], "v%d " * 40000]


def test_base_rules(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as w", "1 as kept", "2 as n_words", "3 as ratio")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.quality_rules(df, df.limit(0)).collect()}
    for i, t in rows:
        assert got[i] == base(t), repr(t)[:200]


def test_ratio_is_the_mean_of_log_ratios(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words"), (3, "good good"), (None, "bad bad bad"), (4, None)], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (3,), (3,), (None,), (99,)], "doc_id long")
    ratios = qr.log_ratios(docs, trusted, 64)
    b = {r.w: r.b for r in spark.createDataFrame([(w,) for w in ("good", "words", "here", "bad")], "w string").select("w", qr._one(F.col("w"), 64).alias("b")).collect()}
    pair = lambda x, y: spark.range(1).select(qr._two(F.array(F.lit(x), F.lit(y)), F.lit(x), F.lit(0), 64)).first()[0] if y else spark.range(1).select(qr._two(F.array(F.lit(x)), F.lit(x), F.lit(0), 64)).first()[0]
    raw, target = np.zeros(64), np.zeros(64)
    for i, t in ((1, "good words here"), (2, "bad words"), (3, "good good"), (None, "bad bad bad")):
        w = t.split()
        for x, y in zip(w, [*w[1:], ""], strict=True):
            for k in (b[x], pair(x, y)):
                raw[k] += 1
                target[k] += i in (1, 3)
    expected = np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))
    assert np.allclose(ratios, expected)
    monkeypatch.setattr(qr, "BROADCAST_IDS", 0)
    assert np.allclose(qr.log_ratios(docs, trusted, 64), expected)
    got = {r.doc_id: r.ratio for r in qr.score(docs, ratios).collect()}
    assert abs(got[2] - np.mean([expected[k] for k in (b["bad"], b["words"], pair("bad", "words"), pair("words", ""))])) < 1e-12
    assert got[4] == 0.0 and got[1] > got[2]


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = qr.quality_rules(df, df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!.*Scan)", plan)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert qr.quality_rules(none, none).count() == 0
