"""Passages against a loop over words; the cache embeds a text once."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import chunk, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def looped(text, size, overlap):
    words = [m.span() for m in WORD.finditer(text or "")]
    out = []
    for i in range(0, len(words), size - overlap):
        if i and i + overlap >= len(words):
            break
        a, b = words[i][0], words[min(i + size, len(words)) - 1][1]
        out.append((a, b, text[a:b]))
    return out


@pytest.mark.parametrize(("size", "overlap", "step"), [(400, 80, 256), (5, 2, 3), (4, 0, 2), (1, 0, 256)])
def test_passages_equal_a_loop(spark, monkeypatch, size, overlap, step):
    monkeypatch.setattr(chunk, "_STEP", step)
    rng = random.Random(size)
    texts = [None, "", " \t\n ", "one", " one\n", "äö 中文 \U0001f600 x"]
    texts += ["".join(rng.choice(["a", "bb", "中", "\U0001f600", " ", "  ", "\n", "\r\n", "\t"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [" ".join("w" for _ in range(n)) for n in (size - 1, size, size + 1, 2 * size - overlap, 2 * size - overlap + 1, 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    got = {}
    for r in passages.passages(docs, size, overlap).orderBy("doc_id", "passage").collect():
        assert r.hash == hashlib.sha256(r.text.encode()).hexdigest() and r.passage == len(got.get(r.doc_id, ()))
        got.setdefault(r.doc_id, []).append((r.first, r.last, r.text))
    assert got == {i: p for i, t in enumerate(texts) if (p := looped(t, size, overlap))}


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and more " * 100_000)], "doc_id long, text string")
    rows = passages.passages(docs).agg(F.count("*").alias("n"), F.max("last").alias("end")).first()
    assert (rows.n, rows.end) == (len(range(0, 300_000 - 80, 320)), 14 * 100_000 - 1)


def test_wrong_sizes():
    for size, overlap in ((4, 4), (0, 0), (4, -1)):
        with pytest.raises(ValueError):
            passages.passages_of(None, size, overlap)


def test_each_text_is_embedded_once(spark, tmp_path):
    cache = passages.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    calls = spark.sparkContext.accumulator(0)

    def embed(df):
        @F.udf("array<float>")
        def vector(text):
            calls.add(1)
            return None if text == "bad" else [float(len(text))]
        return df.withColumn("embedding", vector("text"))

    def texts(*of):
        return spark.createDataFrame([(i, t) for i, t in enumerate(of)], "id int, text string").withColumn("hash", F.sha2("text", 256))

    assert cache.embedded(texts("a")).where("embedding is not null").count() == 0
    first = texts(*["hot"] * 500, "bb", "c", None, "bad", "")
    assert cache.add(first, embed) == 4 and calls.value == 5
    assert cache.add(first.where("text <> 'bad'"), embed) == 0 and calls.value == 5
    second = texts("c", "new", "bb", "new", None, "bad")
    assert cache.add(second, embed) == 1 and calls.value == 7  # the failed one is tried again
    got = sorted((r.id, r.embedding, r.batch) for r in cache.embedded(second).collect())
    assert got == [(0, [1.0], 1), (1, [3.0], 3), (2, [2.0], 1), (3, [3.0], 3), (4, None, None), (5, None, None)]
    assert cache.add(texts(), embed) == 0


def test_a_broken_call_leaves_nothing(spark, tmp_path):
    cache = passages.EmbeddingCache(spark, f"file://{tmp_path}/cache")
    texts = spark.createDataFrame([("a",), ("b",)], "text string").withColumn("hash", F.sha2("text", 256))
    broken = lambda df: df.withColumn("embedding", F.array(F.raise_error("no model").cast("float")))
    with pytest.raises(Exception, match="no model"):
        cache.add(texts, broken)
    assert cache.stored().count() == 0
    assert cache.add(texts, lambda df: df.withColumn("embedding", F.array(F.lit(1.0)))) == 2
