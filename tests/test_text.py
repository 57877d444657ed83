"""Column functions and chunks against plain Python specifications on random text."""

import random
import re

from pyspark.sql import functions as F

from ctxloom.functions import text as X
from ctxloom.operators import chunk, distill

STOPS = set(X.STOP_WORDS)


def spec_l0(t):
    t = re.sub(r"[^\w\s一-鿿.,!?;:]", "", re.sub(r"\s+", " ", t))
    return " ".join(w for w in t.split() if w.lower() not in STOPS)


def spec_l1(t, r=0.5):
    s = [x.strip() for x in re.split(r"(?<=[.!?。！？])\s+", t) if x.strip()]
    if not s:
        return t
    scored = sorted(((len(set(x.lower().split())) / len(x.split()), -i) for i, x in enumerate(s)), reverse=True)
    kept = [-i for _, i in scored[:max(1, int(len(s) * (1 - r)))]]
    return " ".join(x for _, _, x in sorted((s.index(s[i]), i, s[i]) for i in kept))


def spec_l3(t):
    s = t.split("。")
    return "。".join(s[:max(1, len(s) // 5)]) + "。"


def texts():
    rng = random.Random(5)
    words = ["the", "An", "alpha", "beta,", "gamma.", "delta!", "x?", "测试。", "句子。", "#tag", "e–f", "\n", "  ", "word"]
    return ["", " ", "a.", "One. One. Two words here. One."] + [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_levels_equal_their_specifications(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, t string")
    t = F.col("t")
    got = rows.select("t", X.l0_clean(t).alias("l0"), X.l1_select(t).alias("l1"), X.l2_truncate(t).alias("l2"), X.l3_lead(t).alias("l3"), X.tokens(t).alias("n")).collect()
    for r in got:
        assert r.l0 == spec_l0(r.t)
        assert r.l1 == spec_l1(r.t)
        assert r.l2 == r.t[:int(len(r.t) * 0.4)]
        assert r.l3 == spec_l3(r.t)
        assert r.n == len(r.t) // 4


def test_types(spark):
    cases = {"data:x": "data_uri", "https://a/b.png": "url", "a.MP3": "audio", "b.mkv": "video", "c.JPEG": "image", "d.pdf": "document", "see readme.md": "document", "plain": "text", "a.md\n": "text"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.detect_type(F.col("t")).alias("k"), X.resolve_type(F.col("t"), True).alias("r")).collect()
    assert {r.t: r.k for r in rows} == cases
    assert {r.t: r.r for r in rows}["c.JPEG"] == "document"
    assert {r.t: r.r for r in rows}["https://a/b.png"] == "document"


def spec_chunks(text):
    out, start = [], 0
    bounds = [m.start() for m in re.finditer(r"\n#{1,3}\s|\n\n", text)]

    def force(t, at):
        cur, n = [], 0
        for w in t.split():
            cur.append(w)
            n += len(w) + 1
            if n > 1200:
                out.append((f"Segment @ {at}", " ".join(cur)))
                cur, n = [], 0
        if cur:
            out.append((f"Segment @ {at}", " ".join(cur)))

    def title(b):
        line = b.split("\n", 1)[0].strip()
        return line[:50] + "..." if len(line) > 50 else line

    for b in bounds:
        body = text[start:b].strip()
        if b - start > 1200:
            force(text[start:b], start)
        elif len(body) > 200:
            out.append((title(body), body))
        start = b
    body = text[start:].strip()
    if len(body) > 1200:
        force(body, start)
    elif body:
        out.append((title(body), body))
    return out


def test_chunks_on_random_markdown(spark):
    rng = random.Random(9)
    pieces = ["\n", "\n\n", "\n\n\n", "\n# ", "\n### T ", "\n#### ", "w " * 90, "long " * 150, "x" * 200, "y" * 201, "z" * 1200, "q" * 1201, "heading " * 9, "\r\n"]
    docs = ["", "\n\n", "a"] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 13))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(999, None)], "doc_id bigint, text string")
    got = {}
    for r in chunk.smart_chunks(rows).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.title, r.text))
    for i, t in enumerate(docs):
        assert [c[1:] for c in sorted(got.get(i, []))] == spec_chunks(t)


def test_heading_chunks(spark):
    body = "intro\n# One\ntext\n## Two\n### Three\n#### four\n\n# Last  "
    rows = spark.createDataFrame([("f.md", body), ("g.md", "# Only"), ("e.md", "")], "path string, content string")
    got = sorted((r.source, r.content) for r in chunk.heading_chunks(rows).collect())
    assert got == [("f.md#L1", "intro"), ("f.md#L2", "# One\ntext"), ("f.md#L4", "## Two"), ("f.md#L5", "### Three\n#### four"), ("f.md#L8", "# Last"), ("g.md#L1", "# Only")]


def test_model_hook_comes_before_the_fallback(spark):
    distill.use_model("L2", lambda c: F.when(c.startswith("m"), F.lit("model")))
    try:
        rows = spark.createDataFrame([(0, 0, "mmmm"), (0, 1, "abcdefghij")], "request_id int, pos int, item string")
        got = distill.results(distill.distill(rows)).first()
        assert [p.content for p in got.prompt] == ["model", "abcd"]
    finally:
        distill.use_model("L2", None)


def test_scores_of_a_model_choose_sentences(spark):
    text = "One two. Three four five. Six. Seven eight."
    row = spark.createDataFrame([(text, [0.1, 0.9, 0.9, 0.2])], "t string, v array<double>")
    s = X.sentences(F.col("t"))
    assert row.select(X.l1_by_scores(s, F.col("v"), 0.5)).first()[0] == "Three four five. Six."
    assert row.select(X.l1_select(F.col("t"), 0.5, score=lambda x: F.length(x))).first()[0] == "Three four five. Seven eight."
    assert row.select(X.preview(F.col("t"), 7)).first()[0] == "One two"


def test_readers_by_type(spark):
    distill.use_reader("document", lambda c: F.concat(F.lit("read "), c))
    try:
        rows = spark.createDataFrame([(0, 0, "a.pdf"), (0, 1, "b.mp3"), (0, 2, "plain text")], "request_id int, pos int, item string")
        got = distill.distill(rows, rate=0.5).orderBy("pos").collect()
        assert [(r.content, r.input_tokens, r.output_tokens) for r in got] == [("read ", 2, 1), ("b.mp3", None, None), ("plain", 2, 1)]
    finally:
        distill.use_reader("document", None)
