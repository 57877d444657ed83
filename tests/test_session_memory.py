"""Sessions, memory changes, search, telemetry and sources on small rows."""

import math
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from ctxloom.client import Client
from ctxloom.operators import media, memory, search, session, telemetry
from ctxloom.sources import files

MSG = "session_id string, idx bigint, role string, name string, content string"


def test_micro_compact_keeps_the_last(spark):
    rows = [("s", 0, "user", None, "q"), *[("s", i, "tool", f"t{i}", "r" * 100) for i in (1, 2, 3)], ("s", 4, "tool", None, "ok")]
    got = {r.idx: r.content for r in session.micro_compact(spark.createDataFrame(rows, MSG), 2, 50).collect()}
    assert got == {0: "q", 1: "[Previous: used t1]", 2: "[Previous: used t2]", 3: "r" * 100, 4: "ok"}
    got = session.micro_compact(spark.createDataFrame(rows, MSG), 0, 50).where("content like '[Prev%'").count()
    assert got == 3


@pytest.mark.parametrize("strategy", ["lingua", "llm", "fallback"])
def test_auto_compact(spark, strategy):
    rows = [("big", i, "user", None, "x" * 100) for i in range(5)] + [("small", 0, "user", None, "hi")]
    out = session.auto_compact(spark.createDataFrame(rows, MSG), 100, strategy).collect()
    big = [r for r in out if r.session_id == "big"]
    assert len(big) == 1 and big[0].role == "system" and big[0].content.startswith("Previous conversation summary: ") and len(big[0].content) > 40
    assert [r.content for r in out if r.session_id == "small"] == ["hi"]


def test_fallback_summary(spark):
    text = "\n".join(["[system] s", *[f"[user] u{i}" for i in range(12)]])
    got = spark.createDataFrame([(text,)], "t string").select(session.fallback_summary(F.col("t"))).first()[0]
    assert got == "Conversation summary (13 lines total):\n" + "\n".join(f"[user] u{i}" for i in range(2, 12))


def test_store_cycle_and_isolation(spark, tmp_path):
    store = files.memory_store("parquet", spark=spark, path=str(tmp_path / "m"), now=lambda: 7)
    a, b = Client(spark, store, user_id="u", agent_id="a"), Client(spark, store, user_id="u", agent_id="b")
    a.store_memory("alpha facts here", "s1")
    b.store_memory("beta rules here", "s1", "rule")
    assert a.get_memory("s1").first().content == "alpha facts here"
    assert b.get_memory("s1").first().content == "beta rules here"
    assert [r.content for r in a.search_memory("facts").collect()] == ["alpha facts here"]
    assert b.search_memory("facts").count() == 0
    a.update_memory(2, "not mine")
    a.update_memory(1, "alpha changed")
    assert a.get_memory("s1").first().content == "alpha changed" and b.get_memory("s1").first().content == "beta rules here"
    a.forget_memory(2)
    assert b.list_memories().first().total == 1
    b.forget_memory(2)
    assert b.list_memories().count() == 0 and a.list_memories("rule").count() == 0
    chunks = spark.createDataFrame([("u", "a", "s1", "alpha changed"), ("u", "a", "s2", "new")], "user_id string, agent_id string, source string, content string")
    assert store.sync(chunks) == 1 and store.sync(chunks) == 0
    with pytest.raises(ValueError):
        files.memory_store("other")


def test_pages_are_disjoint(spark):
    rows = [(i, "u", "a", "fact", f"c{i}", f"s{i}", "{}", None, 5) for i in range(10)]
    df = spark.createDataFrame(rows, files.ParquetMemoryStore.SCHEMA)
    pages = [[r.id for r in memory.list_page(df, "u", "a", limit=3, offset=o).collect()] for o in (0, 3, 6, 9)]
    assert sum(pages, []) == list(range(9, -1, -1))


QUERIES = [
    "spark topic", "engine", "nothing here", "Topic 3", "spark OR topic 7", "knowledge NOT spark", "knowledge NOT spark NOT topic", '"spark engine"', '"engine spark engine"', '"item 7 about"', "eng*", '"spark eng"*', '"spark eng" *',
    "source: s1", "source : s1*", "content: s1", "content : spark engine", "topic AND spark OR knowledge NOT engine", "spark engine NOT topic 3", "a OR b OR item", "na\u00efve", "NAIVE", "\u010de\u0161tina", "under_score", '"say ""hi"" now"', "topic topic",
]
BROKEN = ["", None, "AND", "spark AND", "it's", "spark NOT", "* x", "nope: x", "content:", "x :y z", "a.b", '"open', "spark**", "OR x", "a AND OR b"]


@pytest.mark.parametrize("literals", [search.LITERALS, 3])
def test_bm25_equals_sqlite(spark, monkeypatch, literals):
    monkeypatch.setattr(search, "LITERALS", literals)
    texts = [f"knowledge item {i} about topic {i % 10} {'spark engine ' * (i % 4)}" for i in range(60)] + ["a Na\u00efve \u010ce\u0161tina text", "under_score score under", 'they say "hi" now', "", None]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, source)")
    con.executemany("INSERT INTO f(rowid, content, source) VALUES (?, ?, ?)", [(i + 1, t, f"s{i}") for i, t in enumerate(texts)])
    df = spark.createDataFrame([(i + 1, "u", "a", "fact", t, f"s{i}", "{}", None, 0) for i, t in enumerate(texts)], files.ParquetMemoryStore.SCHEMA)
    got = search.bm25(df, spark.createDataFrame(list(enumerate(QUERIES + BROKEN)), "query_id int, query string"), top_k=100).collect()
    for q, text in enumerate(QUERIES):
        expected = {r: abs(s) for r, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (text,))}
        mine = {r.id: r.score for r in got if r.query_id == q}
        assert mine.keys() == expected.keys(), text
        assert all(math.isclose(mine[k], expected[k], rel_tol=1e-6, abs_tol=1e-11) for k in mine), text
    assert {r.query_id for r in got} <= set(range(len(QUERIES)))
    for text in BROKEN[2:]:
        with pytest.raises(sqlite3.OperationalError):
            con.execute("SELECT rowid FROM f WHERE f MATCH ?", (text,)).fetchall()

def test_nearest_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BYTES", 64)  # many passes
    rng = random.Random(2)
    vectors = [[float(rng.randrange(3)) for _ in range(4)] for _ in range(60)]  # with ties
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(99, None)], "id bigint, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(q, vectors[q]) for q in (0, 7, 13, 21)] + [(50, None)], "query_id int, vector array<float>")
    got = sorted((r.query_id, r["rank"], r.id) for r in search.nearest(rows, asked, 6).collect())
    expected = []
    for q in (0, 7, 13, 21):
        near = sorted((math.dist(vectors[q], v), i) for i, v in enumerate(vectors))[:6]
        expected += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert got == expected
    assert search.nearest(rows.limit(0), asked).count() == 0 and search.nearest(rows, asked.limit(0)).count() == 0


def test_ids_are_loaded_within_a_scope(spark):
    rows = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, "u", "a"), (4, None, None)], "id long, user_id string, agent_id string").selectExpr("*", "'fact' category", "'c' content", "'s' source", "'{}' metadata")
    ranked = spark.createDataFrame([(9, 3, 0.9, 1), (9, 2, 0.8, 2), (9, 1, 0.7, 3), (9, 77, 0.6, 4), (9, None, 0.5, 5), (8, 4, 1.0, 1)], "query_id long, id long, score double, rank int")
    got = [(r.query_id, r["rank"], r.id, r.score, r.total) for r in memory.load_ids(rows, ranked, "u", "a").orderBy("rank").collect()]
    assert got == [(9, 1, 3, 0.9, 2), (9, 2, 1, 0.7, 2)]
    assert [r.id for r in memory.load_ids(rows, ranked, None, "").collect()] == [4]
    assert memory.load_ids(rows, ranked.limit(0), "u", "a").count() == 0


def test_fusion(spark):
    rows = lambda x: spark.createDataFrame([(0, i, s, r + 1) for r, (i, s) in enumerate(x)], "query_id int, id bigint, score double, rank int")
    v, t = rows([(1, 0.9), (2, 0.6), (3, 0.3)]), rows([(2, 4.0), (4, 2.0)])
    w = [(r.id, round(r.score, 6)) for r in search.fuse_weighted(v, t, 3).orderBy("rank").collect()]
    assert w == [(2, round(0.7 * 0.6 / 0.9 + 0.3, 6)), (1, 0.7), (3, round(0.7 / 3, 6))]
    r = [x.id for x in search.fuse_rrf(v, t, 4).orderBy("rank").collect()]
    assert r == [2, 1, 4, 3]
    none = rows([(9, 1.0)]).where("id < 0")
    assert search.fuse_rrf(v, none, 5).count() == 3 and search.fuse_weighted(none, none, 5).count() == 0


def test_telemetry_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint, token_count bigint, compression_ratio double, latency_ms double, oom_fallback_count int, processor string, ts timestamp")
    assert telemetry.stats(none).count() == 0 and telemetry.exposition(none).count() == 0 and telemetry.by_processor(none).count() == 0


def test_telemetry_text(spark):
    one = spark.createDataFrame([(1, 10, 0.25, 3.0, 0, "")], "id bigint, token_count bigint, compression_ratio double, latency_ms double, oom_fallback_count int, processor string").withColumn("ts", F.current_timestamp())
    text = telemetry.exposition(one, "x").first()[0]
    assert re.search(r'^x_tokens_total 10$', text, re.M) and 'x_processor_latency_ms{processor="unknown"} 3.00\n' in text and text.endswith("0.2500\n")


def test_transcripts(spark, tmp_path):
    m = spark.createDataFrame([("s1", 0, "user", None, "a"), ("s1", 1, "tool", "t", "b"), ("s2", 0, "user", None, "c")], MSG)
    at = str(tmp_path / "t")
    files.write_transcripts(m, at, 100)
    files.write_transcripts(m.where("session_id = 's1' and idx = 0"), at, 200)
    t = files.read_transcripts(spark, at)
    assert sorted(r.session_id for r in session.sessions(t).collect()) == ["s1", "s2"]
    assert [(r.session_id, r.ts, r.content) for r in session.latest_transcript(t).orderBy("session_id").collect()] == [("s1", 200, "a"), ("s2", 100, "c")]
    assert session.replay(t, 1).count() == 0 and files.delete_transcripts(t, "s1")[0].count() == 1
    assert files.delete_transcripts(t, "s1")[1].first().deleted == 2


def test_summaries_say_what_is_missing(spark):
    t = spark.createDataFrame([("s1", 1, 0, "user", "old words"), ("s1", 2, 0, "user", "new words " * 10), ("s2", 5, None, None, None), ("s3", 1, 0, "user", "   ")], "session_id string, ts bigint, idx bigint, role string, content string")
    asked = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s4",)], "session_id string")
    got = {r.session_id: r.summary for r in session.summaries(t, asked, rate=0.5).collect()}
    text = "[user] " + "new words " * 10
    assert got["s1"] == text[:len(text) // 2] and got["s2"] == "Empty transcript for session s2" and got["s4"] == "No transcript found for session s4"
    assert got["s3"].startswith("Conversation summary (")
    llm = F.when(F.col("session_id") == "s1", F.lit("by a model"))
    assert {r.session_id: r.summary for r in session.summaries(t, asked, "llm", llm=llm).collect()}["s1"] == "by a model"
    assert session.summaries(t, asked, "fallback").where("session_id = 's1'").first().summary.endswith(text.strip())


def test_text_of_multimodal_parts(spark):
    row = spark.createDataFrame([([("text", "a"), ("image_url", "data:x"), ("text", "b")],), ([],), (None,)], "parts array<struct<type:string,text:string>>")
    assert [r[0] for r in row.select(session.text_of_parts(F.col("parts"))).collect()] == ["a\nb", "", None]


def new_rows(spark, *contents, category="fact"):
    return spark.createDataFrame([("u", "a", c, f"s{i}", category, i) for i, c in enumerate(contents)], "user_id string, agent_id string, content string, source string, category string, pos bigint")


def test_of_two_writers_one_wins(spark, tmp_path):
    at = str(tmp_path / "m")
    a, b = (files.ParquetMemoryStore(spark, at, lambda: 7) for _ in range(2))
    a.store(new_rows(spark, "one"))
    before = b.version()
    a.store(new_rows(spark, "two"))
    b.version = lambda: before  # still sees the version before
    for change in (lambda: b.store(new_rows(spark, "lost")), lambda: b.forget(spark.createDataFrame([(1, "u", "a")], "id bigint, user_id string, agent_id string"))):
        with pytest.raises(OSError):
            change()
    del b.version
    b.store(new_rows(spark, "three", "four"))
    assert [(r.id, r.content) for r in a.read().orderBy("id").collect()] == [(1, "one"), (2, "two"), (3, "three"), (4, "four")]
    folders = len(list((tmp_path / "m").glob("rows-*")))
    a.vacuum()
    assert folders == 5 and len(list((tmp_path / "m").glob("rows-*"))) == 3 and b.read().count() == 4


def test_other_stores(spark, tmp_path):
    store = files.memory_store("post_filter", spark=spark, path=str(tmp_path / "p"))
    store.store(new_rows(spark, "alpha word", "beta word").unionByName(new_rows(spark, "gamma word", category="rule").withColumn("pos", F.lit(9).cast("long"))))
    assert [r.source for r in store.list().collect()] == ["external:3", "external:2", "external:1"] and store.list(category="rule").first().total == 1
    assert store.search("word", 3, "u", category="rule").count() == 1 and store.search("word", 2, "u", category="rule").count() == 0 and store.search("word", 3, "v").count() == 0
    store.update(spark.createDataFrame([(2, "changed")], "id bigint, content string"))
    store.forget(spark.createDataFrame([(1,)], "id bigint"))
    assert store.get("external:2").first().content == "changed" and store.get("1").count() == 0
    made = []
    files.register_store("mine", lambda **how: made.append(how) or store)
    assert files.memory_store("mine", x=1) is store and made == [{"x": 1}]
    client = Client(spark, store, user_id="u")
    assert client.get_memory("9").first().error == "Not found" and client.get_memory("2").first().error is None
    assert client.search_memory("gamma").columns == ["query_id", "rank", "score", "id", "content", "source", "category"]


def test_telemetry_log(spark, tmp_path):
    log = files.TelemetryLog(spark, str(tmp_path / "t"))
    assert log.read().count() == 0
    log.record(spark.createDataFrame([(10, "p"), (5, None)], "token_count bigint, processor string"))
    log.record(spark.createDataFrame([(1,)], "token_count bigint"))
    assert telemetry.stats(log.read()).first().total_tokens == 16 and telemetry.by_processor(log.read()).count() == 2
    log.reset()
    assert log.read().count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# A\nx")
    (tmp_path / "d/b.bin").write_bytes(b"\xff")
    assert [r.content for r in files.read_markdown(spark, str(tmp_path / "d/*.md")).collect()] == ["# A\nx"]
    def reader(path, data):
        if path.endswith("bin"):
            raise OSError
        return "read"
    assert sorted(r.text for r in files.read_documents(spark, str(tmp_path / "d"), reader).collect()) == ["", "read"]
    assert sorted(r.text for r in files.read_documents(spark, str(tmp_path / "d"), reader, lambda *_: " ", lambda *_: "last").collect()) == ["last", "read"]


def test_embeddings_by_a_function(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id bigint, content string")
    assert [r.embedding for r in memory.with_embeddings(df, lambda texts: [[float(len(t))] for t in texts]).orderBy("id").collect()] == [[2.0], None, [3.0]]
    assert memory.with_embeddings(df, lambda texts: 1 / 0).where("embedding is not null").count() == 0


def test_media(spark):
    one = spark.range(1)
    f = lambda total, fps: one.select(media.frame_indexes(F.lit(total), F.lit(fps), 1.0, 4)).first()[0]
    assert f(300, 30) == [0, 75, 150, 225] and f(3, 30) == [0] and f(0, 30) == [] and f(2, 1) == [0, 1]
    w, h = media.scaled(F.lit(2048), F.lit(1000))
    assert tuple(one.select(w, h).first()) == (1024, 500)
