"""Registry of the engine's own queries over the supplied tables, and of the SQL that gives the same rows.

Doubles are rounded to six places on both sides. Nothing here imports the training-data subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import boilerplate, chunk, decisions, distill, media, memory, passages, postings, promotion, search, session, telemetry, vectors
from .plans import views as V
from .sources.shared import shared_folder
from .streaming import sessions, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The query set of a search is every row whose id this divides, against all rows.
EVERY = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents")


# --- text -----------------------------------------------------------------------------------------------------------

STOPS = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
L0 = (
    "array_to_string(list_filter(string_split_regex(trim(regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), "
    "'[^\\pL\\pN_\\s\\x{{4e00}}-\\x{{9fff}}.,!?;:]', '', 'g')), '\\s+'), lambda x: x <> '' AND lower(x) NOT IN " + STOPS + "), ' ')"
)
L2 = "substring({c}, 1, CAST(floor(length({c}) * CAST({rate} AS DOUBLE)) AS BIGINT))"
L3 = "concat(array_to_string(list_slice(string_split({c}, '。'), 1, greatest(1, len(string_split({c}, '。')) // 5)), '。'), '。')"
L1_CTES = """sent AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
 flat AS (SELECT doc_id, s, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM sent),
 ranked AS (SELECT doc_id, s, x, i, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len(list_distinct(string_split_regex(lower(x), '\\s+'))) AS DOUBLE) / len(string_split_regex(x, '\\s+')) DESC, i) AS r FROM flat),
 l1 AS (SELECT doc_id, string_agg(x, ' ' ORDER BY list_position(s, x), i) AS out FROM ranked WHERE r <= greatest(1, CAST(floor(len(s) * CAST(0.5 AS DOUBLE)) AS BIGINT)) GROUP BY doc_id)"""
RATIO = "CASE WHEN {i} > 0 THEN round(1 - CAST({o} AS DOUBLE) / {i}, 6) ELSE 0.0e0 END"


@query(f"SELECT doc_id, {L0.format(c='text')} AS out FROM documents")
def text_l0_clean(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.l0_clean(F.col("text")).alias("out"))


@query(f"""WITH t AS (SELECT lang, length(text) // 4 AS i, length({L0.format(c='text')}) // 4 AS o FROM documents)
 SELECT lang, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, {RATIO.format(i='sum(i)', o='sum(o)')} AS compression_ratio FROM t GROUP BY lang""")
def text_l0_stats(spark, sf_dir):
    return distill.level_stats(_docs(spark, sf_dir), "L0", ["lang"])


@query(f"WITH {L1_CTES} SELECT d.doc_id, coalesce(l1.out, d.text) AS out FROM documents d LEFT JOIN l1 USING (doc_id)")
def text_l1_selective(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.l1_select(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {L2.format(c='text', rate=0.4)} AS out FROM documents")
def text_l2_truncate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.l2_truncate(F.col("text")).alias("out"))


@query(f"SELECT doc_id, {L3.format(c='text')} AS out FROM documents")
def text_l3_lead(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.l3_lead(F.col("text")).alias("out"))


@query(f"""WITH {L1_CTES}, t AS (SELECT d.lang, d.text, {L0.format(c='d.text')} AS l0, coalesce(l1.out, d.text) AS l1, {L2.format(c='d.text', rate=0.4)} AS l2, {L3.format(c='d.text')} AS l3 FROM documents d LEFT JOIN l1 USING (doc_id)),
 u AS (SELECT lang, length(text) // 4 AS i, unnest(['L0', 'L1', 'L2', 'L3']) AS level, unnest([length(l0) // 4, length(l1) // 4, length(l2) // 4, length(l3) // 4]) AS o FROM t)
 SELECT lang, level, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, {RATIO.format(i='sum(i)', o='sum(o)')} AS compression_ratio FROM u GROUP BY lang, level""")
def text_levels_compare(spark, sf_dir):
    return distill.compare_levels(_docs(spark, sf_dir), "lang")


def _suffix(c: str, s: tuple) -> str:
    return "(" + " OR ".join(f"ends_with({c}, '{x}')" for x in s) + ")"


TYPE_SQL = f"""CASE WHEN starts_with(item, 'data:') THEN 'data_uri' WHEN starts_with(item, 'http://') OR starts_with(item, 'https://') THEN 'url'
 WHEN {_suffix('lower(item)', X.AUDIO)} THEN 'audio' WHEN {_suffix('lower(item)', X.VIDEO)} THEN 'video' WHEN {_suffix('lower(item)', X.IMAGE)} THEN 'image' WHEN {_suffix('lower(item)', X.DOCUMENT)} THEN 'document' ELSE 'text' END"""
RESOLVED_SQL = f"CASE kind WHEN 'data_uri' THEN 'image' WHEN 'url' THEN CASE WHEN {_suffix('lower(item)', X.URL_IMAGE)} THEN 'image' ELSE 'text' END ELSE kind END"


@query(f"WITH {V.ITEMS_SQL}, t AS (SELECT pos, item, {TYPE_SQL} AS kind FROM items) SELECT pos, kind, {RESOLVED_SQL} AS resolved FROM t")
def detect_type(spark, sf_dir):
    return V.items(spark, sf_dir).select("pos", X.detect_type(F.col("item")).alias("kind"), X.resolve_type(F.col("item")).alias("resolved"))


@query(f"""WITH {V.ITEMS_SQL}, t AS (SELECT pos, item, {TYPE_SQL} AS kind FROM items), u AS (SELECT pos, {RESOLVED_SQL} AS kind FROM t)
 SELECT pos, CASE kind WHEN 'text' THEN CASE pos % 4 WHEN 0 THEN 'text/regex' WHEN 1 THEN 'text/selective' WHEN 2 THEN 'text/lingua' ELSE 'text/summary' END
  WHEN 'document' THEN CASE WHEN pos % 5 = 2 AND pos % 2 = 0 THEN 'document/docling' WHEN pos % 5 = 3 THEN 'document/vlm' WHEN pos % 5 = 4 THEN 'document/ocr' ELSE 'document/native' END
  WHEN 'image' THEN CASE WHEN pos % 2 = 0 THEN 'vision/roi' ELSE 'vision/dedup' END WHEN 'audio' THEN 'audio/stt' ELSE 'video/frames' END AS processor FROM u""")
def route_processor(spark, sf_dir):
    p = F.col("pos")
    level = F.concat(F.lit("L"), (p % 4).cast("string"))
    backends = F.array(*[F.lit(x) for x in ("markitdown", "pymupdf", "docling", "vlm", "deepseek")])
    return V.items(spark, sf_dir).select("pos", distill.route(F.col("item"), level, F.get(backends, (p % 5).cast("int")), p % 2 == 0).alias("processor"))


@query(f"""WITH t AS (SELECT source, length(text) // 4 AS i, length({L2.format(c='text', rate=0.4)}) // 4 AS o FROM documents)
 SELECT source, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, {RATIO.format(i='sum(i)', o='sum(o)')} AS compression_ratio FROM t GROUP BY source""")
def distill_batch_stats(spark, sf_dir):
    return distill.level_stats(_docs(spark, sf_dir), "L2", ["source"])


@query(f"""WITH {V.ITEMS_SQL}, t AS (SELECT pos, item, {TYPE_SQL} AS kind FROM items), u AS (SELECT pos, item, {RESOLVED_SQL} AS kind FROM t),
 v AS (SELECT pos % 7 AS request_id, pos, kind, CASE WHEN kind = 'text' THEN {L2.format(c='item', rate=0.4)} ELSE item END AS content, CASE WHEN kind = 'text' THEN length(item) // 4 END AS i, CASE WHEN kind = 'text' THEN length({L2.format(c='item', rate=0.4)}) // 4 END AS o FROM u)
 SELECT request_id, string_agg(concat(kind, ':', content), '|' ORDER BY pos) AS prompt, CAST(coalesce(sum(i), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o), 0) AS BIGINT) AS output_tokens,
  CASE WHEN coalesce(sum(i), 0) > 0 THEN round(1 - CAST(sum(o) AS DOUBLE) / sum(i), 6) ELSE 0.0e0 END AS compression_ratio FROM v GROUP BY request_id""")
def distill_requests(spark, sf_dir):
    items = V.items(spark, sf_dir).withColumn("request_id", F.col("pos") % 7)
    done = distill.results(distill.distill(items, "balanced"))
    text = F.array_join(F.transform("prompt", lambda x: F.concat(x["type"], F.lit(":"), x["content"])), "|")
    return done.select("request_id", text.alias("prompt"), "input_tokens", "output_tokens", F.round("compression_ratio", 6).alias("compression_ratio"))


@query(f"WITH {V.ITEMS_SQL}, t AS (SELECT pos, item, {TYPE_SQL} AS kind FROM items), u AS (SELECT pos, item, {RESOLVED_SQL} AS kind FROM t) SELECT pos, kind, CASE kind WHEN 'image' THEN 85 WHEN 'audio' THEN 2500 WHEN 'video' THEN 5000 ELSE length(item) // 4 END AS tokens FROM u")
def item_token_estimate(spark, sf_dir):
    kind = X.resolve_type(F.col("item"))
    return V.items(spark, sf_dir).select("pos", kind.alias("kind"), media.estimated_tokens(kind, F.col("item")).alias("tokens"))


@query(f"""WITH {V.ITEMS_SQL} SELECT pos, item, CASE WHEN {_suffix('lower(item)', distill.PIXEL)} AND pos % 4 < 2 THEN 'pixel' ELSE 'distill' END AS handling FROM items""")
def attachment_split(spark, sf_dir):
    mode = F.when(F.col("pos") % 4 < 2, "pixel").otherwise("semantic")
    return distill.attachments(V.items(spark, sf_dir).withColumnRenamed("item", "path"), mode).select("pos", F.col("path").alias("item"), "handling")


# --- documents ------------------------------------------------------------------------------------------------------

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
PACKS = "list_filter(list_transform(regexp_extract_all(concat(array_to_string(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''), ' '), ' '), '(?s:.{{1000}})(?s:.{{200}})[^ ]* |(?s:.+)'), lambda p: rtrim(p)), lambda p: p <> '')"
CHUNK_CTES = f"""cut AS (SELECT doc_id, unnest(ps) AS raw, unnest(range(0, len(ps))) AS i, len(ps) - 1 AS last FROM (SELECT doc_id, string_split(regexp_replace({{text}}, '(\n#{{{{1,3}}}}\\s|\n\n)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM documents)),
 body AS (SELECT *, {STRIP.format(c='raw')} AS body, coalesce(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM cut),
 parts AS (SELECT doc_id, i, body, start, CASE WHEN CASE WHEN i < last THEN length(raw) ELSE length(body) END > 1200 THEN {PACKS.format(c='CASE WHEN i < last THEN raw ELSE body END').replace('{{', '{').replace('}}', '}').replace('{', '{{').replace('}', '}}')}
   WHEN length(body) > CASE WHEN i < last THEN 200 ELSE 0 END THEN [body] ELSE [] END AS ts, CASE WHEN i < last THEN length(raw) ELSE length(body) END > 1200 AS forced FROM body),
 each AS (SELECT doc_id, i, start, forced, unnest(ts) AS text, unnest(range(0, len(ts))) AS j FROM parts),
 chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS INT) AS chunk, text,
   CASE WHEN forced THEN concat('Segment @ ', CAST(start AS VARCHAR)) WHEN length(trim(string_split(text, chr(10))[1])) > 50 THEN concat(substring(trim(string_split(text, chr(10))[1]), 1, 50), '...') ELSE trim(string_split(text, chr(10))[1]) END AS title FROM each)"""
SECTIONS = "replace(replace(text, '. ', concat('.', chr(10), chr(10))), ', ', concat(',', chr(10), '## '))"


@query(f"WITH {CHUNK_CTES.format(text='text')} SELECT doc_id, chunk, title, text FROM chunks")
def doc_smart_chunk(spark, sf_dir):
    return chunk.smart_chunks(_docs(spark, sf_dir))


@query(f"WITH {CHUNK_CTES.format(text=SECTIONS)} SELECT doc_id, chunk, title, text FROM chunks")
def doc_section_chunk(spark, sf_dir):
    """Documents with a blank line behind every sentence and a heading behind every comma."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit(", "), F.lit(",\n## "))
    return chunk.smart_chunks(_docs(spark, sf_dir).select("doc_id", text.alias("text")))


@query(f"WITH p AS (SELECT doc_id, {PACKS.format(c='text')} AS ts FROM documents) SELECT doc_id, CAST(unnest(range(0, len(ts))) AS INT) AS chunk, 'Segment @ 0' AS title, unnest(ts) AS text FROM p")
def doc_force_split(spark, sf_dir):
    return chunk.split_documents(_docs(spark, sf_dir))


@query(f"""WITH {CHUNK_CTES.format(text='text')}, z AS (SELECT doc_id, chunk, text, {L2.format(c='text', rate=0.4)} AS z FROM chunks),
 d AS (SELECT doc_id, string_agg(z, chr(10) || chr(10) ORDER BY chunk) AS text, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS raw_length, CAST(sum(length(z)) AS BIGINT) AS compressed_length FROM z GROUP BY doc_id)
 SELECT doc_id, text, chunk_count, raw_length, compressed_length, raw_length // 4 AS input_tokens, compressed_length // 4 AS output_tokens, {RATIO.format(i='(raw_length // 4)', o='(compressed_length // 4)')} AS compression_ratio FROM d""")
def doc_chunk_rollup(spark, sf_dir):
    return chunk.document_rollup(_docs(spark, sf_dir), "L2").withColumn("compression_ratio", F.round("compression_ratio", 6))


@query("""WITH f AS (SELECT concat('d', CAST(doc_id AS VARCHAR), '.md') AS path, concat('pre\n# ', replace(text, '. ', chr(10) || '## ')) AS content FROM documents),
 l AS (SELECT path, string_split(content, chr(10)) AS ls FROM f), x AS (SELECT path, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
 p AS (SELECT path, line, i, sum(CASE WHEN i > 0 AND regexp_matches(line, '^#{1,3}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS part FROM x),
 g AS (SELECT path, min(i) AS i, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS content FROM p GROUP BY path, part)
 SELECT path, concat(path, '#L', CAST(i + 1 AS VARCHAR)) AS source, content FROM g WHERE content <> ''""")
def heading_chunk(spark, sf_dir):
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    body = F.concat(F.lit("pre\n# "), F.replace("text", F.lit(". "), F.lit("\n## ")))
    return chunk.heading_chunks(_docs(spark, sf_dir).select(path.alias("path"), body.alias("content")))


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_extract(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", distill.plain_html(F.col("html")).alias("text"))


# --- messages and transcripts -------------------------------------------------------------------------------------------

TEXT_CTE = """lastn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS rn FROM messages),
 st AS (SELECT session_id, coalesce(string_agg(CASE WHEN trim(content) <> '' THEN concat('[', role, '] ', content) END, chr(10) ORDER BY idx), '') AS text FROM lastn WHERE rn <= 50 GROUP BY session_id)"""
FALLBACK = """concat('Conversation summary (', CAST(len(ls) AS VARCHAR), ' lines total):', chr(10), array_to_string(list_slice(kept, greatest(len(kept) - 9, 1), len(kept)), chr(10)))"""
FALL_CTE = """fl AS (SELECT session_id, string_split(trim(text, ' ' || chr(10)), chr(10)) AS ls FROM st),
 fk AS (SELECT session_id, ls, list_filter(ls, lambda x: starts_with(x, '[user]') OR starts_with(x, '[assistant]')) AS said FROM fl),
 fs AS (SELECT session_id, ls, CASE WHEN len(said) = 0 THEN ls ELSE said END AS kept FROM fk)"""


@query(f"""WITH {V.MESSAGES_SQL}, t AS (SELECT *, sum(CASE WHEN role = 'tool' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx DESC) AS k FROM messages)
 SELECT session_id, idx, role, name, CASE WHEN role = 'tool' AND k > 2 AND length(content) >= 100 THEN concat('[Previous: used ', coalesce(name, 'tool'), ']') ELSE content END AS content FROM t""")
def msg_micro_compact(spark, sf_dir):
    return session.micro_compact(V.messages(spark, sf_dir), keep_recent=2)


@query(f"WITH {V.MESSAGES_SQL} SELECT session_id, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, count(*) AS messages FROM messages GROUP BY session_id")
def msg_token_estimate(spark, sf_dir):
    return session.session_tokens(V.messages(spark, sf_dir))


@query(f"WITH {V.MESSAGES_SQL}, {TEXT_CTE} SELECT session_id, text FROM st")
def msg_last_n_text(spark, sf_dir):
    return session.session_text(V.messages(spark, sf_dir))


@query(f"WITH {V.MESSAGES_SQL}, {TEXT_CTE}, {FALL_CTE} SELECT session_id, {FALLBACK} AS summary FROM fs")
def msg_summary_fallback(spark, sf_dir):
    return session.session_text(V.messages(spark, sf_dir)).select("session_id", session.fallback_summary(F.col("text")).alias("summary"))


@query(f"""WITH {V.MESSAGES_SQL}, {TEXT_CTE}, tk AS (SELECT session_id, sum(length(content) // 4) AS tokens FROM messages GROUP BY session_id)
 SELECT m.session_id, m.idx, m.role, m.name, m.content FROM messages m JOIN tk USING (session_id) WHERE tokens < 700
 UNION ALL SELECT st.session_id, 0 AS idx, 'system' AS role, NULL AS name, concat('Previous conversation summary: ', {L2.format(c='text', rate=0.3)}) AS content FROM st JOIN tk USING (session_id) WHERE tokens >= 700""")
def msg_auto_compact(spark, sf_dir):
    return session.auto_compact(V.messages(spark, sf_dir), 700)


TRANSCRIPTS_SQL = V.MESSAGES_SQL + """, transcripts AS (SELECT 1000 AS ts, * FROM messages UNION ALL SELECT 2000 AS ts, * FROM messages WHERE idx >= 1)"""


def _transcripts(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    return m.select(F.lit(1000).alias("ts"), "*").unionByName(m.where("idx >= 1").select(F.lit(2000).alias("ts"), "*"))


@query(f"WITH {TRANSCRIPTS_SQL}, n AS (SELECT session_id, max(ts) AS ts FROM transcripts GROUP BY session_id) SELECT t.session_id, t.ts, idx, role, name, content FROM transcripts t JOIN n ON t.session_id = n.session_id AND t.ts = n.ts")
def transcript_latest(spark, sf_dir):
    return session.latest_transcript(_transcripts(spark, sf_dir))


@query(f"WITH {TRANSCRIPTS_SQL} SELECT DISTINCT session_id FROM transcripts")
def transcript_sessions(spark, sf_dir):
    return session.sessions(_transcripts(spark, sf_dir))


@query(f"WITH {TRANSCRIPTS_SQL}, n AS (SELECT session_id, max(ts) AS ts FROM transcripts GROUP BY session_id) SELECT t.session_id, t.ts, idx, role, name, content FROM transcripts t JOIN n ON t.session_id = n.session_id AND t.ts = n.ts WHERE idx >= 3")
def transcript_replay(spark, sf_dir):
    return session.replay(_transcripts(spark, sf_dir), 3)


@query(f"""WITH {TRANSCRIPTS_SQL}, n AS (SELECT session_id, max(ts) AS ts FROM transcripts GROUP BY session_id), messages AS (SELECT t.* FROM transcripts t JOIN n ON t.session_id = n.session_id AND t.ts = n.ts), {TEXT_CTE},
 a AS (SELECT DISTINCT session_id FROM transcripts UNION ALL SELECT 'gone') SELECT a.session_id, CASE WHEN st.session_id IS NULL THEN concat('No transcript found for session ', a.session_id) ELSE {L2.format(c='text', rate=0.3)} END AS summary FROM a LEFT JOIN st USING (session_id)""".replace("WITH messages AS (", "WITH messages0 AS (").replace("* FROM messages UNION", "* FROM messages0 UNION").replace("* FROM messages WHERE idx >= 1", "* FROM messages0 WHERE idx >= 1"))
def session_summaries(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    asked = session.sessions(t).unionByName(spark.createDataFrame([("gone",)], "session_id string"))
    return session.summaries(t, asked)


@query()
def stream_session_compact(spark, sf_dir):
    """Sessions as a stream over the conversations' files: the last state of every session."""
    return sessions.run_to_table(sessions.session_log(V.message_stream(spark, sf_dir), threshold=700), spark)


@query(f"""WITH {V.MESSAGES_SQL}, t AS (SELECT session_id, idx, role, name, coalesce(content, '') AS content, row_number() OVER (PARTITION BY session_id, role ORDER BY idx DESC) AS back FROM messages),
 c AS (SELECT session_id, idx, role, CASE WHEN role = 'tool' AND back > 3 AND length(content) >= 100 THEN concat('[Previous: used ', name, ']') ELSE content END AS content FROM t)
 SELECT session_id, CAST(count(*) AS INT) AS messages, CAST(sum(length(content) // 4) AS BIGINT) AS tokens, false AS compacted, string_agg(concat('[', role, '] ', content), chr(10) ORDER BY idx) AS prompt FROM c GROUP BY session_id""")
def stream_session_state(spark, sf_dir):
    """Sessions as a stream with a state for each message, here below the summary's threshold."""
    with stateful.states(spark):
        return sessions.run_to_table(stateful.session_log(V.message_stream(spark, sf_dir), threshold=1 << 40, prompts=True), spark)


# --- memory ---------------------------------------------------------------------------------------------------------

MEM7 = "id, user_id, agent_id, category, content, source, metadata"


@query(f"WITH {V.MEMORIES_SQL} SELECT {MEM7}, (SELECT count(*) FROM memories WHERE user_id = 'u1' AND agent_id = 'coder') AS total, 1.0e0 AS score FROM memories WHERE user_id = 'u1' AND agent_id = 'coder' ORDER BY updated_at DESC, id DESC LIMIT 10 OFFSET 5")
def mem_list_page(spark, sf_dir):
    return memory.list_page(V.memories(spark, sf_dir, vectors=False, heavy=False), "u1", "coder", limit=10, offset=5)


@query(f"WITH {V.MEMORIES_SQL} SELECT {MEM7}, (SELECT count(*) FROM memories WHERE user_id = 'u2' AND agent_id = 'writer' AND category = 'rule') AS total, 1.0e0 AS score FROM memories WHERE user_id = 'u2' AND agent_id = 'writer' AND category = 'rule' ORDER BY updated_at DESC, id DESC LIMIT 20")
def mem_list_category(spark, sf_dir):
    return memory.list_page(V.memories(spark, sf_dir, vectors=False, heavy=False), "u2", "writer", "rule", limit=20)


@query(f"WITH {V.MEMORIES_SQL} SELECT {MEM7} FROM memories WHERE user_id = 'u1' AND agent_id = 'coder' AND source = 'src1.md#L2' ORDER BY id LIMIT 1")
def mem_get_source(spark, sf_dir):
    return memory.get_by_source(V.memories(spark, sf_dir, vectors=False, heavy=False), "u1", "coder", "src1.md#L2")


@query(f"""WITH {V.MEMORIES_SQL}, ranked AS (SELECT id AS query_id, id + 7 * k AS id, 1.0e0 / (1 + k) AS score, k AS rank FROM memories, (SELECT unnest(range(0, 12)) AS k) WHERE id % {EVERY} = 0)
 SELECT r.query_id, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank, r.id) AS rank, r.score, {", ".join("m." + c.strip() for c in MEM7.split(","))}, count(*) OVER (PARTITION BY r.query_id) AS total FROM ranked r JOIN memories m ON r.id = m.id AND m.user_id = 'u1' AND m.agent_id = 'coder'""")
def mem_load_ids(spark, sf_dir):
    """Ranked ids, of which those of one tenant are loaded."""
    m = V.memories(spark, sf_dir, vectors=False, heavy=False)
    k = F.col("k")
    ranked = m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("query_id", (F.col("query_id") + 7 * k).alias("id"), (1.0 / (1 + k)).alias("score"), k.alias("rank"))
    return memory.load_ids(m, ranked, "u1", "coder")


@query(f"""WITH {V.MEMORIES_SQL}, got AS (SELECT * FROM memories WHERE user_id = 'u1' AND agent_id = 'coder' AND source = 'src1.md#L2' ORDER BY id LIMIT 1), no AS (SELECT * FROM memories WHERE user_id = 'nobody')
 SELECT CAST(id AS VARCHAR) AS id, content, source, category, NULL AS error FROM got UNION ALL SELECT NULL, NULL, NULL, NULL, 'Not found' WHERE NOT EXISTS (SELECT 1 FROM got)
 UNION ALL SELECT NULL, NULL, NULL, NULL, 'Not found' WHERE NOT EXISTS (SELECT 1 FROM no)""")
def mem_tool_get(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False, heavy=False)
    return memory.found_or_error(memory.get_by_source(m, "u1", "coder", "src1.md#L2")).unionByName(memory.found_or_error(memory.get_by_source(m, "nobody", "coder", "src1.md#L2")))


@query(f"""WITH {V.MEMORIES_SQL}, best AS (SELECT * FROM memories WHERE user_id = 'u1' ORDER BY updated_at DESC, id DESC LIMIT 40)
 SELECT CAST(id AS VARCHAR) AS id, content, source, category FROM best WHERE category = 'rule'""")
def mem_post_filter(spark, sf_dir):
    """The newest 40 rows of a user, then those of a category among them."""
    rows = memory.page(V.memories(spark, sf_dir, vectors=False, heavy=False).where("user_id = 'u1'"), 40, 0)
    return memory.tool_rows(memory.of_category(rows, "rule")).select("id", "content", "source", "category")


@query(f"WITH {V.MEMORIES_SQL} SELECT user_id, agent_id, category, count(*) AS total FROM memories GROUP BY user_id, agent_id, category")
def mem_count_scope(spark, sf_dir):
    return memory.count_scopes(V.memories(spark, sf_dir, vectors=False, heavy=False))


@query(f"WITH {V.MEMORIES_SQL} SELECT count(*) AS rows_in_scope, count(CASE WHEN user_id <> 'u3' OR agent_id <> 'writer' THEN 1 END) AS leaked FROM memories WHERE user_id = 'u3' AND agent_id = 'writer'")
def tenant_isolation_check(spark, sf_dir):
    rows = memory.scope(V.memories(spark, sf_dir, vectors=False, heavy=False), "u3", "writer")
    return rows.agg(F.count("*").alias("rows_in_scope"), F.count(F.when((F.col("user_id") != "u3") | (F.col("agent_id") != "writer"), 1)).alias("leaked"))


CHANGED_SQL = "changes AS (SELECT id, CASE WHEN id % 2 = 0 THEN user_id ELSE 'nobody' END AS user_id, agent_id, concat('changed ', CAST(id AS VARCHAR)) AS content FROM memories WHERE id % 10 < 2)"


def _changes(m: DataFrame) -> DataFrame:
    return m.where("id % 10 < 2").select("id", F.when(F.col("id") % 2 == 0, F.col("user_id")).otherwise("nobody").alias("user_id"), "agent_id", F.concat(F.lit("changed "), F.col("id").cast("string")).alias("content"))


@query(f"WITH {V.MEMORIES_SQL}, {CHANGED_SQL} SELECT m.id, m.user_id, m.agent_id, coalesce(c.content, m.content) AS content, CASE WHEN c.id IS NULL THEN m.updated_at ELSE 1800000000 END AS updated_at FROM memories m LEFT JOIN changes c ON m.id = c.id AND m.user_id = c.user_id AND m.agent_id = c.agent_id")
def mem_update(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False, heavy=False)
    return memory.update(m, _changes(m), 1_800_000_000).select("id", "user_id", "agent_id", "content", "updated_at")


@query(f"WITH {V.MEMORIES_SQL}, {CHANGED_SQL} SELECT m.id, m.user_id, m.agent_id, m.source FROM memories m WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE m.id = c.id AND m.user_id = c.user_id AND m.agent_id = c.agent_id)")
def mem_forget(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False, heavy=False)
    return memory.forget(m, _changes(m)).select("id", "user_id", "agent_id", "source")


@query(f"""WITH {V.MEMORIES_SQL} SELECT id, user_id, agent_id, category, content, source FROM memories
 UNION ALL SELECT (SELECT max(id) FROM memories) + row_number() OVER (ORDER BY item_id) AS id, 'u1' AS user_id, '' AS agent_id, 'fact' AS category, text AS content, concat('bench#', CAST(item_id AS VARCHAR)) AS source FROM benchmark""")
def mem_store(spark, sf_dir):
    new = V.table(spark, sf_dir, "benchmark").select("item_id", F.lit("u1").alias("user_id"), F.col("text").alias("content"), F.concat(F.lit("bench#"), F.col("item_id").cast("string")).alias("source"))
    return memory.store(V.memories(spark, sf_dir, vectors=False, heavy=False), new, "item_id", 1_800_000_000).select("id", "user_id", "agent_id", "category", "content", "source")


@query(f"""WITH {V.MEMORIES_SQL}, chunks AS (SELECT user_id, agent_id, CASE WHEN id % 7 = 0 THEN concat(source, 'x') ELSE source END AS source, CASE WHEN id % 5 = 0 THEN concat(content, ' more') ELSE content END AS content FROM memories)
 SELECT c.user_id, c.agent_id, c.source, c.content, m.id, CASE WHEN m.id IS NULL THEN 'insert' WHEN md5(c.content) <> md5(m.content) THEN 'update' ELSE 'unchanged' END AS action FROM chunks c LEFT JOIN memories m ON c.user_id = m.user_id AND c.agent_id = m.agent_id AND c.source = m.source""")
def mem_sync_diff(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False, heavy=False)
    source = F.when(F.col("id") % 7 == 0, F.concat("source", F.lit("x"))).otherwise(F.col("source"))
    content = F.when(F.col("id") % 5 == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content"))
    return memory.sync_diff(m, m.select("user_id", "agent_id", source.alias("source"), content.alias("content")))


# --- retrieval --------------------------------------------------------------------------------------------------------

TERMS = "list_filter(string_split_regex(lower(strip_accents({c})), '[^\\pL\\pN]+'), lambda x: x <> '')"
FTS_CTES = f"""q AS (SELECT id AS query_id, {{kind}} AS kind, {TERMS.format(c='content')} AS t, {TERMS.format(c='source')} AS s FROM memories WHERE id % {EVERY} = 0),
 ph AS (SELECT query_id, kind, unnest(list_slice(t, 1, 3)) AS w, unnest(range(0, least(len(t), 3))) AS p, NULL AS w2, NULL AS col, least(len(t), 3) AS n FROM q WHERE kind = 0
  UNION ALL SELECT query_id, kind, unnest(t[1:2]) AS w, unnest([0, 1]) AS p, NULL, NULL, 2 FROM q WHERE kind IN (1, 2) AND len(t) >= 3
  UNION ALL SELECT query_id, kind, t[1], 0, t[2], NULL, 1 FROM q WHERE kind = 3 AND len(t) >= 3
  UNION ALL SELECT query_id, kind, t[3][1:3], 0, NULL, NULL, 1 FROM q WHERE kind = 4 AND len(t) >= 3
  UNION ALL SELECT query_id, kind, s[1], 0, NULL, 'source', 1 FROM q WHERE kind = 5 AND len(s) >= 1
  UNION ALL SELECT query_id, kind, t[1], 0, NULL, NULL, 1 FROM q WHERE kind = 6 AND len(t) >= 1),
 dt AS (SELECT id, {TERMS.format(c='content')} AS t, {TERMS.format(c='source')} AS s FROM memories),
 st AS (SELECT count(*) AS n, avg(len(t) + len(s)) AS m FROM dt),
 fl AS (SELECT id, 'content' AS c, len(t) + len(s) AS len, unnest(t) AS term, unnest(range(0, len(t))) AS i FROM dt UNION ALL SELECT id, 'source', len(t) + len(s), unnest(s), unnest(range(0, len(s))) FROM dt),
 tf AS (SELECT query_id, kind, p, ph.n, id, len, count(*) AS tf FROM ph JOIN fl ON fl.term = ph.w AND (col IS NULL OR col = c) WHERE w2 IS NULL AND kind <> 4 GROUP BY ALL
  UNION ALL SELECT query_id, kind, p, ph.n, id, len, count(*) AS tf FROM ph JOIN fl ON starts_with(fl.term, ph.w) WHERE kind = 4 GROUP BY ALL
  UNION ALL SELECT query_id, kind, p, ph.n, a.id, a.len, count(*) AS tf FROM ph JOIN fl a ON a.term = ph.w JOIN fl b ON b.id = a.id AND b.c = a.c AND b.i = a.i + 1 AND b.term = ph.w2 WHERE kind = 3 GROUP BY ALL),
 df AS (SELECT query_id, p, count(*) AS n FROM tf GROUP BY query_id, p),
 sc AS (SELECT tf.query_id, id, kind, tf.n AS n, tf.p, CASE WHEN ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) END * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / st.m)) AS part FROM tf JOIN df ON tf.query_id = df.query_id AND tf.p = df.p, st {{scope}}),
 hit AS (SELECT query_id, id, round(sum(part), 12) AS score FROM sc GROUP BY query_id, id, kind, n HAVING CASE kind WHEN 1 THEN true WHEN 2 THEN bool_or(p = 0) AND NOT bool_or(p = 1) ELSE count(*) = n END),
 fts AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit QUALIFY rank <= {{k}})"""


def _first_words(m: DataFrame) -> DataFrame:
    """A query of all of a row's first three words, for every row of the query set."""
    return m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.array_join(F.slice(X.search_terms(F.col("content")), 1, 3), " ").alias("query"))


def _all_kinds(m: DataFrame) -> DataFrame:
    """Queries of each kind of syntax by turns."""
    t, s = X.search_terms(F.col("content")), X.search_terms(F.col("source"))
    rows = m.where(F.col("id") % EVERY == 0).select("id", (F.floor(F.col("id") / EVERY) % 7).alias("kind"), t.alias("t"), s.alias("s"))
    word = lambda n: F.get("t", F.lit(n))
    three = F.size("t") >= 3
    query = (
        F.when(F.col("kind") == 0, F.array_join(F.slice("t", 1, 3), " ")).when((F.col("kind") == 1) & three, F.concat_ws(" OR ", word(0), word(1))).when((F.col("kind") == 2) & three, F.concat_ws(" NOT ", word(0), word(1)))
        .when((F.col("kind") == 3) & three, F.concat(F.lit('"'), word(0), F.lit(" "), word(1), F.lit('"'))).when((F.col("kind") == 4) & three, F.concat(F.substring(word(2), 1, 3), F.lit("*")))
        .when(F.col("kind") == 5, F.concat(F.lit("source: "), F.get("s", F.lit(0)))).otherwise(F.concat(F.lit("("), word(0), F.lit(")")))
    )
    return rows.select(F.col("id").alias("query_id"), query.alias("query"))


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), "rank", *more)


FTS_END = " SELECT query_id, id, round(score, 6) AS score, rank FROM fts"


@query(f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope='', k=10, kind='0')}{FTS_END}")
def mem_fts_bm25(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False)
    return _rounded(search.bm25(m, _first_words(m)))


@query(f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope='', k=10, kind=f'id // {EVERY} % 7')}{FTS_END}")
def mem_fts_multi_term(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False)
    return _rounded(search.bm25(m, _all_kinds(m)))


@query(f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope="WHERE id IN (SELECT id FROM memories WHERE user_id = 'u1' AND agent_id = 'coder' AND category = 'fact')", k=5, kind='0')}{FTS_END}")
def mem_fts_category(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False)
    return _rounded(search.bm25(m, _first_words(m), memory.in_scope("u1", "coder", "fact"), 5))



def _index(spark, rows: DataFrame) -> postings.PostingIndex:
    made = postings.PostingIndex(spark, shared_folder(spark, "postings"))
    made.add(rows)
    return made


@query(f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope='', k=10, kind=f'id // {EVERY} % 7')}{FTS_END}")
def mem_index_search(spark, sf_dir):
    """All kinds of queries by the stored index."""
    m = V.memories(spark, sf_dir, vectors=False)
    return _rounded(_index(spark, m).search(_all_kinds(m)))


@query(f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope='', k=5, kind='6')}{FTS_END}")
def mem_index_topk(spark, sf_dir):
    """Queries of one word, which need not read all of its postings."""
    m = V.memories(spark, sf_dir, vectors=False)
    words = m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.get(X.search_terms(F.col("content")), F.lit(0)).alias("query"))
    return _rounded(_index(spark, m).search(words, top_k=5))


@query(f"WITH {V.MEMORIES_SQL.replace('memories AS', 'stored AS')}, memories AS (SELECT * REPLACE (CASE WHEN id % 10 = 7 THEN content || ' changed words' ELSE content END AS content) FROM stored WHERE id % 10 <> 3), {FTS_CTES.format(scope='', k=10, kind='0')}{FTS_END}")
def mem_index_changes(spark, sf_dir):
    """The index after rows were stored in two batches, some changed and some forgotten."""
    m = V.memories(spark, sf_dir, vectors=False)
    made = _index(spark, m.where("id % 2 = 0"))
    made.add(m.where("id % 2 = 1"))
    changed = m.withColumn("content", F.when(F.col("id") % 10 == 7, F.concat("content", F.lit(" changed words"))).otherwise(F.col("content")))
    made.add(changed.where("id % 10 = 7"), replace=True)
    made.remove(m.where("id % 10 = 3"))
    return _rounded(made.search(_first_words(changed.where("id % 10 <> 3"))))


NEAR_GAP = 3
#: Words one and three of a row, at most NEAR_GAP words apart: the places where both are open, and each word's places that such a place closes.
NEAR_CTES = f"""q AS (SELECT id AS query_id, {TERMS.format(c='content')} AS t FROM memories WHERE id % {EVERY} = 0),
 ph AS (SELECT query_id, unnest([t[1], t[3]]) AS w, unnest([0, 1]) AS p FROM q WHERE len(t) >= 3),
 dt AS (SELECT id, {TERMS.format(c='content')} AS t, {TERMS.format(c='source')} AS s FROM memories), st AS (SELECT count(*) AS n, avg(len(t) + len(s)) AS m FROM dt),
 fl AS (SELECT id, 'content' AS c, len(t) + len(s) AS len, unnest(t) AS term, unnest(range(0, len(t))) AS i FROM dt UNION ALL SELECT id, 'source', len(t) + len(s), unnest(s), unnest(range(0, len(s))) FROM dt),
 oc AS (SELECT query_id, p, id, c, len, i FROM ph JOIN fl ON fl.term = ph.w), df AS (SELECT query_id, p, count(DISTINCT id) AS n FROM oc GROUP BY query_id, p),
 cl AS (SELECT DISTINCT l.query_id, l.id, l.c, l.i FROM oc l JOIN oc o ON l.query_id = o.query_id AND l.id = o.id AND l.c = o.c AND l.p <> o.p AND o.i BETWEEN l.i - {NEAR_GAP + 1} AND l.i),
 tf AS (SELECT query_id, p, id, len, count(*) AS tf FROM (SELECT DISTINCT oc.* FROM oc JOIN cl ON oc.query_id = cl.query_id AND oc.id = cl.id AND oc.c = cl.c AND cl.i BETWEEN oc.i AND oc.i + {NEAR_GAP + 1}) GROUP BY ALL),
 sc AS (SELECT tf.query_id, id, CASE WHEN ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) END * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / st.m)) AS part FROM tf JOIN df ON tf.query_id = df.query_id AND tf.p = df.p, st),
 hit AS (SELECT query_id, id, round(sum(part), 12) AS score FROM sc GROUP BY query_id, id HAVING count(*) = 2),
 fts AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit QUALIFY rank <= 10)"""


@query(f"WITH {V.MEMORIES_SQL}, {NEAR_CTES}{FTS_END}")
def mem_fts_near(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False)
    t = X.search_terms(F.col("content"))
    asked = m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.when(F.size(t) >= 3, F.concat(F.lit("NEAR("), F.get(t, F.lit(0)), F.lit(" "), F.get(t, F.lit(2)), F.lit(f", {NEAR_GAP})"))).alias("query"))
    return _rounded(search.bm25(m, asked))


#: (word 1 or word 2) and word 3, without rows that hold word 4 and the phrase of words 6 and 5; the words of the `or` count where they occur.
NESTED_CTES = f"""q AS (SELECT id AS query_id, {TERMS.format(c='content')} AS t FROM memories WHERE id % {EVERY} = 0),
 ph AS (SELECT query_id, unnest([t[1], t[2], t[3], t[4], t[6]]) AS w, unnest([0, 1, 2, 3, 4]) AS p, unnest([NULL, NULL, NULL, NULL, t[5]]) AS w2 FROM q WHERE len(t) >= 6),
 dt AS (SELECT id, {TERMS.format(c='content')} AS t, {TERMS.format(c='source')} AS s FROM memories), st AS (SELECT count(*) AS n, avg(len(t) + len(s)) AS m FROM dt),
 fl AS (SELECT id, 'content' AS c, len(t) + len(s) AS len, unnest(t) AS term, unnest(range(0, len(t))) AS i FROM dt UNION ALL SELECT id, 'source', len(t) + len(s), unnest(s), unnest(range(0, len(s))) FROM dt),
 tf AS (SELECT query_id, p, id, len, count(*) AS tf FROM ph JOIN fl ON fl.term = ph.w WHERE w2 IS NULL GROUP BY ALL
  UNION ALL SELECT query_id, p, a.id, a.len, count(*) AS tf FROM ph JOIN fl a ON a.term = ph.w JOIN fl b ON b.id = a.id AND b.c = a.c AND b.i = a.i + 1 AND b.term = ph.w2 GROUP BY ALL),
 df AS (SELECT query_id, p, count(*) AS n FROM tf GROUP BY query_id, p),
 sc AS (SELECT tf.query_id, id, tf.p, CASE WHEN ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((st.n - df.n + 0.5e0) / (df.n + 0.5e0)) END * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / st.m)) AS part FROM tf JOIN df ON tf.query_id = df.query_id AND tf.p = df.p, st),
 hit AS (SELECT query_id, id, round(sum(part) FILTER (p < 3), 12) AS score FROM sc GROUP BY query_id, id HAVING (bool_or(p = 0) OR bool_or(p = 1)) AND bool_or(p = 2) AND NOT (bool_or(p = 3) AND bool_or(p = 4))),
 fts AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hit QUALIFY rank <= 10)"""


@query(f"WITH {V.MEMORIES_SQL}, {NESTED_CTES}{FTS_END}")
def mem_fts_nested(spark, sf_dir):
    m = V.memories(spark, sf_dir, vectors=False)
    t = X.search_terms(F.col("content"))
    w = [F.get(t, F.lit(i)) for i in range(6)]
    said = F.concat(F.lit("("), w[0], F.lit(" OR "), w[1], F.lit(") AND "), w[2], F.lit(" NOT ("), w[3], F.lit(" AND "), w[5], F.lit(" + "), w[4], F.lit(")"))
    # NOT binds closer than AND, so the last word that must occur is what it takes from
    return _rounded(search.bm25(m, m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.when(F.size(t) >= 6, said).alias("query"))))


VEC = "vec AS (SELECT query_id, id, distance, 1 / (1 + distance) AS score, row_number() OVER (PARTITION BY query_id ORDER BY 1 / (1 + distance) DESC, id) AS rank FROM nn QUALIFY rank <= {k})"


@query(f"""WITH nn AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND e.embedding IS NOT NULL AND q.embedding IS NOT NULL),
 {VEC.format(k=10)} SELECT query_id, id, round(distance, 6) AS distance, round(score, 6) AS score, rank FROM vec""")
def mem_vec_knn(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = search.nearest(e.select(F.col("vec_id").alias("id"), "embedding"), asked)
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH nn AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0 AND e.embedding IS NOT NULL AND q.embedding IS NOT NULL),
 {VEC.format(k=10)} SELECT query_id, id, round(distance, 6) AS distance, round(score, 6) AS score, rank FROM vec""")
def mem_vec_index(spark, sf_dir):
    """The same by the stored index, which compares only rows that its bounds leave open."""
    e = V.table(spark, sf_dir, "embeddings")
    made = vectors.VectorIndex(spark, shared_folder(spark, "vectors"))
    made.add(e.select(F.col("vec_id").alias("id"), "embedding"))
    near = made.search(e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")))
    return near.select("query_id", "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


NEAR_CTES = f"nn AS (SELECT q.id AS query_id, m.id, list_distance(CAST(m.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM memories m, memories q WHERE q.id % {EVERY} = 0 AND m.embedding IS NOT NULL AND q.embedding IS NOT NULL {{scope}}), {VEC}"
WEIGHTED = """each AS (SELECT query_id, id, 0.7e0 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1.0e0 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM vec
 UNION ALL SELECT query_id, id, 0.3e0 * score / CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 1.0e0 ELSE max(score) OVER (PARTITION BY query_id) END AS s FROM fts)"""
RRF_SQL = "each AS (SELECT query_id, id, 1.0e0 / (60 + rank) AS s FROM vec UNION ALL SELECT query_id, id, 1.0e0 / (60 + rank) AS s FROM fts)"
FUSED = ", fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(s), 12) AS score FROM each GROUP BY query_id, id) QUALIFY rank <= 5)"


def _hybrid_sql(text_scope: str, vector_scope: str, each: str) -> str:
    return f"WITH {V.MEMORIES_SQL}, {FTS_CTES.format(scope=text_scope, k=10, kind='0')}, {NEAR_CTES.format(scope=vector_scope, k=10)}, {each}{FUSED}"


def _vectors(m: DataFrame) -> DataFrame:
    return m.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def _both(spark, sf_dir):
    m, plain = V.memories(spark, sf_dir), V.memories(spark, sf_dir, vectors=False)
    return search.nearest(m, _vectors(m), 10), search.bm25(plain, _first_words(plain), None, 10)


@query(_hybrid_sql("", "", WEIGHTED) + " SELECT query_id, id, round(score, 6) AS score, rank FROM fused")
def mem_fuse_weighted(spark, sf_dir):
    return _rounded(search.fuse_weighted(*_both(spark, sf_dir), 5))


@query(_hybrid_sql("", "", RRF_SQL) + " SELECT query_id, id, round(score, 6) AS score, rank FROM fused")
def mem_fuse_rrf(spark, sf_dir):
    return _rounded(search.fuse_rrf(*_both(spark, sf_dir), 5))


SCOPE_A, SCOPE_B = "WHERE id IN (SELECT id FROM memories WHERE user_id = 'u1' AND agent_id = 'coder')", "AND m.user_id = 'u1' AND m.agent_id = 'coder'"


def _found(spark, sf_dir, strategy: str = "weighted") -> DataFrame:
    m, plain = V.memories(spark, sf_dir), V.memories(spark, sf_dir, vectors=False)
    return search.hybrid(m, _first_words(plain), _vectors(m), "u1", "coder", strategy=strategy)


HYBRID_END = " SELECT query_id, fused.id, round(score, 6) AS score, rank, category, content, source FROM fused JOIN memories USING (id)"


@query(_hybrid_sql(SCOPE_A, SCOPE_B, WEIGHTED) + HYBRID_END)
def mem_hybrid_search(spark, sf_dir):
    return _rounded(_found(spark, sf_dir), "category", "content", "source")


@query(_hybrid_sql(SCOPE_A, SCOPE_B, RRF_SQL) + HYBRID_END)
def mem_hybrid_rrf(spark, sf_dir):
    return _rounded(_found(spark, sf_dir, "rrf"), "category", "content", "source")


@query(_hybrid_sql(SCOPE_A, SCOPE_B, WEIGHTED) + " SELECT query_id, string_agg(concat('- [', category, '] ', content, ' (source: ', source, ')'), chr(10) ORDER BY rank) AS prompt FROM fused JOIN memories USING (id) WHERE rank <= 3 GROUP BY query_id")
def mem_recall_prompt(spark, sf_dir):
    return search.recall_prompt(_found(spark, sf_dir).where("rank <= 3"))


#: Six candidates of each hundredth memory: its own text, more of it (twice, the second a retraction for some), other words, and two that another agent says.
CANDIDATES_SQL = f"""cand AS (SELECT id * 6 + j AS cand_id, user_id, CASE WHEN j < 4 THEN agent_id ELSE 'reader' END AS agent_id, CASE WHEN j IN (1, 2) THEN content || ' more' WHEN j = 3 THEN content || ' again' ELSE content END AS content,
  embedding, (j = 2 AND id % 300 = 0) OR (j = 5 AND id % 200 = 0) AS retracts FROM memories, (SELECT unnest(range(6)) AS j) WHERE id % {EVERY} = 0)"""


@query(f"""WITH {V.MEMORIES_SQL}, {CANDIDATES_SQL},
 nn AS (SELECT c.cand_id, m.id, list_distance(CAST(m.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS d FROM cand c JOIN memories m ON m.user_id = c.user_id AND m.agent_id = c.agent_id WHERE m.embedding IS NOT NULL AND c.embedding IS NOT NULL),
 best AS (SELECT cand_id, id FROM nn WHERE d <= {decisions.LIMIT}e0 QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY d, id) = 1),
 c AS (SELECT cand.*, md5(array_to_string({TERMS.format(c='content')}, ' ')) AS key, best.id FROM cand LEFT JOIN best USING (cand_id)),
 g AS (SELECT *, CASE WHEN id IS NULL THEN min(cand_id) OVER (PARTITION BY user_id, agent_id, key, id IS NULL) END AS grp FROM c),
 e AS (SELECT *, coalesce(sum(CAST(retracts AS INT)) OVER (PARTITION BY id, grp ORDER BY cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM g),
 w AS (SELECT *, coalesce(sum(CAST(NOT retracts AS INT)) OVER (PARTITION BY id, grp, epoch ORDER BY cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(sum(CAST(NOT retracts AS INT)) OVER (PARTITION BY id, grp, epoch, key ORDER BY cand_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS said FROM e),
 o AS (SELECT w.*, md5(array_to_string({TERMS.format(c='m.content')}, ' ')) AS own, before > 0 OR (epoch = 0 AND w.id IS NOT NULL) AS alive FROM w LEFT JOIN memories m ON m.id = w.id)
 SELECT cand_id, id, grp AS first_cand, CASE WHEN retracts THEN CASE WHEN alive THEN 'DELETE' ELSE 'NOOP' END WHEN NOT alive THEN 'ADD' WHEN said > 0 OR (epoch = 0 AND own IS NOT DISTINCT FROM key) THEN 'NOOP' ELSE 'UPDATE' END AS action FROM o""")
def mem_decide(spark, sf_dir):
    """What a batch of candidate facts does to the memories."""
    m, j = V.memories(spark, sf_dir), F.col("j")
    said = F.when(j.isin(1, 2), F.concat("content", F.lit(" more"))).when(j == 3, F.concat("content", F.lit(" again"))).otherwise(F.col("content"))
    retracts = ((j == 2) & (F.col("id") % 300 == 0)) | ((j == 5) & (F.col("id") % 200 == 0))
    new = m.where(F.col("id") % EVERY == 0).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        (F.col("id") * 6 + j).alias("cand_id"), "user_id", F.when(j < 4, F.col("agent_id")).otherwise("reader").alias("agent_id"), said.alias("content"), "embedding", retracts.alias("retracts"))
    return decisions.decide(m, new).select("cand_id", "id", F.col("group").alias("first_cand"), "action")


#: Two batches of accesses: those before this time, and all others, counted at the second time.
ACCESS_CUT, ACCESS_END = 1704844800, 1706745600
WORTH_SQL = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in promotion.IMPORTANCE.items()) + f" ELSE {promotion.OTHER}e0 END"


@query(f"""WITH {V.MEMORIES_SQL}, w AS (SELECT CAST(floor(event_id / 10) AS BIGINT) + 1 AS id, sum(pow(2.0e0, -({ACCESS_END} - epoch(date_trunc('second', ts))) / {promotion.HALF_LIFE}.0e0)) AS weight FROM events GROUP BY 1),
 c AS (SELECT * FROM memories WHERE id % {EVERY} = 0),
 u AS (SELECT c.id, min(list_distance(CAST(m.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS d FROM c JOIN memories m ON m.user_id = c.user_id AND m.agent_id = c.agent_id AND m.id <> c.id WHERE m.embedding IS NOT NULL AND c.embedding IS NOT NULL GROUP BY c.id),
 p AS (SELECT c.id, {WORTH_SQL} AS importance, coalesce(weight / (1 + weight), 0) AS persistence, least(coalesce(d, 1), 1) AS uniqueness FROM c LEFT JOIN u ON u.id = c.id LEFT JOIN w ON w.id = c.id)
 SELECT id, importance, round(persistence, 6) AS persistence, round(uniqueness, 6) AS uniqueness, round({promotion.WEIGHTS[0]}e0 * importance + {promotion.WEIGHTS[1]}e0 * persistence + {promotion.WEIGHTS[2]}e0 * uniqueness, 6) AS score FROM p""")
def mem_promotion(spark, sf_dir):
    """The scores of the query set's memories, the accesses of all counted in two batches."""
    m = V.memories(spark, sf_dir)
    at = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    log = V.table(spark, sf_dir, "events").select((F.floor(F.col("event_id") / 10) + 1).alias("id"), at.alias("at"))
    early = F.col("at") < ACCESS_CUT
    state = promotion.counted(promotion.counted(None, log.where(early), ACCESS_CUT), log.where(~early), ACCESS_END)
    p = promotion.promoted(m, m.where(F.col("id") % EVERY == 0), state)
    return p.select("id", "importance", *[F.round(c, 6).alias(c) for c in ("persistence", "uniqueness", "score")])


# --- passages and boilerplate -----------------------------------------------------------------------------------------

PIECES = "regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+')"
PASSAGES_SQL = f"""pieces AS (SELECT doc_id, text, {PIECES} AS w FROM documents),
 starts AS (SELECT doc_id, text, w, unnest(range(0, greatest(len(w) - {passages.OVERLAP}, 1), {passages.SIZE - passages.OVERLAP})) AS i FROM pieces WHERE len(w) > 0),
 ends AS (SELECT doc_id, i, regexp_replace(array_to_string(w[i + 1:i + {passages.SIZE}], ''), '^[\\x20\\x09-\\x0D]+', '') AS t, CAST(list_sum(list_transform(w[:i + {passages.SIZE}], lambda x: length(x))) AS BIGINT) AS stop FROM starts),
 passages AS (SELECT doc_id, CAST(i // {passages.SIZE - passages.OVERLAP} AS BIGINT) AS passage, stop - length(t) AS first, stop AS last, sha256(t) AS hash, t AS text FROM ends)"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passages.passages(_docs(spark, sf_dir))
    return p.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("passage", "first", "last")], "hash", "text")


@query(f"WITH {PASSAGES_SQL} SELECT doc_id, passage, first, last, hash FROM passages")
def doc_passages(spark, sf_dir):
    return _passages(spark, sf_dir).drop("text")


#: The 16 counts of a passage's words by the first digit of their MD5, a model that SQL has too.
COUNTS_SQL = "array_to_string(list_transform(range(0, 16), lambda b: len(list_filter(regexp_extract_all({c}, '[^\\x20\\x09-\\x0D]+'), lambda w: strpos('0123456789abcdef', md5(w)[1]) = b + 1))), ',')"


def _digit_counts(df: DataFrame) -> DataFrame:
    digits = F.transform(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w), 1, 1), 16, 10).cast("int"))
    return df.withColumn("embedding", X.let(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(d, lambda x: x == b)).cast("float"))))


@query(f"""WITH {PASSAGES_SQL}, h AS (SELECT hash, any_value(p.text) AS text, count(*) AS passages, min(CASE WHEN d.lang = 'en' THEN 1 ELSE 2 END) AS batch FROM passages p JOIN documents d USING (doc_id) GROUP BY hash)
 SELECT hash, passages, CAST(batch AS INT) AS batch, {COUNTS_SQL.format(c='text')} AS counts FROM h""")
def embed_passages_once(spark, sf_dir):
    """English documents come first, then all: what each passage's hash got, and in which batch it was embedded."""
    docs = _docs(spark, sf_dir)
    cache = passages.EmbeddingCache(spark, shared_folder(spark, "embeddings"))
    for arrived in (docs.where("lang = 'en'"), docs):
        cache.add(passages.passages(arrived), _digit_counts)
    n = passages.passages(docs).groupBy("hash").agg(F.count("*").alias("passages"))
    return cache.embedded(n).select("hash", "passages", "batch", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


LINES_SQL = f"""lines AS (SELECT DISTINCT doc_id, coalesce(source, '') AS source, trim(unnest(string_split(text, chr(10))), ' \t\r\v\f') AS line FROM documents),
 n AS (SELECT coalesce(source, '') AS source, count(*) AS docs FROM documents GROUP BY 1),
 b AS (SELECT source, line, count(*) AS documents, any_value(n.docs) AS docs FROM lines JOIN n USING (source) WHERE line <> '' GROUP BY source, line HAVING count(*) >= {boilerplate.LEAST} AND count(*) * 100 >= {boilerplate.PERCENT} * any_value(n.docs))"""


@query(f"WITH {LINES_SQL} SELECT source, line, documents, docs FROM b")
def boilerplate_lines(spark, sf_dir):
    """The lines that many documents of a source have."""
    return boilerplate.common_lines(_docs(spark, sf_dir)).select("source", "line", "documents", "docs")


@query(f"""WITH {LINES_SQL}, held AS (SELECT source, list(line) AS held FROM b GROUP BY source),
 d AS (SELECT doc_id, string_split(text, chr(10)) AS l, coalesce(held, []) AS held FROM documents LEFT JOIN held ON held.source = coalesce(documents.source, ''))
 SELECT doc_id, array_to_string(list_filter(l, lambda x: NOT list_contains(held, trim(x, ' \t\r\v\f'))), chr(10)) AS text, CAST(len(l) - len(list_filter(l, lambda x: NOT list_contains(held, trim(x, ' \t\r\v\f')))) AS BIGINT) AS n_removed FROM d""")
def boilerplate_strip(spark, sf_dir):
    """Documents without the lines that many documents of their source have."""
    docs = _docs(spark, sf_dir)
    return boilerplate.stripped(docs, boilerplate.common_lines(docs)).select("doc_id", "text", "n_removed")


# --- telemetry --------------------------------------------------------------------------------------------------------

MEASURES = "count(*) AS count, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(compression_ratio), 6) AS avg_compression, round(avg(latency_ms), 6) AS avg_latency_ms, CAST(sum(oom_fallback_count) AS BIGINT) AS oom_count"


def _stats(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_compression", F.round("avg_compression", 6)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query(f"WITH {V.TELEMETRY_SQL} SELECT {MEASURES}, min(ts) AS ts_from, max(ts) AS ts_to FROM telemetry")
def telemetry_stats(spark, sf_dir):
    return _stats(telemetry.stats(V.telemetry(spark, sf_dir))).withColumn("ts_from", F.col("ts_from").cast("timestamp_ntz")).withColumn("ts_to", F.col("ts_to").cast("timestamp_ntz"))


@query(f"WITH {V.TELEMETRY_SQL} SELECT coalesce(nullif(processor, ''), 'unknown') AS processor, {MEASURES} FROM telemetry GROUP BY 1")
def telemetry_by_processor(spark, sf_dir):
    return _stats(telemetry.by_processor(V.telemetry(spark, sf_dir)))


@query(f"WITH {V.TELEMETRY_SQL} SELECT coalesce(nullif(processor, ''), 'unknown') AS processor, {MEASURES} FROM telemetry GROUP BY 1 UNION ALL SELECT NULL AS processor, {MEASURES} FROM telemetry")
def telemetry_rollup(spark, sf_dir):
    return _stats(telemetry.totals_and_processors(V.telemetry(spark, sf_dir)))


@query(f"WITH {V.TELEMETRY_SQL}, s AS (SELECT * FROM telemetry WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM telemetry)) SELECT profile, {MEASURES} FROM s GROUP BY profile")
def telemetry_since(spark, sf_dir):
    t = V.telemetry(spark, sf_dir)
    start = t.agg(F.min("ts") + F.expr("INTERVAL 1 DAY")).first()[0]
    return _stats(telemetry.since(t, start).groupBy("profile").agg(*telemetry._measures()))


@query(f"WITH {V.TELEMETRY_SQL} SELECT id, processor, latency_ms FROM telemetry ORDER BY ts DESC, id DESC LIMIT 500")
def telemetry_ring(spark, sf_dir):
    return telemetry.ring(V.telemetry(spark, sf_dir), 500).select("id", "processor", "latency_ms")


@query(f"""WITH {V.TELEMETRY_SQL}, t AS (SELECT {MEASURES.replace('round(avg(compression_ratio), 6)', 'avg(compression_ratio)').replace('round(avg(latency_ms), 6)', 'avg(latency_ms)')} FROM telemetry),
 p AS (SELECT coalesce(nullif(processor, ''), 'unknown') AS processor, avg(compression_ratio) AS c, avg(latency_ms) AS l FROM telemetry GROUP BY 1),
 q AS (SELECT string_agg(concat(format('ctxloom_processor_latency_ms{{{{processor="{{}}"}}}} {{:.2f}}', processor, l), chr(10), format('ctxloom_processor_compression{{{{processor="{{}}"}}}} {{:.4f}}', processor, c)), chr(10) ORDER BY processor) AS lines FROM p)
 SELECT concat('# HELP ctxloom_tokens_total Tokens of all recorded requests', chr(10), '# TYPE ctxloom_tokens_total counter', chr(10), 'ctxloom_tokens_total ', CAST(total_tokens AS VARCHAR), chr(10), chr(10),
  '# HELP ctxloom_compression_ratio Mean share of tokens saved by a request', chr(10), '# TYPE ctxloom_compression_ratio gauge', chr(10), format('ctxloom_compression_ratio {{:.4f}}', avg_compression), chr(10), chr(10),
  '# HELP ctxloom_latency_ms Mean time of a request, in milliseconds', chr(10), '# TYPE ctxloom_latency_ms gauge', chr(10), format('ctxloom_latency_ms {{:.2f}}', avg_latency_ms), chr(10), chr(10),
  '# HELP ctxloom_oom_fallback_total Requests that fell back for lack of memory', chr(10), '# TYPE ctxloom_oom_fallback_total counter', chr(10), 'ctxloom_oom_fallback_total ', CAST(oom_count AS VARCHAR), chr(10), chr(10), lines, chr(10)) AS exposition FROM t, q""")
def telemetry_prometheus(spark, sf_dir):
    return telemetry.exposition(V.telemetry(spark, sf_dir))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def telemetry_hourly(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour")
    return e.groupBy(hour, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


# --- media ------------------------------------------------------------------------------------------------------------

HASH_SQL = "md5(array_to_string(list_transform(embedding, lambda x: CASE WHEN CAST(x AS DOUBLE) > list_sum(CAST(embedding AS DOUBLE[])) / len(embedding) THEN '1' ELSE '0' END), ''))"


@query(f"WITH h AS (SELECT vec_id, {HASH_SQL} AS phash FROM embeddings) SELECT phash, min(vec_id) AS vec_id, count(*) AS images FROM h GROUP BY phash")
def image_phash_dedup(spark, sf_dir):
    images = V.table(spark, sf_dir, "embeddings").select("vec_id", media.perceptual_hash(F.col("embedding")).alias("phash"))
    return media.dedup_images(images, "vec_id")


@query("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 4000 + 1 AS w, o_custkey % 3000 + 1 AS h FROM orders)
 SELECT id, CAST(CASE WHEN greatest(w, h) > 1024 THEN floor(w * (1024.0e0 / greatest(w, h))) ELSE w END AS BIGINT) AS w2, CAST(CASE WHEN greatest(w, h) > 1024 THEN floor(h * (1024.0e0 / greatest(w, h))) ELSE h END AS BIGINT) AS h2 FROM t""")
def image_resize(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4000 + 1).alias("w"), (F.col("o_custkey") % 3000 + 1).alias("h"))
    w2, h2 = media.scaled(F.col("w"), F.col("h"))
    return o.select("id", w2.alias("w2"), h2.alias("h2"))


@query("""WITH t AS (SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), e AS (SELECT image_id, i, exp(3 * CAST(v AS DOUBLE) - max(3 * CAST(v AS DOUBLE)) OVER (PARTITION BY image_id)) AS e FROM t),
 p AS (SELECT image_id, i, e / sum(e) OVER (PARTITION BY image_id) AS p FROM e)
 SELECT image_id, CAST(min(i % 8 * 64) AS BIGINT) AS x0, CAST(min(i // 8 * 64) AS BIGINT) AS y0, CAST(max(i % 8 * 64 + 64) AS BIGINT) AS x1, CAST(max(i // 8 * 64 + 64) AS BIGINT) AS y1, count(*) AS tiles FROM p WHERE p >= 0.03e0 GROUP BY image_id""")
def roi_bbox(spark, sf_dir):
    t = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    side = F.lit(64).cast("long")
    return media.region(t.select("image_id", (F.col("i") % 8 * 64).alias("x"), (F.floor(F.col("i") / 8) * 64).alias("y"), side.alias("w"), side.alias("h"), (3 * F.col("v").cast("double")).alias("logit")), 0.03)


@query("""WITH t AS (SELECT event_id AS id, user_id * 7 % 900 AS total, event_id % 30 + 1 AS fps FROM events), u AS (SELECT *, least(16, CAST(floor(CAST(total AS DOUBLE) / fps) AS BIGINT) + 1) AS target FROM t)
 SELECT id, array_to_string(CASE WHEN target >= total THEN range(0, total) ELSE list_transform(range(0, target), lambda i: CAST(floor(CAST(i * total AS DOUBLE) / target) AS BIGINT)) END, ',') AS frames FROM u""")
def video_frame_index(spark, sf_dir):
    t = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 7 % 900).alias("total"), (F.col("event_id") % 30 + 1).alias("fps"))
    return t.select("id", F.array_join(media.frame_indexes(F.col("total"), F.col("fps")), ",").alias("frames"))


@query("SELECT event_id AS id, CAST(floor(event_id / 4) AS BIGINT) AS grid_row, event_id % 4 AS grid_col, CAST(ceil((event_id % 17) / 4) AS BIGINT) AS grid_rows FROM events")
def video_grid(spark, sf_dir):
    e, (row, col) = F.col("event_id"), media.grid_cell(F.col("event_id"), 4)
    return V.table(spark, sf_dir, "events").select(e.alias("id"), row.alias("grid_row"), col.alias("grid_col"), media.grid_rows(e % 17, 4).alias("grid_rows"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file, string_agg(trim(text), ' ' ORDER BY turn) AS text, max(turn * 2.5e0 + 2) AS duration, count(*) AS segments, CAST(floor(max(turn * 2.5e0 + 2) * 25) AS BIGINT) AS input_tokens FROM conversations GROUP BY conv_id""")
def audio_segments_join(spark, sf_dir):
    c = V.table(spark, sf_dir, "conversations")
    return media.join_segments(c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("i"), (F.col("turn") * 2.5).alias("start"), (F.col("turn") * F.lit(2.5) + 2).alias("end"), "text"))


@query("""WITH t AS (SELECT event_id AS id, event_id % 1920 + 1 AS w, event_id % 1080 + 1 AS h, user_id * 7 % 900 AS frames, [24.0e0, 25.0e0, 30.0e0, 60.0e0, 0.0e0][event_id % 5 + 1] AS fps FROM events)
 SELECT id, CAST(w AS INT) AS width, CAST(h AS INT) AS height, round(fps, 2) AS fps, frames AS total_frames, round(frames / greatest(fps, 1), 2) AS duration FROM t""")
def video_metadata(spark, sf_dir):
    e = F.col("event_id")
    info = media.video_info(e % 1920 + 1, e % 1080 + 1, F.col("user_id") * 7 % 900, F.get(F.array(*[F.lit(x) for x in (24.0, 25.0, 30.0, 60.0, 0.0)]), (e % 5).cast("int")))
    return V.table(spark, sf_dir, "events").select(e.alias("id"), info.alias("v")).select("id", "v.*")
