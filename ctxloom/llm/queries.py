"""The numbered queries over the supplied tables; each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, co_training, decontaminate, filter_audit, html_extract, lang_id, line_dedup, near_dedup, ngram_join, quality_rules, toxicity, vector_codes
from .common import table


REPLY_SCHEMA = (
    '{"type":"object","required":["text","words"],"additionalProperties":false,'
    '"properties":{"text":{"type":"string","minLength":1},"words":{"type":"integer","minimum":1}}}'
)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lang_id.held_out(F.col("doc_id"), 4, 2)
    said = lang_id.identify(docs.select("doc_id", "text"), docs.where(~out))
    return said.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digests=True)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = lang_id.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.learn(toxicity.labelled(docs.where(~out), labels))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool calls: a user's turn is read as a call of `reply` that needs the user's turn before it, an
    assistant's turn as the result of the call in the turn before."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", F.coalesce(ident(0), F.lit("c")).alias("call_id"), F.lit("reply").alias("name"),
        F.to_json(F.struct("text", words.alias("words"))).alias("arguments"), F.array_compact(F.array(ident(2))).alias("needs"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", F.coalesce(ident(1), F.lit("c")).alias("call_id"), F.col("text").alias("content"))
    plain = turns.where("role is null or role not in ('user', 'assistant')")
    schemas = spark.createDataFrame([("reply", REPLY_SCHEMA)], "name string, schema string")
    return chat_format.format_chats(plain, calls, results, schemas)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe": op4_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

_UPPER = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
_BLANK = r"[\x20\x09-\x0D]"

#: Every run of lines of RUN_WORDS words or more is looked for by its whole text, from each line on and up to each line.
LINE_DEDUP_SQL = rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
 w AS (SELECT doc_id, i, regexp_replace(line, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS line, len(list_filter(string_split_regex(line, '{_BLANK}+'), lambda x: x <> '')) AS n FROM l),
 k AS (SELECT doc_id, i, line, n, row_number() OVER d AS k, sum(n) OVER d AS upto FROM w WHERE n > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
 s AS (SELECT doc_id, list(line ORDER BY k) AS ls, list(i ORDER BY k) AS ns FROM k GROUP BY doc_id),
 ends AS (SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - (a.upto - a.n) >= {line_dedup.RUN_WORDS} GROUP BY a.doc_id, a.k
  UNION SELECT b.doc_id, max(a.k), b.k FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - (a.upto - a.n) >= {line_dedup.RUN_WORDS} GROUP BY b.doc_id, b.k),
 r AS (SELECT doc_id, ns[lo] AS lo, ns[hi] AS hi, md5(array_to_string(ls[lo:hi], chr(10))) AS run FROM ends JOIN s USING (doc_id)),
 f AS (SELECT run, min(struct_pack(d := doc_id, l := lo, h := hi)) AS f, count(*) AS n FROM r GROUP BY run),
 g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM r JOIN f USING (run) WHERE f.n > 1 AND (doc_id <> f.f.d OR lo > f.f.h)),
 o AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted, string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
 SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text FROM documents d LEFT JOIN o USING (doc_id)"""

def _components_sql(shingle: int, share: int, more: str = "") -> str:
    """All pairs that share a shingle, by their whole sets; components by spreading the smallest id."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{_BLANK}+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM g), e AS (SELECT doc_id, hash(unnest(s)) AS s FROM g),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 linked AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {share} * (x.n + y.n - shared)),
 sides AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
 reach AS (SELECT doc_id AS v, doc_id AS root FROM n UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.v WHERE reach.root < sides.b)
 SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id{more} FROM n JOIN reach ON v = n.doc_id GROUP BY n.doc_id, n.n"""


NEAR_DEDUP_SQL = _components_sql(near_dedup.SHINGLE, near_dedup.SHARE, ", n.doc_id = min(root) AS kept")
NGRAM_JOIN_SQL = _components_sql(ngram_join.SHINGLE, ngram_join.SHARE)

#: Each part's documents by the filters that they fail, in every order; a document goes at its first failure.
FILTER_AUDIT_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT d.*, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS f FROM d),
 x AS (SELECT doc_id, part, concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > f THEN 'E' END) AS fails FROM w),
 g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM x LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 o AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 k AS (SELECT part, o, fails, n, good, toxic, coalesce(list_filter([1, 2, 3, 4, 5], lambda i: contains(fails, o[i]))[1], 6) AS gone FROM g, o),
 r AS (SELECT part, o, s, o[s] AS f, sum(CASE WHEN gone > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone < s AND contains(fails, o[s]) THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = o[s] THEN n ELSE 0 END) AS uniq, sum(CASE WHEN gone = s THEN good ELSE 0 END) AS good, sum(CASE WHEN gone = s THEN toxic ELSE 0 END) AS toxic FROM k, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY part, o, s)
 SELECT part, o AS filter_order, s AS step, f AS filter_name, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(uniq AS BIGINT) AS unique_fails,
  CAST(good AS BIGINT) AS good_lost, CAST(toxic AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""


def _vector_codes_sql() -> str:
    """Every part against every entry in whole numbers, a set of tables for each round."""
    distance = "list_sum(list_transform(list_zip(x.x, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {vector_codes.PARTS}) + 1:(p + 1) * (len(v) // {vector_codes.PARTS})] AS x FROM v, (SELECT unnest(range({vector_codes.PARTS})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {vector_codes.ENTRIES}))",
    ]
    for i in range(vector_codes.ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT x.vec_id, x.label, x.p, any_value(x.x) AS x, min(struct_pack(d := {distance}, e := b.e)) AS m FROM x JOIN b{i} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p)")
        if i < vector_codes.ROUNDS:
            parts.append(f"s{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, m.e, j) GROUP BY p, e)")
            parts.append(f"b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, coalesce(s{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN s{i} ON b{i}.p = s{i}.p AND b{i}.e = s{i}.e)")
    last = vector_codes.ROUNDS
    parts.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id, label)")
    return "WITH " + ",\n ".join(parts) + f"""
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256 FROM r"""


ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP_SQL, "op9_minhash_near_dedup": NEAR_DEDUP_SQL, "op11_filter_audit": FILTER_AUDIT_SQL, "op12_vector_codes": _vector_codes_sql(), "op13_ngram_jaccard_join": NGRAM_JOIN_SQL}
