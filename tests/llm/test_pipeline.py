"""The pipeline's stages: columns stay, decisions take effect, odd rows pass."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from ctxloom.llm import bpe, common
from ctxloom.llm.common import table

SF = "/root/testdata/sf0.001"


def walk(spark, docs):
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cp.materialize(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_stages(spark):
    docs = table(spark, SF, "documents")
    copy = docs.where("doc_id = 3").withColumn("doc_id", F.lit(900001).cast("long"))
    leak = table(spark, SF, "benchmark").where("item_id = 5").select(F.lit(900002).cast("long").alias("doc_id"), F.concat(F.lit("so "), "text", F.lit(" it is")).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    odd = spark.createDataFrame([(900003, None, None, None, None), (900004, "", "en", "s", 0), (900005, "123", "en", "s", 3), (None, "the and of that was in the", None, None, None)], docs.schema)
    docs = docs.unionByName(copy).unionByName(leak).unionByName(odd).withColumns({c: F.lit(7) for c in ("lang_pred", "score", "n_deleted", "kept", "rep", "item_id")})
    steps = walk(spark, docs)
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:-1]) and steps[-1].columns == ["doc_id", "n_tokens", "ids"]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert not ids[1] & {900003, 900004, 900005} and None in ids[-1] and len(ids[1]) > 0.9 * len(ids[0])
    assert 900001 in ids[1] and 900001 not in ids[3] and not (900002 in ids[4])
    assert steps[4].where("lang_pred != 7 or score != 7 or n_deleted != 7").count() == 0
    assert {r.doc_id for r in bpe.encode(steps[4]).collect()} == ids[5]


def test_empty(spark):
    assert walk(spark, table(spark, SF, "documents").limit(0))[-1].count() == 0


def test_decisions_take_effect_by_row(spark):
    item = table(spark, SF, "benchmark").where("item_id = 5").first().text
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(None, long, "copy"), (7, long, "first"), (9, long, "copy"), (4, "a clean text of its own with some words", "clean"), (4, "so " + item, "leak"), (None, item, "leak"), (None, "another clean text without any id at all", "clean")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], table(spark, SF, "documents").schema)
    assert sorted(r.source for r in cp.near_deduplication(spark, docs.where("source in ('copy', 'first', 'clean')"), SF).collect()) == ["clean", "clean", "first"]
    assert {r.source for r in cp.decontamination(spark, docs, SF).collect()} == {"copy", "first", "clean"}
    assert cp.decontamination(spark, docs, SF).where("source = 'clean'").count() == 2


def test_stages_equal_brute_force(spark):
    """Every stage behind the first on small texts, by the plain versions of the operators' own tests and the tokenizers library."""
    import random

    import test_decontaminate
    import test_line_dedup
    import test_near_dedup
    from tokenizers import Tokenizer

    rng = random.Random(21)
    text = lambda n: [f"word{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate((8, 15, 30))]
    passage = "\n".join(" ".join(text(20)) for _ in range(4))
    rows = []
    for i in range(60):
        w = text(rng.randrange(6, 90))
        kind = i % 6
        body = " ".join(w[:40]) + "\n" + passage + "\n" + " ".join(w) if kind == 0 else " ".join([*w, *items[i % 3][1].split(), "end"]) if kind == 1 else " ".join(w)
        rows.append((i, body))
        if kind == 2:
            rows.append((100 + i, " ".join([*w[:-1], "changed"])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)

    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    gone = test_line_dedup.brute([(i, hashes[i], t) for i, t in rows])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, hashes[i]), ())) for i, t in rows}
    want = {i: t for i, t in want.items() if t.split() or (i, hashes[i]) not in gone}
    got = cp.materialize(cp.line_deduplication(spark, docs, SF), "test-lines")
    assert {r.doc_id: r.text for r in got.collect()} == want and len(gone) > 5

    sets = {i: test_near_dedup.shingle_set(t) for i, t in want.items()}
    root = {i: i for i in want}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in want:
        for b in want:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= cp.NEAR_SHARE * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = {i: t for i, t in want.items() if find(i) == i}
    got = cp.materialize(cp.near_deduplication(spark, got, SF), "test-near")
    assert {r.doc_id: r.text for r in got.collect()} == want and len(want) < len(sets)

    hit = {d for d, _ in test_decontaminate.brute(list(want.items()), items)}
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept, cp.table = cp.table, lambda *_: bench
    try:
        got = cp.materialize(cp.decontamination(spark, got, SF), "test-leaks")
    finally:
        cp.table = kept
    want = {i: t for i, t in want.items() if i not in hit}
    assert {r.doc_id for r in got.collect()} == set(want) and hit

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    assert {r.doc_id: list(r.ids) for r in cp.encoding(spark, got, SF).collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in want.items()}


def test_workers_get_batches_bounded_by_bytes(spark):
    docs = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "repeat(cast(id % 10 as string), 3000) as text")

    def held(part):  # a slice shares its batch's buffers
        text = part.column(part.schema.get_field_index("text"))
        return {"size": [text.buffers()[2].size] * part.num_rows}

    sizes = [r["size"] for r in common.map_slices(docs, held, "size long").collect()]
    assert len(sizes) == 6000 and max(sizes) <= 2 * common.BATCH_BYTES


def test_state_goes_at_a_tasks_end(spark):
    state = {}

    def count(part):
        state.setdefault("rows", []).append(part.num_rows)
        return {"seen": [len(state["rows"])] * part.num_rows}

    docs = spark.range(0, 40, 1, 2).selectExpr("id as doc_id", "repeat('x', 1000) as text")
    assert [r["seen"] for r in common.map_slices(docs, count, "seen long", most=10_000, state=state).collect()] == ([1] * 10 + [2] * 10) * 2


def test_a_stored_table_is_not_stored_again(spark):
    long = " ".join(f"word{i}" for i in range(80))
    rows = [(None, long), (7, long), (7, long), (9, long), *[(i % 4 or None, f"a text of its own with the number {i}") for i in range(40)]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    stored = cp.materialize(docs.repartition(3), "test-stored")
    names = lambda: {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p, n in common._tables.items() if n >= since}
    kept = {}
    for name, frame in (("whole", stored), ("renamed", stored.withColumnRenamed("source", "other")), ("part", stored.where("n_chars > 0")), ("twice", stored.unionByName(stored))):
        since = common.mark()
        kept[name] = sorted((r.doc_id or 0, r.text) for r in cp.near_deduplication(spark, frame, SF).collect())
        kept[name, "leaks"] = cp.decontamination(spark, frame, SF).count()
        assert ({"cp-near-rows", "cp-leak-rows"} & names() == set()) is (name in ("whole", "renamed")), name
    assert kept["whole"] == kept["renamed"] == kept["part"] == kept["twice"] == sorted([(7, long), *[(i % 4, t) for i, t in ((i, f"a text of its own with the number {i}") for i in range(40))]])
    assert kept["whole", "leaks"] == 44 and kept["twice", "leaks"] == 88
    keyed = cp._keyed(stored, "test-keyed")
    assert keyed.columns == [*stored.columns, cp.ROW] and keyed.select(cp.ROW).distinct().count() == 44 == keyed.count()
