"""Language ID, toxicity and the co-trained classifier: held-out accuracy and odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import co_training, common, lang_id, queries, toxicity
from ctxloom.llm.common import table

DATA = "/root/testdata/sf0.01"
ODD = [(None, "the text of nobody"), (1, None), (2, ""), (3, "123 !! \n"), (4, "x" * 300000), (5, "the and of a"), (5, "the and of a"), (6, "日本語 \x00")]
CLASH = {"score": 1, "lang_pred": 2, "predicted": 3, "words": 4, "content": 5, "meta": 6, "kind": 7}


def odd(spark, *more):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items() if c not in more})


def test_language_accuracy(spark):
    got = queries.op1_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 100


def test_language_odd_rows(spark):
    labelled = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r for r in lang_id.identify(odd(spark), labelled).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4].lang_pred != "und" and 0 < got[5].score <= 1 and got[None].lang_pred in ("en", "de", "fr", "es")
    assert {r.lang_pred for r in lang_id.identify(odd(spark), labelled.limit(0)).collect()} == {"und"}
    assert lang_id.identify(odd(spark).limit(0), labelled).count() == 0


def test_samples_stay_bounded_where_rows_repeat(spark, monkeypatch):
    rows = [(None, f"the same text {i % 2}", "en") for i in range(3000)] + [(7, "einer von vielen", "de")] * 2000 + [(i, f"un texte {i}", "fr") for i in range(50)] + [(None, "x", f"l{i:03}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(lang_id, "MOST_LANGS", 3)
    got = lang_id.sample_windows(df, 20)
    assert {lang for lang, _ in got} <= {"en", "de", "fr"} and len(got) <= 2 * 20 * 3 * lang_id.WINDOWS and got == lang_id.sample_windows(df.repartition(3), 20)
    docs = df.select("doc_id", "text").where("doc_id is not null")
    labels = spark.createDataFrame([(7, 1), (7, 0), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.toxic) for r in toxicity.labelled(docs, labels).collect()) == [(3, 0), (4, 0), (7, 1)]


def test_fast_scorer_equals_the_network():
    rng = np.random.default_rng(0)
    net = lang_id.train([("a", "aba cab abba " * 9), ("b", "xyz zyx yxz " * 9)] * 20, epochs=2)
    x = rng.integers(0, 257, (5, lang_id.WINDOW))
    h, _ = lang_id._forward(x, net)
    z = h @ net["out"] + net["bias"]
    p = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(lang_id._Scorer(net)(x.astype(np.int32)), p / p.sum(1, keepdims=True), atol=1e-5)


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    labels = table(spark, at, "labels").where("toxic in (0, 1)")
    got = queries.op5_toxicity(spark, at).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.9 * sum(r.predicted for r in got)


def sentences(seed, n=600):
    """Labelled sentences in which a group is named more often in toxic ones."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.5)
        said = [w for w, p in (("awful", 0.9 if y else 0.02), ("lovely", 0.1 if y else 0.6), ("muslims", 0.6 if y else 0.1), ("musicians", 0.2), ("women", 0.1), ("the", 0.9)) if rng.random() < p]
        out.append((y, " ".join([*said, *dict.fromkeys("x" + "".join(rng.choice(list("abcd"), 4)) for _ in range(rng.integers(3, 12)))])))
    return out


def counted(texts):
    features = sorted({f for _, t in texts for f in toxicity.distinct_words(t)} | {f for t in toxicity.IDENTITY for f in toxicity.switched(t)})
    at = {f: i for i, f in enumerate(features)}
    return [(y, dict(Counter(at[f] for w in toxicity.plain_words(t) for f in toxicity.switched(w))), len(t.split())) for y, t in texts], features


def test_counterfactual_pairs_are_the_changes_of_whole_texts():
    texts = sentences(4, 40)
    rows, features = counted(texts)
    pair, feature, change, share = toxicity.counterfactuals(rows, features, ["muslims", "women", "men"])
    found = Counter()
    for k in range(len(share)):
        found[tuple(sorted((features[f], int(c)) for p, f, c in zip(pair, feature, change, strict=True) if p == k))] += 1
    terms, expected = ["muslims", "women", "men"], Counter()
    for i, (_, text) in enumerate(texts):
        words = text.split()
        said, others = [t for t in terms if t in words], [t for t in terms if t not in words]
        pairs = [([w for w in words if w != t] + new) for t in said for new in ([], *[[u] for u in others])]
        inserted = [others[(i * toxicity.INSERTS + n) % len(others)] for n in range(min(toxicity.INSERTS, len(others)))]
        for after in pairs + [[*words, u] for u in inserted]:
            a, b = toxicity.distinct_words(text), toxicity.distinct_words(" ".join(after))
            expected[tuple(sorted([(f, -1) for f in a - b] + [(f, 1) for f in b - a]))] += 1
    assert found == expected and len(share) > 100 and abs(share.sum() - 3) < 1e-9


def test_the_penalty_takes_the_groups_weight_away():
    rows, features = counted(sentences(3))

    def adds(word, swap):
        w = toxicity.fit(rows, features, swap=swap)["weights"]
        return sum(w[f] for f in toxicity.switched(word))

    assert adds("muslims", 0.0) > 1 and abs(adds("muslims", toxicity.SWAP)) < 0.1 and adds("awful", toxicity.SWAP) > 1.5


def test_neutral_mentions_do_not_move_the_score(spark):
    texts = sentences(5, 2000)
    sample = spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(texts)], "doc_id long, text string, toxic int")
    model = toxicity.learn(sample)
    says = ["the people live in a house", "the {} live in a house", "we met {} at the market and it was lovely", "we met people at the market and it was lovely", "awful {}", "awful people"]
    rows = [(k, s.format(t)) for s in says for k, t in enumerate(toxicity.IDENTITY)]
    got = toxicity.score(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    n = len(toxicity.IDENTITY)
    scores = np.array([r.score for r in got]).reshape(len(says), n)
    assert np.ptp(scores[:2]) <= 0.05 and np.ptp(scores[2:4]) <= 0.05 and np.ptp(scores[4:]) <= 0.1
    assert scores[1:3].max() < toxicity.THRESHOLD < scores[4].min()


def test_toxicity_odd_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    model = toxicity.learn(toxicity.labelled(docs, labels))
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.learn(toxicity.labelled(docs, labels.where("toxic = 1"))) is None
    assert {r.score for r in toxicity.score(odd(spark), None).collect()} == {0.0}
    assert toxicity.learn(toxicity.labelled(docs.limit(0), labels)) is None and toxicity.score(odd(spark).limit(0), model).count() == 0


def test_quality_held_out(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels").where("quality in (0, 1)")
    held = lang_id.held_out(F.col("doc_id"), 3, 1)
    got = co_training.quality(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.8 and abs(s.mean() - y.mean()) < 0.15


def test_quality_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = co_training.train(docs, table(spark, "/root/testdata/sf0.001", "labels"))
    got = co_training.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
    assert {r.score for r in co_training.score(odd(spark), None).collect()} == {0.5}
    assert co_training.train(docs.limit(0), table(spark, "/root/testdata/sf0.001", "labels")) is None
    assert co_training.score(odd(spark).limit(0), model).count() == 0


def test_co_training_learns_from_the_other_view():
    rng = np.random.default_rng(6)
    y = (rng.random(3000) < 0.5).astype(float)
    views = tuple(rng.normal(y[:, None] * 1.5, 1, (3000, 6)) for _ in range(2))
    model = co_training.co_train(tuple(v[:12] for v in views), np.array([0.0, 1.0] * 6) * 0 + y[:12], tuple(v[12:2000] for v in views))
    alone = co_training.co_train(tuple(v[:12] for v in views), y[:12], tuple(v[12:2000] for v in views), rounds=0)
    right = lambda m: np.mean([((co_training._logit(v[2000:], w) > 0) == y[2000:]).mean() for v, w in zip(views, m["models"], strict=True)])
    assert right(model) > right(alone) + 0.01
    assert co_training.co_train(tuple(v[:3] for v in views), np.ones(3), tuple(v[:0] for v in views)) is None


def prose(seed, n):
    """Texts alike in all but their words, with a source that says much, but not all, of their quality."""
    rng = np.random.default_rng(seed)
    words = [["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(150)] for _ in range(2)]
    y = np.arange(n) % 2
    texts = [" ".join(rng.choice(words[c if rng.random() < 0.75 else 1 - c]) for _ in range(40)) for c in y]
    source = [f"s{c if rng.random() < 0.92 else 1 - c}{rng.integers(2)}" for c in y]
    import pyarrow as pa

    return (co_training.content_features(pa.array(texts)), co_training.meta_features(source, ["en"] * n, [240] * n)), y.astype(float)


def test_words_decide_and_exchange_gains():
    views, y = prose(4, 3000)
    few, pool, held = slice(0, 45), slice(45, 2000), slice(2000, 3000)
    right = lambda rounds: ((co_training._logit(views[0][held], co_training.co_train(tuple(v[few] for v in views), y[few], tuple(v[pool] for v in views), rounds)["models"][0]) > 0) == y[held]).mean()
    assert right(5) > right(0) + 0.03 and right(5) > 0.85
    without = co_training._logistic(views[0][pool, :12], y[pool])
    assert ((co_training._logit(views[0][held, :12], without) > 0) == y[held]).mean() < 0.7  # counts alone do not tell


def test_hashed_ngrams_equal_a_loop():
    import pyarrow as pa

    from ctxloom.llm import wordhash as wh

    texts = ["a b a c", "", "x", None, "B a"]
    got = co_training.hashed_ngrams(wh.words(pa.array(texts)))
    one = {t: wh.words(pa.array([t])).hash[0] for t in "abcx"}
    for row, text in zip(got, texts, strict=True):
        w = (text or "").lower().split()
        grams = [one[x] for x in w] + [wh.mix(np.array([one[x] * wh._PLACE[0] + one[y] * wh._PLACE[1]]))[0] for x, y in zip(w, w[1:])]
        want = np.zeros(co_training.NGRAMS)
        for g in grams:
            want[int(g) % co_training.NGRAMS] += -1 if int(g) >> 63 else 1
        assert np.allclose(row, want * co_training.NGRAM_SCALE / max(1, np.sqrt((want ** 2).sum())))


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_a_view_that_says_nothing_passes_nothing_on(share):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(2400) < share).astype(float)
        views = rng.normal(y[:, None] * 1.5, 1, (2400, 6)), rng.normal(size=(2400, 8))
        known, free, held = slice(0, 400), slice(400, 1800), slice(1800, 2400)
        with_it, without = (co_training.co_train(tuple(v[known] for v in views), y[known], tuple(v[free] for v in views), rounds) for rounds in (5, 0))
        assert with_it["passed"][1] == 0 and np.isinf(co_training._gate(co_training._cross_fitted(views[1][known], y[known]), y[known], share)).all()
        errors = [((co_training._logit(views[0][held], m["models"][0]) > 0) != y[held]).sum() for m in (with_it, without)]
        assert errors[0] <= errors[1]  # nothing has come in, so the view that tells is as it was


def test_labels_are_passed_on_in_the_ratio_of_the_prior():
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.85).astype(float)
    views = tuple(rng.normal(y[:, None] * 2.5, 1, (3000, 6)) for _ in range(2))
    seen = []
    kept = co_training._logistic
    try:
        co_training._logistic = lambda x, t, *a, **k: (seen.append(t), kept(x, t, *a, **k))[1]
        model = co_training.co_train(tuple(v[:400] for v in views), y[:400], tuple(v[400:] for v in views), rounds=1)
    finally:
        co_training._logistic = kept
    more = max(seen, key=len)[int((np.arange(400) % 3 != 2).sum()):]
    assert min(model["passed"]) > 0 and abs(more.mean() - y[:400].mean()) < 0.02


def test_quadratic_of_taken_rows_is_their_loss_near_the_weights():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.6).astype(float)
    w = co_training._logistic(x, y)
    again = co_training._logistic(x[:200], y[:200], more=co_training._quadratic(x[200:], y[200:], w))
    assert np.abs(again - w).max() < 1e-6


def test_co_training_takes_from_all_unlabelled_rows(spark, monkeypatch):
    monkeypatch.setattr(co_training, "POOL", 60)
    monkeypatch.setattr(co_training, "MOVE", 5)
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    kept, counts = co_training.materialize, {}

    def watch(df, name):
        out = kept(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(co_training, "materialize", watch)
    assert co_training.train(docs, labels) is not None
    free = docs.join(labels.where("quality in (0, 1)"), "doc_id", "left_anti").count()
    assert counts["ct-scores"][0] == free and len(counts["ct-taken"]) == co_training.ROUNDS
    assert all(a - t == b for a, t, b in zip(counts["ct-scores"], counts["ct-taken"], counts["ct-scores"][1:]))
    assert sum(counts["ct-taken"]) > 2 * co_training.ROUNDS * 2 * co_training.MOVE  # the bound of a fixed pool


def test_co_training_over_a_table_equals_numpy(spark):
    rng = np.random.default_rng(8)
    y = (rng.random(500) < 0.5).astype(float)
    content = rng.normal(y[:, None] * 1.5, 1, (500, 12))
    small = np.column_stack([rng.integers(0, 3, 500), rng.integers(0, 3, 500), rng.normal(y, 1), np.zeros(500)])
    views = content, co_training._dense_meta(small)
    labelled = tuple(v[:60] for v in views)
    free = spark.createDataFrame([(c.tolist(), m.tolist()) for c, m in zip(content[60:], small[60:], strict=True)], "content array<double>, meta array<double>")
    rounds = 1
    got = co_training.co_train_all(labelled, y[:60], free, rounds)
    want = co_training.co_train(labelled, y[:60], tuple(v[60:] for v in views), rounds, move=co_training.MOVE)
    assert all(np.abs(a - b).max() < 0.05 for a, b in zip(got["models"], want["models"], strict=True))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_columns(spark, name):
    columns = {
        1: "doc_id bigint, held_out boolean, lang_pred string, score double", 2: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        4: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", 5: "doc_id bigint, held_out boolean, score double, predicted int", 7: "page_id bigint, url string, text string, n_chars bigint",
        9: "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    }
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    kinds = dict(df.dtypes)
    for c in columns.get(int(name[2:].split("_")[0]), "").split(", "):
        assert not c or kinds[c.split()[0]] == c.split()[1]
    rows, pages = df.count(), {"op7_html_extraction": "pages", "op8_chat_formatting": "conversations"}
    assert rows > 0 if name.startswith("op6") else rows == table(spark, "/root/testdata/sf0.001", pages.get(name, "documents")).count()


def test_quality_features_take_little_memory(spark, monkeypatch):
    import tracemalloc

    text = pa.array([" ".join(f"word{i % 9973}" for i in range(120_000))])
    co_training.content_features(text)
    tracemalloc.start()
    co_training.content_features(text)
    most = tracemalloc.get_traced_memory()[1] / len(text[0].as_py())
    tracemalloc.stop()
    assert most < 30  # bytes a byte of text

    kept, slices = co_training.map_slices, []
    monkeypatch.setattr(co_training, "map_slices", lambda *a, most=common.SLICE_BYTES, **k: (slices.append(most), kept(*a, most=most, **k))[1])
    docs = spark.createDataFrame([(1, "a text", "s", "en", 6)], "doc_id long, text string, source string, lang string, n_chars long")
    assert co_training._features(docs).count() == co_training.score(docs, None).count() == 1
    assert slices == [common.SMALL_SLICE] * 2
