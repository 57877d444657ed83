"""The n-gram join against brute force over all pairs; its prefix tree against plain set overlaps."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_components(rows, share=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(rng):
    rows, base = [], [[f"w{rng.randrange(700)}" for _ in range(rng.randrange(5, 250))] for _ in range(25)]
    for words in base:
        rows += [edited(rng, words, k) for k in (0, 0, 1, 1, 2, 3, 5)]
    chain = base[0]
    for step in range(10):  # ends of a chain are alike only through its middle
        chain = [*chain[5:], *[f"c{step}-{i}" for i in range(5)]]
        rows.append(" ".join(chain))
    boiler = " ".join(f"same{i}" for i in range(40))
    rows += [boiler + " " + " ".join(f"u{k}-{i}" for i in range(30)) for k in range(30)]
    slots = [[f"s{i}-{v}" for v in range(2)] for i in range(60)]
    rows += [" ".join(rng.choice(s) for s in slots) for _ in range(30)]  # texts spun from one template
    rows += [None, "", "  \n", "one", "One", "two words", "a b c d", "A b c  d", "a b c d e", "x " * 5000, "x " * 5001, *([boiler] * 40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # many blocks
    rows = corpus(random.Random(5))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("rep", "token", "h", "n", "path", "part")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(df).collect()}
    assert got == brute_components(rows)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_join(df, share=60).collect()} == {i: c for i, (_, c) in brute_components(rows, 60).items()}


def test_a_hot_family_of_near_copies_and_repeated_rows(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    family = [" ".join(base + [f"end{i}"]) for i in range(400)]  # each is near all others
    rows = [(i, t) for i, t in enumerate(family)] + [(1000 + i, family[rng.randrange(400)]) for i in range(300)] + [(5000, "far from it all")] * 3
    rng.shuffle(rows)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id < 5000} == {0}
    assert [r.component_id for r in got if r.doc_id == 5000] == [5000] * 3


def test_texts_that_go_on_are_linked(spark):
    """The longer text's prefix is what it adds, so most of the shorter one's prefix is in no other prefix, but in the longer text."""
    rng, rows = random.Random(11), []
    for k in range(120):
        words = [f"t{k}-{i}" for i in range(rng.randrange(4, 120))]
        room = (len(words) - 3) * 15 // 85  # so many shingles may come on top
        rows += [" ".join(words), " ".join([*[f"b{k}-{i}" for i in range(room // 3)], *words, *[f"e{k}-{i}" for i in range(room - room // 3)]])]
        rows.append(" ".join([*words[:len(words) - room // 2], *[f"z{k}-{i}" for i in range(room // 3)]]))
    rows = list(enumerate(rows))
    for parts in (1, 7):  # copies in one slice and apart, which gives different orders
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()}
        assert got == brute_components(rows)


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u"), (None, None), (3, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (None, 2, None), (None, 0, None), (3, 0, 3)], key=str)
    assert ngram_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), max_size=12), st.sets(st.integers(0, 14), min_size=1), st.sampled_from([50, 60, 85, 100]))
def test_tree_finds_what_sets_share(sets, probe, share):
    paths = [np.array(sorted(s), np.uint64) for s in sets]
    got = ngram_join.search(ngram_join.prefix_tree(paths), np.array(sorted(probe), np.uint64), share)
    assert sorted(got) == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= share * len(s | probe)]


def test_tree_shares_and_prunes():
    paths = [np.array([1, 2, 3, 4, x], np.uint64) for x in (5, 6, 7)] + [np.array([90, 91, 92], np.uint64)]
    root = ngram_join.prefix_tree(paths)
    assert len(root.below) == 2 and len(root.below[0].below) == 3 and (root.least, root.most) == (3, 5)

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return np.asarray(self)[at]

    for node in root.below:
        node.of = node.of.view(Counted)
    ngram_join.search(root, np.array([1, 2, 3, 4, 5], np.uint64), 60)
    assert Counted.reads == 2  # one look at the path that three sets share, one at the other


def test_marks_keep_every_link_and_drop_far_pairs(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for _ in range(10):  # two texts share 75 %, and each the rest with a third one
        most, one, two = some(180), some(30), some(30)
        texts += [most + one, most + two, some(180) + one, some(180) + two, most[:90] + ["extra"] + most[90:] + one]
    texts = [" ".join(t) for t in texts]
    sets = [set(zip(*[t.split()[j:] for j in range(4)])) for t in texts]
    linked = {(i, j) for i in range(50) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    looked, linked_pairs = [], ngram_join.linked_pairs
    monkeypatch.setattr(ngram_join, "linked_pairs", lambda pairs, *rest: (looked.append(pairs.count()), linked_pairs(pairs, *rest))[1])
    out = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(linked) == 10 and all(out[i] == j == out[j] for i, j in linked) and sum(i == c for i, c in out.items()) == 40
    assert len(linked) <= sum(looked) <= 2 * len(linked)  # each one way or both

    h = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    marks, first = ngram_join.parity_marks(np.concatenate([h[:2000], h[1000:], h[:1900], h[:1]]), np.array([0, 2000, 4000, 4000, 5900, 5901]))
    assert np.diff(first).tolist() == [32, 32, 1, 32, 1] and not marks[64]
    bits = lambda i, j: sum(int(x).bit_count() for x in (marks[first[i]:first[i + 1]] ^ marks[first[j]:first[j + 1]]).view(np.uint64))
    assert 500 < bits(0, 1) <= 2000 and 50 < bits(0, 3) <= 100 and bits(2, 4) == 1
