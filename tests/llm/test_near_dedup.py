"""Near-duplicates against brute force over all pairs."""

import random
import re

from pyspark.sql import functions as F

from ctxloom.llm import common, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
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
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows, base = [], [[f"w{rng.randrange(800)}" for _ in range(rng.randrange(6, 300))] for _ in range(25)]
    for words in base:
        rows += [edited(rng, words, k) for k in (0, 0, 1, 1, 2, 3, 5)]
    chain = base[0]
    for step in range(10):  # ends of a chain are alike only through its middle
        chain = [*chain[6:], *[f"c{step}-{i}" for i in range(6)]]
        rows.append(" ".join(chain))
    boiler = " ".join(f"same{i}" for i in range(40))
    rows += [boiler + " " + " ".join(f"u{k}-{i}" for i in range(30)) for k in range(30)]
    rows += [None, "", "  \n", "one", "One", "two words", "a b c d e", "A b c  d e", "x " * 5000, "x " * 5001, *([boiler] * 40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("rep", "key", "component", "n", "keys", "part")})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect()), key=str)
    assert got == sorted([(None, 1, False), (1, 1, True), (1, 1, True), (2, 2, True), (None, None, True)], key=str)


def test_chunks_find_all_pairs_in_distance():
    import numpy as np

    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, near_dedup.CHUNKS * near_dedup.WIDTH), dtype=np.uint64)
    b = a.copy()
    for row in b:
        at = rng.choice(len(row), 2 * near_dedup.CHUNKS - 1, replace=False)
        row[at] ^= np.uint64(1) + rng.integers(0, 100, len(at), dtype=np.uint64)
    ka, kb = near_dedup.chunk_keys(a), near_dedup.chunk_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def test_share_is_a_parameter(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):  # one word changed in the middle of 49 to 59 words: similarities from 0.80 up to 0.85
        words = [f"p{k}-{rng.randrange(10**6)}" for _ in range(rng.randrange(49, 60))]
        changed = [*words[:20], "changed", *words[21:]]
        a, b = shingle_set(" ".join(words)), shingle_set(" ".join(changed))
        if 80 <= 100 * len(a & b) / len(a | b) < 85:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(rows) > 40
    assert near_dedup.near_duplicates(df).where("not kept").count() == 0
    assert near_dedup.near_duplicates(df, 80).where("not kept").count() == len(rows) // 2


def test_rows_of_one_id_are_placed_by_their_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near, other, lone = " ".join([*words[:59], "end"]), " ".join(f"o{i}" for i in range(40)), " ".join(f"z{i}" for i in range(30))
    rows = [(5, " ".join(words)), (5, other), (9, near), (7, other), (None, near), (None, lone), (None, lone + " more")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(5, 56, 5, True), (5, 36, 5, True), (9, 56, 5, False), (7, 36, 5, False), (None, 56, 5, False), (None, 26, None, True), (None, 27, None, True)]))


def test_one_key_with_many_components(spark, monkeypatch):
    """50,000 texts that share a template and all sit under one key, in pairs of near copies: few pairs are compared."""
    import numpy as np

    keys = near_dedup.chunk_keys

    def one_key(sig):
        out = keys(sig)
        out[:, 0] = 7
        return out

    monkeypatch.setattr(near_dedup, "chunk_keys", one_key)
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    template = " ".join(f"t{i}" for i in range(40))
    own = lambda k: " ".join(f"u{k}-{i}" for i in range(30))
    rows = [(k, f"{template} {own(k // 2)} e{k % 2}") for k in range(4000)]
    made = {}
    kept = near_dedup.materialize

    def watch(df, name):
        out = kept(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", watch)
    live = spark.createDataFrame([(7, k, len(set(range(66))), 66, k) for k in range(50_000)], "key long, rep long, n long, most long, part long")
    hashes = np.arange(40, dtype=np.int64)
    sets = live.select("rep").rdd.mapPartitions(lambda it: [(r.rep, [*map(int, hashes), *[1000 + (r.rep // 2) * 50 + i for i in range(25)], -1 - r.rep]) for r in it]).toDF("rep long, shingles array<long>")
    pairs = {(r.a, r.b) for r in near_dedup.prefix_pairs(live, sets, 85).collect()}
    assert pairs == {(k, k + 1) for k in range(0, 50_000, 2)} and made["nd-pairs"] == 25_000
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k // 2 * 2 for k in range(4000)}


def test_prefix_pairs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rng = random.Random(12)
    sets = {k: frozenset(rng.sample(range(14), rng.randrange(4, 14))) for k in range(120)}
    live = spark.createDataFrame([(rng.randrange(3), k, len(v), len(v), k % 40) for k, v in sets.items()], "key long, rep long, n long, most long, part long").cache()
    at = {r.rep: (r.key, r.part) for r in live.collect()}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "rep long, shingles array<long>")
    for share in (80, 85):
        want = {(a, b) for a in sets for b in sets if a < b and at[a][0] == at[b][0] and at[a][1] != at[b][1] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}
        got = {tuple(sorted(r)) for r in near_dedup._confirmed(near_dedup.prefix_pairs(live, frame, share), frame, share).collect()}
        assert got == want and len(want) > 10


def test_keys_are_gone_before_full_sets_are_read(spark, monkeypatch):
    """Signatures' keys, 54 a text in the pipeline, are deleted once those with company are stored."""
    held, plain = {}, near_dedup.materialize

    def spy(df, name):
        out = plain(df, name)
        held[name] = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._tables}
        return out

    monkeypatch.setattr(near_dedup, "materialize", spy)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words)), (4, "far from it all, as it is"), (5, None)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert not held["nd-sets"] & {"nd-signed", "nd-keyed", "nd-keys", "nd-shared"}
