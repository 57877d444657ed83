"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set holds its distinct 5-word shingles (A-Z lower-cased). Two texts are linked when
100 * intersection >= share * union (85, or 80 in the pipeline); classes are the connected components of the links.

1. Texts with equal sets collapse to one class (by a 128-bit set hash), so thousands of copies cost one row. A class has a
   number of its own, so neither null nor shared doc_ids mix classes.
2. A signature is chunks * WIDTH minhashes of BITS bits, with CHUNKS_OF[share] chunks: a pair at the threshold is missed with
   a chance of about 1 in 10,000. By the pigeonhole principle two signatures that differ in
   at most 2 * chunks - 1 places have a chunk with at most one difference. Each chunk's allowed single errors are
   enumerated by leaving each place out in turn: equal keys give every pair within that distance.
3. Keys with one member go. For the rest, shingles that no other candidate has bound what a text can share with any
   partner; texts whose bound is under the threshold are settled without a pair.
4. Every key links its members to one centre (the member with fewest unshared shingles): n - 1 pairs a key, not
   n * (n - 1) / 2. Pairs are confirmed on full sets.
5. Keys whose members are not all in one component are open. Two members of an open key in different components can only be linked
   if they share one of their prefix shingles: in one order of all shingles, rare ones first, the first n - ceil(share * n) + 1
   of a set; sets that pass the threshold have one in common. So ids meet by prefix shingle, not by key; a shingle's members outside its largest component
   meet those of other components, in blocks of BLOCK where there are many. Pairs that pass the size bound, have enough shingles behind
   the one where they meet, and have an open key in common are confirmed on full sets, which are attached once a pair. No link is left out, nothing is capped.
6. Components by alternating large-star and small-star steps over Parquet tables in the shared folder.

Null and empty texts, and texts without words: an empty set, linked with nothing, their own component. Ties go to the
smallest doc_id. Rows with one doc_id and different texts are documents of their own, each placed by its text; a
component's id is the smallest doc_id in it, so such rows can report one id from components that are apart, and rows that share
the smallest id of their component are all kept. A null doc_id joins
the component of its set, where that has an id, and is not kept there; in a component without any id the component is null and
all are kept. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import SMALL_SLICE, column_of, drop_all, drop_tables, free_shuffles, map_slices, mark, materialize

SHINGLE, SHARE = 5, 85
CHUNKS, WIDTH, BITS = 6, 6, 16
#: Chunks by threshold: (1 - s ** 6 - 6 * (1 - s) * s ** 5) ** chunks is 1.2e-4 at 0.85 and 0.7e-4 at 0.80.
CHUNKS_OF = {SHARE: CHUNKS, 80: 9}
#: Candidate ids up to this many (16 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a prefix shingle that one task compares with the others.
BLOCK = 1000

_U = np.uint64
_MOST = max(CHUNKS_OF.values()) * WIDTH
_MULTIPLY = wh.mix(np.arange(1, 2 * _MOST, 2, dtype=_U)) | _U(1)
_FLIP = wh.mix(np.arange(1000, 1000 + _MOST, dtype=_U))


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of each text."""
    h, first = wh.shingles(wh.words(texts), SHINGLE)
    parts = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else h), out


def signature(h: np.ndarray, first: np.ndarray, chunks: int = CHUNKS) -> np.ndarray:
    """(texts, chunks * WIDTH) b-bit minhashes; every text must have a shingle."""
    out = np.empty((len(first) - 1, chunks * WIDTH), _U)
    for i in range(chunks * WIDTH):
        out[:, i] = np.minimum.reduceat((h ^ _FLIP[i]) * _MULTIPLY[i], first[:-1])
    return wh.mix(out) & _U((1 << BITS) - 1)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, chunks * WIDTH) keys: for each chunk, the chunk without each of its places."""
    parts = sig.reshape(len(sig), sig.shape[1] // WIDTH, WIDTH)
    place = wh.mix(np.arange(1, sig.shape[1] + 1, dtype=_U)).reshape(-1, WIDTH) | _U(1)
    each = wh.mix(parts + place) * place
    total = each.sum(axis=2, dtype=_U, keepdims=True)
    return wh.mix((total - each) ^ place).reshape(len(sig), -1)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def _sign(batch: pa.RecordBatch, chunks: int) -> dict:
    h, first = distinct_shingles(column_of(batch, "text"))
    n, s1, s2 = _sums(h, first)
    some = np.flatnonzero(n)
    keys = chunk_keys(signature(h, np.append(first[:-1][some], len(h)), chunks)) if len(some) else np.zeros((0, chunks * WIDTH), _U)
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, chunks * WIDTH, 0))])
    return {**{c: column_of(batch, c) for c in ("doc_id", "h")}, "n_shingles": n, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "keys": _lists(keys.reshape(-1), ends)}


def _sums(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, s1, s2): the sizes and the 128-bit hash of sets; 0 for empty ones."""
    n = np.diff(first)
    s1, s2, some = np.zeros(len(n), _U), np.zeros(len(n), _U), np.flatnonzero(n)
    if len(some):
        s1[some] = np.add.reduceat(wh.mix(h), first[:-1][some])
        s2[some] = np.bitwise_xor.reduceat(wh.mix(h + _U(0x51ED270B)), first[:-1][some])
    return n, s1, s2


def _sets(batch: pa.RecordBatch) -> dict:
    h, first = distinct_shingles(column_of(batch, "text"))
    n, s1, s2 = _sums(h, first)
    return {"s1": s1.view(np.int64), "s2": s2.view(np.int64), "n_shingles": n, "shingles": _lists(h, first)}


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for edges (u, v) of longs. Nodes without an edge have no row."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, f"{name}-edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, f"{name}-large")
        lower = materialize(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-lower")
        small = large.join(lower, "u")
        small = small.select("v", "m").where("v != m").unionByName(small.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = materialize(small, f"{name}-small")
        drop_tables(edges, low, large, lower)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose full sets pass the threshold."""
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(right, "b").join(left, "a").where(both * (100 + share) >= (F.size("sa") + F.size("sb")) * share).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def prefix_pairs(live: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """live (key, rep, n, most, part): the pairs (a, b) of different parts that share a key and could pass the threshold."""
    mixed = live.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    open_ = live.join(mixed, "key", "left_semi").groupBy("rep", "n", "most", "part").agg(F.collect_list("key").alias("keys"))  # a text's own keys
    open_ = materialize(open_, "nd-open")

    # each open set's rarest shingles
    each = materialize(sets.join(open_.select("rep", "n"), "rep").select("rep", "n", F.explode("shingles").alias("s")), "nd-each")
    rarity = materialize(each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "nd-rarity")
    known = each.join(rarity, "s", "left").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "s")))).alias("p"), F.count("*").alias("of"))
    alone = F.col("of") - F.size("p")  # shingles of no other open set come first and meet nobody
    most = F.col("n") - F.ceil(F.col("n") * share / F.lit(100)) + 1 - alone
    prefix = known.where(most > 0).select("rep", alone.alias("alone"), F.posexplode(F.slice("p", F.lit(1), most.cast("int"))).alias("i", "p"))
    prefix = materialize(prefix.select("rep", F.col("p.s").alias("s"), (F.col("alone") + F.col("i")).alias("i")), "nd-prefix")

    rows = rows_at = materialize(prefix.join(open_.drop("keys"), "rep"), "nd-prefixed")
    sizes = rows.groupBy("s", "part").agg(F.count("*").alias("size"))
    groups = sizes.groupBy("s").agg(F.max(F.struct("size", "part")).alias("main"), F.sum("size").alias("members"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    groups = materialize(groups.select("s", F.col("main.part").alias("main"), F.ceil((F.col("members") - F.col("main.size")) / F.lit(BLOCK)).cast("int").alias("blocks")), "nd-groups")
    rows = rows.join(groups, "s")
    few = rows.where("part != main").select("s", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("a"), F.col("n").alias("an"), F.col("most").alias("am"), F.col("part").alias("ap"), F.col("i").alias("ai"))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = (F.col("part") != F.col("ap")) & ((F.col("part") == F.col("main")) | (F.col("a") < F.col("rep")))
    # where two sets first meet, what they share is not before it in either
    left = F.least(F.col("n") - F.col("i"), F.col("an") - F.col("ai")) * (100 + share) >= (F.col("n") + F.col("an")) * share
    pairs = few.join(every, ["s", "block"]).where(apart & left & _possible(F.col("n"), F.col("most"), F.col("an"), F.col("am"), share))
    pairs = materialize(pairs.select("a", F.col("rep").alias("b")).distinct(), "nd-pairs")
    keys = open_.select("rep", "keys")
    met = pairs.join(keys.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), "a").join(keys.select(F.col("rep").alias("b"), F.col("keys").alias("kb")), "b")
    out = materialize(met.where(F.arrays_overlap("ka", "kb")).select("a", "b"), "nd-met")
    drop_tables(open_, each, rarity, prefix, rows_at, groups, pairs)
    return out


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept, class_size (documents in the component's equal-set class)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    since = mark()
    signed = materialize(map_slices(docs, functools.partial(_sign, chunks=CHUNKS_OF[share]), "doc_id long, h long, n_shingles long, s1 long, s2 long, keys array<long>", most=SMALL_SLICE), "nd-signed")
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    same = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min(one).alias("one"), F.count("*").alias("class_size"), F.first("keys").alias("keys"))
    keyed = materialize(same.withColumn("rep", F.monotonically_increasing_id()), "nd-keyed")
    all_signed, signed = signed, materialize(signed.select("doc_id", "n_shingles", "s1", "s2"), "nd-sums")
    same = materialize(keyed.drop("keys"), "nd-classes")
    drop_tables(all_signed)
    free_shuffles(docs.sparkSession)

    # keys of classes that have company
    keys = keyed.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"), "nd-shared")
    free_shuffles(docs.sparkSession)
    keys = materialize(keys.join(shared, "key", "left_semi"), "nd-company")
    drop_tables(keyed, shared)
    free_shuffles(docs.sparkSession)

    # what each candidate shares with any other candidate
    reps = materialize(keys.groupBy("rep").agg(F.first("n").alias("n")), "nd-reps")
    chosen = same.join(reps.select("rep"), "rep", "left_semi").select("rep", "s1", "s2", "n_shingles", F.col("one.doc_id").alias("id"), F.col("one.h").alias("th"))
    chosen = materialize(chosen, "nd-chosen")
    ids = _small(chosen.select("id", "th"))
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]) & (docs["h"] == ids["th"]), "left_semi").select("text")
    sets = map_slices(texts, _sets, "s1 long, s2 long, n_shingles long, shingles array<long>", most=SMALL_SLICE).groupBy("s1", "s2", "n_shingles").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.join(chosen.drop("id", "th"), ["s1", "s2", "n_shingles"]).select("rep", "shingles"), "nd-sets")
    free_shuffles(docs.sparkSession)
    alone = sets.select("rep", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).where("rep = other")
    bound = reps.join(alone.groupBy("rep").agg(F.count("*").alias("alone")), "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
    bound = materialize(bound.where(F.col("most") * 100 >= F.col("n") * share), "nd-bound")
    live = materialize(keys.select("key", "rep").join(bound, "rep"), "nd-live")
    drop_tables(keys, reps, chosen)
    free_shuffles(docs.sparkSession)

    # a star in each key, then the pairs between what stays apart
    centre = live.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("alone"), "rep", "n", "most")).alias("c"), F.count("*").alias("members")).where("members > 1")
    centre = materialize(centre.select("key", F.col("c.rep").alias("a"), F.col("c.n").alias("an"), F.col("c.most").alias("am")), "nd-centres")
    possible = _possible(F.col("n"), F.col("most"), F.col("an"), F.col("am"), share)
    star = live.join(centre, "key").where((F.col("rep") != F.col("a")) & possible).select("a", F.col("rep").alias("b")).distinct()
    links = materialize(_confirmed(star, sets, share), "nd-links")
    parts = materialize(components(links, "nd-cc1"), "nd-parts")
    free_shuffles(docs.sparkSession)

    live = materialize(live.join(parts, live.rep == parts.node, "left").select("key", "rep", "n", "most", F.coalesce("component", "rep").alias("part")), "nd-placed")
    rest = _confirmed(prefix_pairs(live, sets, share), sets, share)
    links = materialize(links.unionByName(rest), "nd-all-links")
    parts = components(links, "nd-cc2")

    classes = same.join(parts, same.rep == parts.node, "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("part"), F.col("one.doc_id").alias("id"), "class_size")
    classes = materialize(classes, "nd-parted")
    lowest = materialize(classes.groupBy("part").agg(F.min("id").alias("component")), "nd-lowest")
    classes = materialize(classes.join(lowest, "part").select("s1", "s2", "n_shingles", "component", "class_size", F.lit(True).alias("placed")), "nd-components")
    drop_all(docs.sparkSession, since, keep=(signed, classes))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("placed"), F.col("component")).otherwise(F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def _possible(n: Column, most: Column, other_n: Column, other_most: Column, share: int) -> Column:
    """Whether sets of these sizes, sharing at most that much, can pass the threshold."""
    return F.least(most, other_most, n, other_n) * (100 + share) >= (n + other_n) * share
