"""N-gram Jaccard join by prefix trees over globally ordered shingle sets.

A text's set holds its distinct 4-word shingles (A-Z lower-cased). Two texts are linked when
100 * intersection >= share * union; the result has the connected components of the links.

1. One order of all shingles: shingles that many texts hold come last. How many is estimated in a table of 2 ** SKETCH buckets (one
   byte each, whatever the corpus's size) from the shingles that a slice of texts holds twice. Any order gives right
   results; this one keeps frequent passages out of the sets' beginnings.
2. Texts with equal sets collapse to one class by a 128-bit set hash. Of each set, the first n - ceil(share * n) + 1 shingles are
   its prefix; two sets that link have a prefix shingle in common. Shingles that one class alone has in its prefix go.
3. A member meets others at a prefix shingle. What it can share where two sets first meet is at most what is left behind the shingles before
   it: sets of n and m shingles with l and k left can link only if min(l, k) * (100 + share) >= share * (n + m). Of the set whose prefix ends
   first in the order, shingles that no other prefix holds don't count either: the other set's prefix would hold them. The other set can share
   them, so one side of a pair is bound with and one without them. Seven figures of a shingle's members (the number that reach their own
   size, smallest sizes and largest reaches) tell who has no partner there.
4. Every prefix shingle pairs its members with one centre. Then members of different components meet, those outside the largest
   component against all, in blocks of BLOCK where there are many. Pairs of a component's own members add nothing and are not made.
   Every set has marks, about a bit a shingle, each of which tells whether an odd number of its shingles falls there: sets whose marks differ
   in x bits differ in x shingles at least, so pairs with too many differing bits can't link and go. Longer marks fold to the length of shorter ones.
   Full sets are read from the texts for members of the pairs that are left alone, once for the first pairs and once for what the second ones add.
5. Pairs are joined in prefix trees: a centre's partners are stored in a tree of their ordered sets, the commonest shingles
   first, so that near copies share long paths. The centre's set descends; the overlap at a node counts for all sets below it, and a subtree
   goes when the overlap and the lengths that remain can't reach the least that its shortest set needs.
6. Components by alternating large-star and small-star steps.

Null and empty texts, and texts without words: an empty set, linked with nothing, their own component. Ties go to the smallest doc_id.
Rows with one doc_id and different texts are documents of their own; a component's id is the smallest doc_id in it. A null doc_id joins
the component of its set, where that has an id; in a component without any id it is null. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import column_of, drop_all, drop_tables, map_slices, mark, materialize
from .near_dedup import _lists, _small, _sums, components

SHINGLE, SHARE = 4, 85
#: Bits of a bucket number in the table of frequent shingles.
SKETCH = 20
#: Partners in one prefix tree, and members of a prefix shingle that one task compares with the others.
BLOCK = 256

_U = np.uint64


def distinct_shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingles of each text."""
    h, first = wh.shingles(wh.words(texts), k)
    parts = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else h), out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH)).astype(np.int32)


def _repeated(batch: pa.RecordBatch, k: int) -> dict:
    h, n = np.unique(distinct_shingles(column_of(batch, "text"), k)[0], return_counts=True)
    return {"bucket": _bucket(h[n > 1]), "n": n[n > 1]}


def frequency_levels(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """docs (text) -> the logarithm of each bucket's count of repeated shingles, 0 for none: one byte a bucket."""
    counts = map_slices(docs.select("text"), functools.partial(_repeated, k=k), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH, np.uint8)
    out[counts.column("bucket").to_numpy()] = 1 + np.floor(np.log2(counts.column("n").to_numpy()))
    return out


def order_keys(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the global order: by level, then by hash."""
    return levels[_bucket(h)].astype(_U) << _U(58) | wh.mix(h) >> _U(6)


def prefix_length(n: np.ndarray, share: int) -> np.ndarray:
    """Shingles of the prefix of sets of n shingles."""
    return n - (n * share + 99) // 100 + 1


def parity_marks(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks, first): for each set a power of two of 64-bit words with a bit a shingle or more; a bit tells whether an odd number of shingles falls there."""
    n = np.diff(first)
    words = 1 << np.ceil(np.log2(np.maximum(-(-n // 64), 1))).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    bit = (wh.mix(h + _U(0x2545F491)) >> _U(1)).astype(np.int64) & np.repeat(words * 64 - 1, n)
    odd = np.bincount(np.repeat(ends[:-1] * 64, n) + bit, minlength=ends[-1] * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64), ends


def _sign(batch: pa.RecordBatch, levels: Broadcast, k: int, share: int) -> dict:
    h, first = distinct_shingles(column_of(batch, "text"), k)
    n, s1, s2 = _sums(h, first)
    keys = order_keys(h, levels.value)
    parts = [np.sort(keys[a:a + size])[:p] for a, size, p in zip(first, n, prefix_length(n, share), strict=False) if size]
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, prefix_length(n, share), 0))])
    return {**{c: column_of(batch, c) for c in ("doc_id", "h")}, "n_shingles": n, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "prefix": _lists(np.concatenate(parts) if parts else keys, ends),
            "marks": _lists(*parity_marks(h, first))}


def _sets(batch: pa.RecordBatch, levels: Broadcast, k: int) -> dict:
    h, first = distinct_shingles(column_of(batch, "text"), k)
    n, s1, s2 = _sums(h, first)
    keys = order_keys(h, levels.value)
    for a, b in zip(first[:-1], first[1:], strict=True):
        keys[a:b] = np.sort(~keys[a:b])  # the commonest first
    return {"s1": s1.view(np.int64), "s2": s2.view(np.int64), "n_shingles": n, "path": _lists(keys, first)}


@dataclass
class Node:
    """Shingles start to end of a set in a prefix tree; the sets that end here, and the shortest and longest below."""

    of: np.ndarray
    start: int
    end: int
    least: int
    most: int
    ends: list[int] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    return int(apart[0]) if len(apart) else n


def prefix_tree(paths: list[np.ndarray]) -> Node:
    """The prefix tree of sets in ascending order, with edges of many shingles; equal sets end in one node."""
    root = Node(np.zeros(0, _U), 0, 0, 1 << 62, 0)
    line, before = [root], root.of
    for i in sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes()):
        path, last = paths[i], None
        shared = _common(before, path)
        while line[-1].end > shared:
            last = line.pop()
        if line[-1].end < shared:
            fork = Node(last.of, line[-1].end, shared, last.least, last.most, below=[last])
            last.start = shared
            line[-1].below[-1] = fork
            line.append(fork)
        if shared < len(path) or not len(path):
            leaf = Node(path, shared, len(path), len(path), len(path))
            line[-1].below.append(leaf)
            line.append(leaf)
        line[-1].ends.append(i)
        for node in line:
            node.least, node.most = min(node.least, len(path)), max(node.most, len(path))
        before = path
    return root


def search(root: Node, probe: np.ndarray, share: int = SHARE) -> list[int]:
    """The sets of a prefix tree that link with a non-empty set in ascending order."""
    n, out, open_ = len(probe), [], [(root, 0)]
    while open_:
        node, overlap = open_.pop()
        if node.end > node.start:
            edge = node.of[node.start:node.end]
            at = np.searchsorted(probe, edge)
            overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == edge))
            left = n - int(at[-1])  # the edge's last shingle may be among these, so the bound is loose by one
            if (overlap + min(left, node.most - node.end)) * (100 + share) < share * (n + node.least):
                continue
        out += [i for i in node.ends if overlap * (100 + share) >= share * (n + node.end)]
        open_ += [(child, overlap) for child in node.below]
    return out


def _join(rows: pa.Table, share: int) -> pa.Table:
    """A centre's set (b null) against the tree of its partners."""
    b, path = rows.column("b"), rows.column("path").combine_chunks()
    sets = [x.values.to_numpy().view(_U) for x in path]
    partners = [i for i, x in enumerate(b) if x.is_valid]
    centre = next(sets[i] for i, x in enumerate(b) if not x.is_valid)
    found = [partners[i] for i in search(prefix_tree([sets[i] for i in partners]), centre, share)]
    return rows.select(["a", "b"]).take(pa.array(found, pa.int64()))


def close_pairs(pairs: DataFrame, same: DataFrame, share: int) -> DataFrame:
    """pairs (a, b), same (rep, n_shingles, marks, ...) -> the pairs whose marks leave room for a link."""
    reps = materialize(pairs.select("a").union(pairs.select("b")).distinct().toDF("rep"), "nj-met")
    marks = materialize(same.join(_small(reps), "rep", "left_semi").select("rep", "n_shingles", "marks"), "nj-marks")
    of = lambda side: marks.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("marks").alias(f"m{side}"))
    fold = lambda m: f"aggregate(sequence(i, size({m}) - 1, least(size(ma), size(mb))), 0L, (x, j) -> x ^ {m}[j])"
    apart = F.expr(f"aggregate(sequence(0, least(size(ma), size(mb)) - 1), 0, (s, i) -> s + bit_count({fold('ma')} ^ {fold('mb')}))")
    both = F.col("na") + F.col("nb")
    out = materialize(pairs.join(of("a"), "a").join(of("b"), "b").where((both - apart) * (100 + share) >= both * (2 * share)).select("a", "b"), "nj-close")
    drop_tables(reps, marks)
    return out


def linked_pairs(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """pairs (a, b), sets (rep, path) -> the pairs (u, v) that link; partners of one centre in trees of about BLOCK."""
    blocks = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "nj-blocks")
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")
    partners = pairs.join(blocks, "a").select("a", block, "b").join(sets.withColumnRenamed("rep", "b"), "b").select("a", "block", "b", "path")
    centres = blocks.join(sets.withColumnRenamed("rep", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "path")

    def join(rows: pa.Table) -> pa.Table:
        return _join(rows, share)

    out = materialize(partners.unionByName(centres).groupBy("a", "block").applyInArrow(join, "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "nj-links")
    drop_tables(blocks)
    return out


def full_sets(docs: DataFrame, classes: DataFrame, levels: Broadcast, k: int) -> DataFrame:
    """docs (doc_id, text, h), classes (rep, s1, s2, n_shingles, one) -> the full sets (rep, path) of the classes, read from one text each."""
    chosen = materialize(classes.select("rep", "s1", "s2", "n_shingles", F.col("one.doc_id").alias("id"), F.col("one.h").alias("th")), "nj-chosen")
    ids = _small(chosen.select("id", "th"))
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]) & (docs["h"] == ids["th"]), "left_semi").select("text")
    sets = map_slices(texts, functools.partial(_sets, levels=levels, k=k), "s1 long, s2 long, n_shingles long, path array<long>").groupBy("s1", "s2", "n_shingles").agg(F.first("path").alias("path"))
    sets = materialize(sets.join(chosen.drop("id", "th"), ["s1", "s2", "n_shingles"]).select("rep", "path"), "nj-sets")
    drop_tables(chosen)
    return sets


def meeting_members(same: DataFrame, share: int) -> DataFrame:
    """same (rep, n_shingles, prefix) -> the members (token, rep, n, reach, wide) of prefix shingles who may have a partner there: `wide` is
    the size up to which a partner can be, `reach` the same of a partner whose prefix ends no earlier in the order."""
    each = same.select("rep", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("i", "token"))
    shared = materialize(each.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("token"), "nj-shared")
    known = each.join(shared, "token").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("p"))  # of a set's own prefix
    alone = F.expr(f"n - (n * {share} + 99) div 100 + 1") - F.size("p")  # in nobody else's prefix; behind it, another set can hold them
    live = known.select("rep", "n", alone.alias("alone"), F.posexplode("p").alias("i", "p"))
    size = lambda left: F.expr(f"({left}) * {100 + share} div {share} - n")
    live = live.select(F.col("p.token").alias("token"), "rep", "n", size("n - alone - i").alias("reach"), size("n - p.i").alias("wide"))
    live = materialize(live, "nj-meeting")

    # of two partners, one reaches sets of its own size; where neither `reach` does, the smaller one's `wide` does
    far = F.col("reach") >= F.col("n")
    of = lambda value, cond, how: how(F.when(cond, F.col(value)))
    stats = live.groupBy("token").agg(
        F.count_if(far).alias("fars"), *[of(value, cond, how).alias(f"{kind}_{value}") for kind, cond in (("far", far), ("near", ~far)) for value, how in (("n", F.min), ("reach", F.max), ("wide", F.max))])
    fits = lambda kind: _may_link(F.col("n"), F.col("reach"), F.col("wide"), F.col(f"{kind}_n"), F.col(f"{kind}_reach"), F.col(f"{kind}_wide"))
    partner = F.coalesce(F.when(far, F.col("fars") > 1).otherwise(fits("far")), F.lit(False)) | F.coalesce(fits("near"), F.lit(False))
    live_at = live
    live = materialize(live.join(stats, "token").where(partner).select("token", "rep", "n", "reach", "wide"), "nj-live")
    drop_tables(shared, live_at)
    return live


def _may_link(n: Column, reach: Column, wide: Column, m: Column, other_reach: Column, other_wide: Column) -> Column:
    """Whether sets of n and m shingles can link where they first meet. What the set with the earlier end of its prefix has there is in the
    other's prefix or not in the other at all, so its `reach` holds; the other may share what is alone in its prefix, so its `wide` holds."""
    return ((m <= reach) & (n <= other_wide)) | ((m <= wide) & (n <= other_reach))


def apart_pairs(live: DataFrame) -> DataFrame:
    """live (token, rep, n, reach, wide, part): the pairs (a, b) of different parts that may link, each prefix shingle's members outside its largest part
    against all others."""
    sizes = live.groupBy("token", "part").agg(F.count("*").alias("size"))
    groups = sizes.groupBy("token").agg(F.max(F.struct("size", "part")).alias("main"), F.sum("size").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    groups = materialize(groups.select("token", F.col("main.part").alias("main"), F.ceil((F.col("members") - F.col("main.size")) / F.lit(BLOCK)).cast("int").alias("blocks")), "nj-groups")
    rows = live.join(groups, "token")
    few = rows.where("part != main").select("token", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("a"), F.col("n").alias("an"), F.col("reach").alias("ar"), F.col("wide").alias("aw"), F.col("part").alias("ap"))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = (F.col("part") != F.col("ap")) & ((F.col("part") == F.col("main")) | (F.col("a") < F.col("rep")))
    pairs = few.join(every, ["token", "block"]).where(apart & _may_link(*map(F.col, ("n", "reach", "wide", "an", "ar", "aw"))))
    pairs = materialize(pairs.select("a", F.col("rep").alias("b")).distinct(), "nj-apart")
    drop_tables(groups)
    return pairs


def jaccard_join(docs: DataFrame, k: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, class_size (rows with an equal set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    since = mark()
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))
    signed = materialize(map_slices(docs, functools.partial(_sign, levels=levels, k=k, share=share), "doc_id long, h long, n_shingles long, s1 long, s2 long, prefix array<long>, marks array<long>"), "nj-signed")
    one = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    same = signed.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min(one).alias("one"), F.count("*").alias("class_size"), F.first("prefix").alias("prefix"), F.first("marks").alias("marks"))
    same = materialize(same.withColumn("rep", F.monotonically_increasing_id()), "nj-classes")
    live = meeting_members(same, share)

    # a star at each prefix shingle, then the pairs between what stays apart
    centre = live.groupBy("token").agg(F.max(F.struct((F.col("reach") * 1000 / F.col("n")).alias("far"), (-F.col("rep")).alias("rep"), "n", "reach", "wide")).alias("c"))
    centre = centre.select("token", (-F.col("c.rep")).alias("a"), F.col("c.n").alias("an"), F.col("c.reach").alias("ar"), F.col("c.wide").alias("aw"))
    star = live.join(centre, "token").where((F.col("rep") != F.col("a")) & _may_link(*map(F.col, ("n", "reach", "wide", "an", "ar", "aw"))))
    star = materialize(star.select("a", F.col("rep").alias("b")).distinct(), "nj-star")
    star = close_pairs(star, same, share)
    reps = materialize(star.select("a").union(star.select("b")).distinct().toDF("rep"), "nj-reps")
    sets = full_sets(docs, same.join(reps, "rep", "left_semi"), levels, k)
    links = linked_pairs(star, sets, share)
    parts = materialize(components(links, "nj-cc1"), "nj-parts")
    placed = materialize(live.join(parts, live.rep == parts.node, "left").select("token", "rep", "n", "reach", "wide", F.coalesce("component", "rep").alias("part")), "nj-placed")
    pairs = close_pairs(apart_pairs(placed), same, share)
    met = materialize(pairs.select("a").union(pairs.select("b")).distinct().toDF("rep"), "nj-met")
    sets = sets.join(_small(met), "rep", "left_semi").unionByName(full_sets(docs, same.join(met.join(reps, "rep", "left_anti"), "rep", "left_semi"), levels, k))
    links = links.unionByName(linked_pairs(pairs, sets, share))
    parts = components(links, "nj-cc2")

    classes = same.join(parts, same.rep == parts.node, "left").select("s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("part"), F.col("one.doc_id").alias("id"), "class_size")
    classes = materialize(classes, "nj-parted")
    lowest = materialize(classes.groupBy("part").agg(F.min("id").alias("component")), "nj-lowest")
    classes = materialize(classes.join(lowest, "part").select("s1", "s2", "n_shingles", "component", "class_size", F.lit(True).alias("placed")), "nj-components")
    levels.unpersist()
    drop_all(docs.sparkSession, since, keep=(signed, classes))
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("placed"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
