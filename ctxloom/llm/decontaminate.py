"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text's shingles are its 5-word runs. Window sizes form classes
(`window_sizes`), each with a stride of an eighth of its size. An item is indexed under the largest class whose windows,
laid at that stride, must have one lying wholly inside any copy of the item; the index holds the fingerprints of all the
item's sub-windows of that size, so a verbatim copy has a window at distance 0.

A fingerprint has 64 bits, each the sign of the summed bits of the window's shingle hashes (a repeated shingle weighs as
often as it occurs). Fingerprints within RADIUS = 11 bits have, by the pigeonhole principle, one of four 16-bit blocks
within 2 bits; the index enumerates those block values, so every fingerprint within the radius is found. Around each
such window the item-sized windows at SHIFT words to either side are compared with the item by the exact weighted
(multiset) Jaccard similarity of their shingles: SIMILARITY or more is a hit.

Edited copies are found without loss by the pigeonhole principle over pieces of the item. A window that passes misses at
most a fifth of the item's shingles, so of `pieces` that hold more than that many it has one whole. A piece is the
shortest window, one shingle, whose fingerprint is its hash; document windows of this size lie at every position. Around
each piece found, all windows with enough of the item's shingles are compared exactly.

The benchmark is read in blocks of bounded bytes (a block's index is broadcast, about 30 times its text with the enumerated block values; its
size does not depend on the documents); every block scans all documents, every word of them. Null or empty texts and items have no hits; an item with
fewer than five words is one shingle of all its words. Empty tables give no rows. Repeated rows give repeated hits. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import column_of, map_slices

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 4, 11
SHIFT = 2
#: Bytes of benchmark text in one broadcast index.
BENCHMARK_BYTES = 4 << 20
SLICE = 1 << 18

_U = np.uint64


def window_sizes(most: int) -> list[int]:
    """SHINGLE .. 16 one by one, then steps of a fifth."""
    out = list(range(1, 17))
    while out[-1] < most:
        out.append(out[-1] * 6 // 5)
    return out


def stride(size: int) -> int:
    return max(1, size // 8)


def item_class(n: int) -> int:
    return max(c for c in window_sizes(n) if c <= n and (c <= SHINGLE or n - c >= stride(c) - 1))


def _lane(most: int) -> type:
    """The smallest counter that holds `most`."""
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def _bit_sums(h: np.ndarray, lane: type) -> np.ndarray:
    """Running sums of the 64 bits of the hashes, several counters to a 64-bit word. Counters may run over into their
    neighbours, but the difference of two sums is exact as long as a window's own counts fit."""
    bits = np.unpackbits(h.view(np.uint8)).astype(lane, copy=False).view(_U).reshape(len(h), 8 * np.dtype(lane).itemsize)
    out = np.zeros((len(h) + 1, 8 * np.dtype(lane).itemsize), _U)
    np.cumsum(bits, axis=0, dtype=_U, out=out[1:])
    return out


def _fingerprints(sums: np.ndarray, lane: type, at: np.ndarray, m: int) -> np.ndarray:
    """SimHashes of the windows of m shingles at `at`: the bits that more than half of a window's shingles have."""
    counts = (sums[at + m] - sums[at]).view(lane)
    return np.packbits(counts > m // 2, axis=1).view(_U)[:, 0]


def _near_values(errors: int) -> np.ndarray:
    """All 16-bit masks with at most that many bits."""
    masks = np.arange(1 << 16, dtype=np.uint32)
    return masks[np.bitwise_count(masks) <= errors].astype(np.uint16)


def build_index(items: list[tuple[int, str]]) -> dict:
    """The items' shingle bags, and for each class the sub-window fingerprints with the enumerated block tables."""
    w = wh.words(pa.array([t or "" for _, t in items], pa.string()))
    h, first = wh.shingles(w, SHINGLE)
    sizes = np.diff(w.first)
    lane = _lane(int(sizes.max(initial=0)))
    sums = _bit_sums(h, lane)
    entries: dict[int, list] = {}
    bags = []
    for i, n in enumerate(sizes):
        bags.append(Counter(h[first[i]:first[i + 1]].tolist()))
        if n:
            c = item_class(int(n))
            m = max(1, c - SHINGLE + 1)
            offsets = np.arange(1 if n < SHINGLE else n - c + 1)
            fp = h[first[i]:first[i] + 1] if n < SHINGLE else _fingerprints(sums, lane, first[i] + offsets, m)
            entries.setdefault(c, []).extend((int(f), i, int(o)) for f, o in zip(fp, offsets, strict=True))
    masks, classes = _near_values(RADIUS // BLOCKS), {}
    for c, rows in entries.items():
        fp = np.array([r[0] for r in rows], _U)
        tables = []
        for b in range(BLOCKS):
            value = (fp.view(np.uint16).reshape(-1, BLOCKS)[:, b][:, None] ^ masks).reshape(-1)
            order = np.argsort(value, kind="stable")
            entry = np.repeat(np.arange(len(fp), dtype=np.uint16 if len(fp) <= 1 << 16 else np.int32), len(masks))[order]
            starts = np.searchsorted(value[order], np.arange((1 << 16) + 1)).astype(np.int32)
            tables.append((starts, entry))
        classes[c] = (fp, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables)
    n_items = Counter(s for bag in bags for s in bag)
    long = [i for i, n in enumerate(sizes) if n >= SHINGLE]
    rows = sorted((s, i) for i in long for s in pieces(bags[i], n_items))
    sets = [np.array(sorted(bag), _U) for bag in bags]
    return {
        "ids": [i for i, _ in items], "size": sizes, "bags": bags, "classes": classes, "lane": lane, "sets": sets,
        "pieces": np.array([r[0] for r in rows], _U), "piece_item": np.array([r[1] for r in rows], np.int64),
    }


def pieces(bag: Counter, n_items: Counter) -> list[int]:
    """Distinct shingles that occur more often in the item than a window that passes can miss; those of few items first."""
    allowed, out = sum(bag.values()) // 5, []
    for s in sorted(bag, key=lambda s: (n_items[s], s)):
        out.append(s)
        allowed -= bag[s]
        if allowed < 0:
            break
    return out


def _candidates(fp: np.ndarray, index: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(window, entry) pairs within RADIUS."""
    known, _, _, tables = index
    parts = fp.view(np.uint16).reshape(-1, BLOCKS)
    found = []
    for b, (starts, entry) in enumerate(tables):
        lo = starts[parts[:, b]]
        n = starts[parts[:, b].astype(np.int32) + 1] - lo
        window = np.flatnonzero(n)
        n, lo = n[window], lo[window]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window, e = np.repeat(window, n), entry[at]
        near = np.bitwise_count(fp[window] ^ known[e]) <= RADIUS
        found.append((window[near], e[near]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similarity(bag: Counter, other: Counter) -> float:
    both = sum(min(n, other[s]) for s, n in bag.items() if s in other)
    total = sum(bag.values()) + sum(other.values()) - both
    return both / total if total else 0.0


def _pieces_found(h: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """(item, place) of the shingles that are pieces."""
    known = index["pieces"]
    if not len(known) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = np.zeros(1 << 20, bool)
    there[(known >> _U(44)).astype(np.int64)] = True
    place = np.flatnonzero(there[(h >> _U(44)).astype(np.int64)])
    lo, hi = np.searchsorted(known, h[place]), np.searchsorted(known, h[place], side="right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return index["piece_item"][at], np.repeat(place, n)


def _best_window(h: np.ndarray, places: np.ndarray, bag: Counter, known: np.ndarray) -> tuple[float, int] | None:
    """(-similarity, first) of the best window with one of the sorted places, h being a text's shingles; None under SIMILARITY."""
    n, best = sum(bag.values()), None
    for near in np.split(places, np.flatnonzero(np.diff(places) > 2 * n) + 1):
        size = np.minimum(n, np.diff(near, prepend=near[0] - n))
        s = np.repeat(near + 1 - np.cumsum(size), size) + np.arange(size.sum())  # all starts of windows with a place
        base, end = max(int(near[0]) - n + 1, 0), min(int(near[-1]) + n, len(h))
        part = h[base:end]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        run = np.concatenate([[0], np.cumsum(known[at] == part)])
        lo, hi = np.maximum(s, 0) - base, np.minimum(s + n, len(h)) - base
        enough = np.flatnonzero(9 * (run[hi] - run[lo]) >= 4 * (n + hi - lo))
        held, both, a, b = Counter(), 0, 0, 0
        values = part.tolist()
        for x, y in zip(lo[enough].tolist(), hi[enough].tolist(), strict=True):
            if x >= b:
                held, both, a, b = Counter(), 0, x, x
            for v in values[b:y]:
                held[v] += 1
                both += held[v] <= bag.get(v, 0)
            for v in values[a:x]:
                both -= held[v] <= bag.get(v, 0)
                held[v] -= 1
            a, b = x, y
            sim = both / (n + y - x - both)
            if sim >= SIMILARITY and (best is None or (-sim, base + x) < best):
                best = (-sim, base + x)
    return best


def find_hits(texts: pa.Array, index: dict) -> list[tuple[int, int, float, int]]:
    """(text, item, similarity, first word) of the best window of every item found in a text."""
    w = wh.words(texts)
    h, first = wh.shingles(w, SHINGLE)
    lane = index["lane"]
    sizes, sums = np.diff(w.first), _bit_sums(h, lane)
    tried: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for c, entry in index["classes"].items():
        if c < SHINGLE:
            short = np.flatnonzero(sizes >= c)
            place = [w.first[t] + np.arange(sizes[t] - c + 1) for t in short]
            text = np.repeat(short, [len(p) for p in place])
            at = np.concatenate([np.zeros(0, np.int64), *place])
            acc = sum(w.hash[at + j] * wh._PLACE[j] for j in range(c)) + _U(c)
            fp = wh.mix(acc) if len(at) else np.zeros(0, _U)
            rel = at - w.first[text]
        else:
            m, step = c - SHINGLE + 1, stride(c)
            n = np.where(sizes >= c, (sizes - c) // step + 1, 0)
            text = np.repeat(np.arange(len(sizes)), n)
            rel = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
            fp = _fingerprints(sums, lane, first[text] + rel, m) if len(text) else np.zeros(0, _U)
        window, e = _candidates(np.ascontiguousarray(fp), entry) if len(fp) else (np.zeros(0, int), np.zeros(0, int))
        for t, item, s in {(int(text[i]), int(entry[1][k]), int(rel[i] - entry[2][k])) for i, k in zip(window, e, strict=True)}:
            n = int(index["size"][item])
            for at in range(s - SHIFT, s + SHIFT + 1) if n >= SHINGLE else (s,):
                if (t, item, at) in tried:
                    continue
                tried.add((t, item, at))
                lo, hi = max(at, 0), min(at + n, int(sizes[t]))
                if n < SHINGLE:
                    sim = 1.0
                elif hi - lo >= SHINGLE:
                    sim = similarity(index["bags"][item], Counter(h[first[t] + lo:first[t] + hi - SHINGLE + 1].tolist()))
                else:
                    sim = 0.0
                if sim >= SIMILARITY and (-sim, lo) < best.get((t, item), (0.0, 0)):
                    best[t, item] = (-sim, lo)
    item, place = _pieces_found(h, index)
    text = np.searchsorted(first, place, side="right") - 1
    order = np.lexsort((place, item, text))
    item, place, text = item[order], place[order], text[order]
    for rows in np.split(np.arange(len(item)), np.flatnonzero((np.diff(item) != 0) | (np.diff(text) != 0)) + 1) if len(item) else ():
        t, i = int(text[rows[0]]), int(item[rows[0]])
        if sizes[t] >= SHINGLE and (found := _best_window(h[first[t]:first[t + 1]], place[rows] - first[t], index["bags"][i], index["sets"][i])):
            best[t, i] = min(found, best.get((t, i), found))
    return [(t, item, -s, at) for (t, item), (s, at) in sorted(best.items())]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word: one row for each document and each benchmark item found in it."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BENCHMARK_BYTES) or 1
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}"
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        shared = docs.sparkSession.sparkContext.broadcast(build_index(sorted({(r["item_id"], r["text"]) for r in rows}, key=str)))

        def find(batch: pa.RecordBatch, shared=shared) -> dict:
            index = shared.value
            hits = find_hits(column_of(batch, "text"), index)
            ids = column_of(batch, "doc_id")
            return {
                "doc_id": ids.take(pa.array([t for t, *_ in hits], pa.int64())),
                "item_id": [index["ids"][i] for _, i, _, _ in hits],
                "similarity": [s for _, _, s, _ in hits],
                "first_word": [at for *_, at in hits],
            }

        part = map_slices(docs, find, f"{kinds}, similarity double, first_word long", most=SLICE)
        out = part if out is None else out.unionByName(part)
    return out
