"""Vectorised words, lines, word hashes and k-word shingles of a batch of UTF-8 texts.

A word is `[^\\x20\\x09-\\x0D]+` over the bytes of the text, so it never crosses a text's end. Hashes are
64-bit polynomials of the bytes, mixed; they are the same for equal words anywhere in the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Odd multipliers of the positions in a shingle.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        got = _powers[name] = np.cumprod(steps, dtype=U)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int32, n + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, at[-1]) [at[0]:] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Pieces:
    """Words or lines of a batch: byte spans, hashes, and where each text's pieces begin (`first`, n texts + 1)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def _prefix(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * _power(_P, len(buf), "p"), dtype=U, out=out[1:])
    return out


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    prefix = _prefix(buf)
    return mix((prefix[end] - prefix[start]) * _power(_PI, len(buf) + 1, "i")[start] + (end - start).astype(U) * U(0xC2B2AE3D27D4EB4F))


def split(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty runs between breaks, ended by text ends too: (start, end, first)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(buf)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def words(texts: pa.Array, lower: bool = True) -> Pieces:
    buf, offsets = text_buffer(texts)
    if lower:
        buf = _LOWER[buf]
    start, end, first = split(buf, offsets)
    return Pieces(start, end, span_hash(buf, start, end), first)


def shingles(w: Pieces, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the k-word shingles of each text; a text of 1 to k-1 words has one, of all its words."""
    assert 1 <= k <= len(_PLACE)
    n, counts = len(w.hash), np.diff(w.first)
    acc = np.zeros(max(0, n - k + 1), U)
    for j in range(k):
        acc += w.hash[j:j + len(acc)] * _PLACE[j]
    starts = np.arange(len(acc))
    text = np.searchsorted(w.first, starts, side="right") - 1
    whole = starts + k <= w.first[text + 1] if len(acc) else np.zeros(0, bool)
    full = mix(acc[whole])
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per, out=first[1:])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full, first
    out, place = np.empty(first[-1], U), np.ones(first[-1], bool)
    place[first[short]] = False
    out[place] = full
    for t in short:
        h = w.hash[w.first[t]:w.first[t + 1]]
        out[first[t]] = mix(np.array([(h * _PLACE[:len(h)]).sum(dtype=U) + U(len(h))]))[0]
    return out, first
