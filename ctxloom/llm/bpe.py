"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The vocabulary file is a `tokenizers` JSON of a word-end BPE over byte-level characters: NFC, white space to one space,
lower case, pieces by its pattern, `</w>` after a piece's last byte. The LEXICON_WORDS most frequent letter runs of all
documents are compiled with their ids into a minimal acyclic transducer (`Transducer`): equal suffixes share states, and
the numbers on the arcs of a word add up to its row in the table of id lists. The transducer is one file, sent to every
executor by Spark and memory-mapped there; a batch's distinct new pieces walk it together. Pieces that it lacks are merged
exactly. The lexicon only saves work: ids are the same without it.

Null texts count as empty: no tokens. The special tokens' strings in a text become their ids, as in the library. Ids
decode to the tokens of the vocabulary joined by one space, as in the library for a file without a decoder. Texts of any
length and pieces of any length are taken whole (long pieces merge by a heap). Repeated rows give equal rows; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from functools import lru_cache
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_SLICE, column_of, map_slices, materialize

LEXICON_WORDS = 50_000
#: Units whose ids a Python task keeps at most before those met once go, and pieces before all go.
CACHE_PIECES = 150_000
#: Bytes of a piece up to which pieces are merged together.
SHORT_PIECE = 24
WORD_END = "</w>"
#: Separators that str.split() takes for white space and the vocabulary does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: White_Space of Unicode, as the vocabulary's \s means it.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where it prints, else the next one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] of each list, one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]


class _PairTable:
    """Numbers of pairs of ids, looked up together: a table with linear probing, at most a quarter full."""

    def __init__(self, numbers: dict[int, int]):
        self.bits = max(4, (4 * len(numbers)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        key, value = np.fromiter(numbers.keys(), np.int64, len(numbers)), np.fromiter(numbers.values(), np.int64, len(numbers))
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            mine, which = np.unique(slot[free], return_index=True)
            self.keys[mine], self.values[mine] = key[free[which]], value[free[which]]
            rest = self.keys[slot] != key
            key, value, slot = key[rest], value[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray, none: int) -> np.ndarray:
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], none)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << self.bits) - 1
            there = self.keys[slot[open_]]
            same = there == key[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._rank = {self.ids[a] << 32 | self.ids[b]: i for i, (a, b) in enumerate(merges)}
        self._made = [self.ids[a + b] for a, b in merges]
        self._inner = [self.ids[c] for c in byte_characters()]
        self._last = [self.ids[c + WORD_END] for c in byte_characters()]
        self._ranks = _PairTable(self._rank)
        self._made_ids, self._inner_ids, self._last_ids = (np.array(x, np.int64) for x in (self._made, self._inner, self._last))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        self._utf8 = [t.encode() for t in self.tokens]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}"))
        self._special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))

    @staticmethod
    def normal(text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # characters are lowered one by one, without the final form
        return text.lower()

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a normal text without special tokens."""
        return self._pieces.findall(unit)

    def units(self, text: str | None) -> list[str]:
        """Runs without white space, whose ids are independent of each other; a special token is a unit with a leading space."""
        if not text:
            return []
        if "<|" in text and self._special.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += [*self.units(text[at:m.start()]), " " + m[0]]
                at = m.end()
            return out + self.units(text[at:])
        text = self.normal(text)
        return self._pieces.findall(text) if _SEPARATORS.search(text) else text.split()

    def merge(self, piece: str) -> list[int]:
        """The ids of a piece by its merges, lowest rank first, leftmost first."""
        data = piece.encode()
        ids = [self._inner[b] for b in data]
        ids[-1] = self._last[data[-1]]
        if len(ids) > 200:
            return self._long(ids)
        rank, made, none = self._rank.get, self._made, len(self._made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at] = made[best]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank(ids[at] << 32 | ids[at + 1], none)
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | ids[at], none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self._rank
        before, after, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(rank[k], i, k) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] << 32 | ids[j] != pair:
                continue
            ids[i] = self._made[best]
            live[j], after[i] = False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := ids[a] << 32 | ids[b]) in rank:
                    heapq.heappush(heap, (rank[k], a, k))
        return [x for x, on in zip(ids, live, strict=True) if on]

    def merge_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): what `merge` gives for each piece; short pieces take their merges together, one a piece and round."""
        data = [p.encode() for p in pieces]
        length = np.fromiter(map(len, data), np.int64, len(data))
        short = length <= SHORT_PIECE
        long = [self.merge(p) for p in compress(pieces, (~short).tolist())]
        size = np.zeros(len(data), np.int64)
        size[~short] = np.fromiter(map(len, long), np.int64, len(long))
        raw, n = np.frombuffer(b"".join(compress(data, short.tolist())), np.uint8), length[short]
        ids = self._inner_ids[raw]
        ends = np.cumsum(n)
        ids[ends - 1] = self._last_ids[raw[ends - 1]]
        none, piece = len(self._made), np.arange(len(n))
        rank = self._ranks.get(ids[:-1] << 32 | ids[1:], none) if len(ids) else ids
        rank = np.append(rank, none) if len(ids) else rank
        rank[ends - 1] = none
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(n):
            first = np.cumsum(n) - n
            best = np.minimum.reduceat(rank, first)
            on = best < none
            if not on.all():
                each = np.repeat(on, n)
                done.append((piece[~on], n[~on], ids[~each]))
                ids, rank, piece, n, best = ids[each], rank[each], piece[on], n[on], best[on]
                if not len(n):
                    break
                first = np.cumsum(n) - n
            at = np.flatnonzero(rank == np.repeat(best, n))
            of = np.searchsorted(first, at, side="right")
            at = at[np.diff(of, prepend=0) > 0]  # the leftmost of each piece
            ids[at], rank[at] = self._made_ids[best], rank[at + 1]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            last = at + 1 == first + n - 1
            ids, rank, n = ids[stays], rank[stays], n - 1
            at = at - np.arange(len(at))
            first = np.cumsum(n) - n
            rank[at[last]] = none
            right, left = at[~last], at[at > first]
            rank[right] = self._ranks.get(ids[right] << 32 | ids[right + 1], none)
            rank[left - 1] = self._ranks.get(ids[left - 1] << 32 | ids[left], none)
        where = np.concatenate([x[0] for x in done]) if done else piece
        held = np.concatenate([x[1] for x in done]) if done else n
        flat = np.concatenate([x[2] for x in done]) if done else ids
        order = np.argsort(where)
        flat = _gather(flat, (np.cumsum(held) - held)[order], held[order])
        size[short] = held[order]
        out, of_short = np.empty(int(size.sum()), np.uint32), np.repeat(short, size)
        out[of_short] = flat
        out[~of_short] = np.fromiter(chain.from_iterable(long), np.uint32, len(out) - len(flat))
        return size, out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def decode_utf8(self, ids: list[int]) -> bytes:
        return b" ".join(map(self._utf8.__getitem__, ids))


class Transducer:
    """A minimal acyclic automaton of byte strings whose arcs' numbers add up to a word's rank; ranks have id lists."""

    FIELDS = (("key", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("start", np.int32), ("ids", np.uint32))

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> Transducer:
        """Incremental construction from sorted words; a state is (final, arcs), arcs are byte -> state number."""
        states: list[tuple[bool, dict[int, int]]] = []
        register: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                if key not in register:
                    register[key] = len(states)
                    states.append((final, arcs))
                path[-1][1][last[len(path) - 1]] = register[key]

        order = sorted(words)
        for word in order:
            same = len(os.path.commonprefix([last, word]))
            close(same)
            path += [[False, {}] for _ in word[same:]]
            path[-1][0] = True
            last = word
        close(0)
        states.append((path[0][0], path[0][1]))
        count = [0] * len(states)
        arcs = []
        for s, (final, out) in enumerate(states):  # targets come before their sources
            total = int(final)
            for b, t in sorted(out.items()):
                arcs.append((s << 8 | b, t, total))
                total += count[t]
            count[s] = total
        lists = [words[w] for w in order]
        columns = [[a[i] for a in arcs] for i in range(3)]
        start = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        rows = [*columns, [f for f, _ in states], start, [i for x in lists for i in x]]
        return Transducer(**{name: np.array(v, kind) for (name, kind), v in zip(Transducer.FIELDS, rows, strict=True)})

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            arrays = [getattr(self, name) for name, _ in self.FIELDS]
            f.write(struct.pack(f"<{len(arrays)}q", *[len(a) for a in arrays]))
            for a in arrays:
                f.write(a.tobytes())
                f.write(b"\0" * (-a.nbytes % 8))

    @staticmethod
    def load(path: str) -> Transducer:
        """Memory-map a saved transducer; processes of one machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        sizes = raw[:8 * len(Transducer.FIELDS)].view(np.int64)
        at, out = 8 * len(sizes), {}
        for (name, kind), n in zip(Transducer.FIELDS, sizes, strict=True):
            size = int(n) * np.dtype(kind).itemsize
            out[name] = raw[at:at + size].view(kind)
            at += size + -size % 8
        return Transducer(**out)

    def rank(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon; all words walk together."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        first = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words), np.uint8)
        state, rank = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        live, depth = np.flatnonzero(length > 0), 0
        rank[length == 0] = -1
        while len(live):
            key = state[live] << 8 | data[first[live] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key if len(self.key) else np.zeros(len(live), bool)
            rank[live[~ok]] = -1
            live, at = live[ok], at[ok]
            state[live] = self.target[at]
            rank[live] += self.add[at]
            depth += 1
            ended = length[live] == depth
            done = live[ended]
            rank[done[self.final[state[done]] == 0]] = -1
            live = live[~ended]
        return rank


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Lists:
    """Lists of ids in one array, by number."""

    def __init__(self, size: np.ndarray | None = None, flat: np.ndarray | None = None):
        self.size = np.zeros(0, np.int64) if size is None else size
        self.flat = np.zeros(0, np.uint32) if flat is None else flat
        self.start = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> _Lists:
        size = self.size[rows]
        return _Lists(size, _gather(self.flat, self.start[rows], size))

    def append(self, more: _Lists) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + more.start])
        self.size = np.concatenate([self.size, more.size])
        self.flat = np.concatenate([self.flat, more.flat])


class Encoder:
    """Ids of texts: units in the cache, their pieces in the cache, then in the lexicon, then by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known, self.ids, self.uses = _Numbered(), _Lists(), np.zeros(0, np.int64)
        self.pieces, self.piece_ids = _Numbered(), _Lists()

    def _shrink(self) -> None:
        """Units met once go, and all but the CACHE_PIECES / 2 most used of the others; counts of use are halved, so that old ones fade."""
        rows = np.flatnonzero(self.uses > 1)
        if len(rows) > CACHE_PIECES // 2:
            rows = np.sort(rows[np.argsort(-self.uses[rows], kind="stable")[:CACHE_PIECES // 2]])
        chosen = np.zeros(len(self.known), bool)
        chosen[rows] = True
        self.known = _Numbered(zip(compress(self.known, chosen.tolist()), range(len(rows)), strict=True))
        self.ids, self.uses = self.ids.take(rows), self.uses[rows] // 2
        if len(self.pieces) > CACHE_PIECES:
            self.pieces, self.piece_ids = _Numbered(), _Lists()

    def _learn_pieces(self, new: list[str]) -> None:
        """Ids of the pieces that are new in the cache."""
        rank = self.lexicon.rank([p.encode() for p in new]) if self.lexicon is not None else np.full(len(new), -1)
        found = rank >= 0
        size = np.zeros(len(new), np.int64)
        size[~found], merged = self.vocabulary.merge_all(list(compress(new, (~found).tolist())))
        flat_found = np.zeros(0, np.uint32)
        if found.any():
            at = self.lexicon.start[rank[found]].astype(np.int64)
            size[found] = self.lexicon.start[rank[found] + 1] - at
            flat_found = _gather(self.lexicon.ids, at, size[found])
        flat, of_found = np.empty(int(size.sum()), np.uint32), np.repeat(found, size)
        flat[of_found] = flat_found
        flat[~of_found] = merged
        self.piece_ids.append(_Lists(size, flat))

    def _learn(self, new: list[str]) -> None:
        """Ids of the units that are new in the cache. Their pieces are found in one string of all: a unit holds no white space, and its pieces are all of it."""
        special = {i: self.vocabulary.special[u[1:]] for i, u in enumerate(new) if u[0] == " "}
        plain = [u for u in new if u[0] != " "] if special else new
        pieces = self.vocabulary.pieces(" ".join(plain))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))) + 1
        had = len(self.pieces)
        row = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        if len(self.pieces) > had:
            self._learn_pieces(list(islice(self.pieces, had, None)))
        parts = self.piece_ids.take(row)
        before = np.concatenate([[0], np.cumsum(parts.size)])
        size = np.diff(before[np.concatenate([[0], last])])
        flat = parts.flat
        if special:
            at = np.fromiter(special, np.int64, len(special))
            behind = at - np.arange(len(at))  # plain units before each special one
            flat = np.insert(flat, np.concatenate([[0], np.cumsum(size)])[behind], list(special.values()))
            size = np.insert(size, behind, 1)
        self.ids.append(_Lists(size, flat))
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE_PIECES:
            self._shrink()
        units = [self.vocabulary.units(t) for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        had = len(self.known)
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        if len(self.known) > had:
            self._learn(list(islice(self.known, had, None)))
        self.uses += np.bincount(row, minlength=len(self.uses))
        got = self.ids.take(row)
        ends = np.concatenate([[0], np.cumsum(got.size)])
        return np.split(got.flat, ends[np.cumsum(counts)[:-1]]) if len(texts) else []


@lru_cache(2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def _lexicon(path: str) -> Transducer:
    return Transducer.load(path)


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The `most` most frequent lower-case letter runs of all documents, ties in code point order.

    Words far too rare go before the sort (by the sizes of the counts' levels, a few hundred rows), so that the tasks
    send little more than `most` words in all, not each.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count("*").alias("n")), "bpe-words")
    level = F.floor(F.log2("n") * 8)
    least, held = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if held >= most:
            break
        least, held = r["level"], held + r["words"]
    top = counts.where(level >= least).orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def compile_lexicon(words: list[str], vocabulary: Vocabulary) -> Transducer:
    single = {w for w in words if vocabulary.pieces(vocabulary.normal(w)) == [w]}
    return Transducer.compile({w.encode(): vocabulary.merge(w) for w in single})


def _ship(docs: DataFrame, path: str, most: int) -> tuple[str, str]:
    """Send the vocabulary and the compiled lexicon to the executors; their names there."""
    sc = docs.sparkSession.sparkContext
    lexicon = compile_lexicon(frequent_words(docs, most), _vocabulary(path))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    file = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lexicon-")), name)
    lexicon.save(file)
    sc.addFile(file)
    sc.addFile(path)
    return os.path.basename(path), name


def encode(docs: DataFrame, path: str | None = None, lexicon_words: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_tokens, and ids, or with `digests` ids_sha256 and decoded_sha256."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vocabulary_file, lexicon_file = _ship(docs, path or default_vocabulary(), lexicon_words)
    made: dict = {}

    def run(batch: pa.RecordBatch) -> dict:
        vocabulary = _vocabulary(SparkFiles.get(vocabulary_file))
        if not made:
            made["encoder"] = Encoder(vocabulary, _lexicon(SparkFiles.get(lexicon_file)))
        ids = made["encoder"].encode(column_of(batch, "text").to_pylist())
        out = {"doc_id": column_of(batch, "doc_id"), "n_tokens": [len(x) for x in ids]}
        if not digests:
            return out | {"ids": pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids).astype(np.int32))}
        return out | {
            "ids_sha256": [hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(vocabulary.decode_utf8(x.tolist())).hexdigest() for x in ids],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, run, f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"), most=SMALL_SLICE, state=made)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids array<int>) -> doc_id, text. Null ids decode to an empty text; unknown ids fail."""
    path = path or default_vocabulary()
    sc = encoded.sparkSession.sparkContext
    sc.addFile(path)
    name = os.path.basename(path)

    def run(batches):
        vocabulary = _vocabulary(SparkFiles.get(name))
        for batch in batches:
            texts = [vocabulary.decode(x or []) for x in column_of(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
