"""Full-text queries against blocks of rows in numpy: a task looks at its rows once for all queries and keeps the best rows of each.

Queries and words grow with the rows, so rows of (query, word, row) grow with the square of the input; none are made here. A `Plan` holds the queries of a pass: the
words they ask for, their phrases as a trie of words, NEAR groups, and queries of one shape (the same nodes) side by side. A block of rows becomes a table of frequencies,
a line for each phrase and column set (a unit) and a column for each row; expressions and scores of queries of one shape are then
taken for many queries at once. A query whose words' largest weights in a block cannot reach its k-th best row so far skips the block.

Scores are left as they are summed; they are rounded afterwards, so a task also keeps rows within SLACK of the k-th, and of equal scores the k lowest ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import plain_characters

K1, B = 1.2, 0.75
LEAF, AND, OR, NOT = range(4)
COLUMNS = ("content", "source")
#: Cells of a block's table of frequencies, and of the queries' scores that are taken at once.
CELLS, AT_ONCE = 1 << 21, 1 << 19
#: Rows and bytes of texts of a block at most (one longer text is one block).
ROWS, BYTES = 4096, 1 << 21
#: Scores are rounded to 1e-12.
SLACK = 1e-11
#: NEAR groups that reach so far look for close pairs of words; others for rows that hold all phrases.
REACH = 16
#: Units of what is counted besides phrases.
N_ROWS, LENGTHS = -1, -2
#: Key of a token: (column * rows + row) * PLACES + place.
PLACES = 1 << 32


def weight(tf, length, mean):
    """A phrase's share of a score, but for its idf: the more of it and the shorter the text, the larger."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The places of what is asked in sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for n places each, one after another."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Plan:
    """The queries of a pass: rows of (query_id, nodes, phrases) as `search.asked` gives them."""

    def __init__(self, rows: Iterable):
        rows = list(rows)
        said = sorted({w for r in rows for x in r["phrases"] for w in x["words"]})
        self.words = [w for w in said if not w.endswith("*")]
        self.prefixes = [w[:-1] for w in said if w.endswith("*")]
        self.of = {w: i for i, w in enumerate([*self.words, *(p + "*" for p in self.prefixes)])}
        self.width = max(len(self.of), 1)
        self.nodes = self.width  # of the trie; a word is the node of its number
        edges: list[dict[int, int]] = []
        plain: dict[tuple, int] = {}
        groups: dict[tuple, int] = {}
        shapes: dict[tuple, list] = {}
        asked = []

        def atom(words: list[str]) -> int:
            node = self.of[words[0]]
            for depth, w in enumerate(words[1:]):
                if depth == len(edges):
                    edges.append({})
                key = node * self.width + self.of[w]
                if key not in edges[depth]:
                    edges[depth][key] = self.nodes
                    self.nodes += 1
                node = edges[depth][key]
            return node

        def unit(x, first: bool) -> tuple | None:
            """(number in `plain`, size) of a phrase that can occur."""
            columns = 3 if x["columns"] is None else sum(1 << COLUMNS.index(c) for c in set(x["columns"]))
            if not x["words"] or not columns:
                return None
            return plain.setdefault((atom(x["words"]), columns, first), len(plain)), len(x["words"])

        for r in rows:
            lines: list = [None] * len(r["phrases"])
            leaves: dict[int, list] = {}
            for x in r["phrases"]:
                leaves.setdefault(x["leaf"], []).append(x)
            for found in leaves.values():
                units = [unit(x, x["first"]) for x in found]
                if len(found) > 1:
                    if None not in units:
                        g = groups.setdefault((tuple(units), found[0]["gap"]), len(groups))
                        for j, x in enumerate(found):
                            lines[x["p"]] = (g, j)
                elif units[0]:
                    lines[found[0]["p"]] = units[0][0]
            nodes = tuple((n["kind"], tuple(n["kids"])) for n in r["nodes"])
            asked.append((r["query_id"], (nodes, tuple((x["counted"], tuple(x["up"])) for x in r["phrases"])), lines))

        self.edges = [(np.array(sorted(e), dtype=np.int64), np.array([e[k] for k in sorted(e)], dtype=np.int64)) for e in edges]
        self.plain = len(plain)
        self.classes: dict[tuple[int, bool], np.ndarray] = {}
        for (node, columns, first), line in plain.items():
            self.classes.setdefault((columns, first), np.full(self.nodes, -1))[node] = line
        keys = list(plain)
        self.groups, line = [], self.plain
        for members, gap in groups:
            self.groups.append(([(keys[u][0], keys[u][1], size, u) for u, size in members], gap, line))
            line += len(members)
        self.never = line  # the line of what occurs nowhere
        #: The line that has the number of rows holding a line's phrase.
        self.counted_by = np.concatenate([np.arange(self.plain), *[[m[3] for m in g[0]] for g in self.groups], [-1]]).astype(np.int64)
        for q, (_, shape, lines) in enumerate(asked):
            shapes.setdefault(shape, []).append((q, [self.never if x is None else x if isinstance(x, int) else self.groups[x[0]][2] + x[1] for x in lines]))
        self.names = np.array([a[0] for a in asked], dtype=np.int64)
        self.shapes = [(nodes, marks, np.array([q for q, _ in own]), np.array([lines for _, lines in own], dtype=np.int64)) for (nodes, marks), own in shapes.items()]
        self._near()
        self.block = max(16, min(ROWS, CELLS // (self.never + 1)))

    def _near(self) -> None:
        """Pairs of words by which NEAR groups are looked for, and the groups of each; `wide` are those without."""
        pairs: dict[int, list[int]] = {}
        self.wide, self.reach = [], 0
        for g, (members, gap, _) in enumerate(self.groups):
            (a, _, m, _), (b, _, n, _) = members[:2]
            if a == b or max(a, b) >= len(self.words) or gap + max(m, n) > REACH:
                self.wide.append(g)
                continue
            self.reach = max(self.reach, gap + 1)
            for key in (a * self.width + b, b * self.width + a):
                pairs.setdefault(key, []).append(g)
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.pair_n = np.array([len(pairs[k]) for k in sorted(pairs)], dtype=np.int64)
        self.pair_first = np.cumsum(self.pair_n) - self.pair_n
        self.pair_groups = np.array([g for k in sorted(pairs) for g in pairs[k]], dtype=np.int64)
        self.in_pairs = np.zeros(self.width, dtype=bool)
        self.in_pairs[self.pairs // self.width] = True
        self.in_groups = np.zeros(self.nodes, dtype=bool)
        self.in_groups[[m[0] for g in self.groups for m in g[0]]] = True

    def weigh(self, counts: dict[int, int]) -> None:
        """Take the numbers of rows that hold each plain unit, of all rows, and the sum of their lengths."""
        self.mean = counts.get(LENGTHS, 0) / max(counts.get(N_ROWS, 0), 1)
        n, total = np.array([counts.get(i, 0) for i in range(self.plain)] + [0], dtype=np.float64), float(counts.get(N_ROWS, 0))
        value = np.log((total - n + 0.5) / (n + 0.5))
        self.idf = np.where(value <= 0, 1e-6, value)[self.counted_by]


def _matrix(parts: list[np.ndarray], lines: int, rows: int) -> np.ndarray:
    """How often each cell (line * rows + row) is named."""
    return np.bincount(np.concatenate(parts), minlength=lines * rows).reshape(lines, rows)


class Block:
    """Tokens of some rows: pairs of arrays (word, key), sorted by key; the first has whole words, one for each length of prefixes follows."""

    def __init__(self, plan: Plan, rows: int, tokens: list[tuple[np.ndarray, np.ndarray]]):
        self.plan, self.rows, self.exact = plan, rows, tokens[0]
        found, heads = list(tokens), tokens
        for depth, (keys, kids) in enumerate(plan.edges):
            leads, deeper = np.zeros(plan.nodes, dtype=bool), []
            leads[keys // plan.width] = True
            for node, key in heads:
                on = leads[node]
                node, key = node[on], key[on]
                for word, at in tokens:
                    there = _find(at, key + depth + 1)
                    on = there >= 0
                    edge = _find(keys, node[on] * plan.width + word[there[on]])
                    deeper.append((kids[edge[edge >= 0]], key[on][edge >= 0]))
            heads = deeper
            found += deeper
        self.node, self.key = (np.concatenate(x) for x in zip(*found, strict=True))
        self.row = (self.key // PLACES) % rows

    def plain(self) -> np.ndarray:
        """Cells of the plain units, as often as they occur."""
        cells = []
        for (columns, first), line in self.plan.classes.items():
            lines = line[self.node]
            on = lines >= 0
            if columns != 3:
                on &= self.key // (PLACES * self.rows) == columns - 1
            if first:
                on &= self.key % PLACES == 0
            cells.append(lines[on] * self.rows + self.row[on])
        return np.concatenate([np.zeros(0, dtype=np.int64), *cells])

    def frequencies(self) -> np.ndarray:
        plan, cells = self.plan, self.plain()
        near = [self._near(size, *found) for size, found in self._candidates(cells)] if plan.groups else []
        return _matrix([cells, *near], plan.never + 1, self.rows)

    def _candidates(self, cells: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        """(members, (groups, rows)) of NEAR groups that may hold in a row."""
        plan, found = self.plan, []
        on = plan.in_pairs[self.exact[0]]
        word, key = self.exact[0][on], self.exact[1][on]
        for m in range(1, min(plan.reach, len(key) - 1) + 1):
            close = np.flatnonzero(key[m:] - key[:-m] <= plan.reach)
            at = _find(plan.pairs, word[close] * plan.width + word[close + m])
            close, at = close[at >= 0], at[at >= 0]
            n = plan.pair_n[at]
            found.append(plan.pair_groups[_spread(plan.pair_first[at], n)] * self.rows + np.repeat((key[close] // PLACES) % self.rows, n))
        if plan.wide:
            holds = _matrix([cells], plan.plain, self.rows) > 0
            found += [g * self.rows + np.flatnonzero(np.logical_and.reduce([holds[m[3]] for m in plan.groups[g][0]])) for g in plan.wide]
        at = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]))
        group, row = at // self.rows, at % self.rows
        sizes = np.array([len(g[0]) for g in plan.groups])[group]
        for size in np.unique(sizes):
            yield int(size), (group[sizes == size], row[sizes == size])

    def _near(self, size: int, group: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Cells of NEAR groups' phrases that lie in a place where all of the group's phrases meet. A phrase is open from its start until its end is more
        than `gap` words back; where all are open, the last one to start closes the place."""
        plan = self.plan
        own, of = np.unique(group, return_inverse=True)
        node, columns, words = (np.array([[m[k] for m in plan.groups[g][0]] for g in own], dtype=np.int64)[of] for k in range(3))
        gap, line = (np.array([plan.groups[g][k] for g in own], dtype=np.int64)[of] for k in (1, 2))
        on = np.flatnonzero(plan.in_groups[self.node])
        cell = self.node[on] * self.rows + self.row[on]
        order = np.argsort(cell, kind="stable")
        cell, key = cell[order], self.key[on[order]]
        parts = []
        for j in range(size):
            asked = node[:, j] * self.rows + row
            lo, hi = np.searchsorted(cell, asked, "left"), np.searchsorted(cell, asked, "right")
            at, which = key[_spread(lo, hi - lo)], np.repeat(np.arange(len(row)), hi - lo)
            column = at // (PLACES * self.rows)
            kept = (columns[which, j] >> column) & 1 > 0
            parts.append(((which * len(COLUMNS) + column)[kept] * PLACES + at[kept] % PLACES, which[kept], np.full(int(kept.sum()), j)))
        start, which, member = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(start, kind="stable")
        start, which, member = start[order], which[order], member[order]
        last = np.searchsorted(start, start, "right") - 1  # of the starts in the same place
        full = np.ones(len(start), dtype=bool)
        for j in range(size):
            latest = np.maximum.accumulate(np.where(member == j, start, -PLACES))[last]
            full &= latest + words[which, j] + gap[which] >= start
        far = np.iinfo(np.int64).max
        close = np.minimum.accumulate(np.where(full, start, far)[::-1])[::-1]
        kept = close <= start + words[which, member] + gap[which]
        return (line[which[kept]] + member[kept]) * self.rows + row[which[kept]]


def _changed(raw: np.ndarray, said: np.ndarray, table: np.ndarray) -> None:
    """Write into said what becomes of the characters of raw (UTF-8) beyond ASCII: a character of the same length, or one byte and zeros for the others."""
    lead = np.flatnonzero(raw >= 0xC0)
    size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
    for n, mask in ((2, 0x1F), (3, 0x0F)):  # the table ends before longer ones
        at = lead[size == n]
        code = raw[at].astype(np.int64) & mask
        for j in range(1, n):
            code = code << 6 | raw[at + j] & 0x3F
        at, code = at[code < len(table)], code[code < len(table)]
        to = table[code]
        on = to != code
        at, to = at[on], to[on]
        short = to < 0x80
        said[at] = np.where(short, np.maximum(to, 0), 0xC0 | to >> 6)
        for j in range(1, n):
            said[at + j] = 0
        said[at[~short] + 1] = 0x80 | to[~short] & 0x3F


def tokens(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts as `text.search_text` leaves them, and the number of the text of each."""
    data, ends = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    said = np.concatenate([table[:0x80], np.arange(0x80, 0x100)]).astype(np.uint8)[raw]
    if (raw > 0x7F).any():
        _changed(raw, said, table)
        if len(gone := np.flatnonzero(said == 0)):
            said, ends = said[said != 0], ends - np.searchsorted(gone, ends)
    letter = said != 32
    begins, closes = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    closes[:-1] &= ~letter[1:]
    inner = ends[(ends > 0) & (ends < len(said))]  # texts lie side by side
    begins[inner], closes[inner - 1] = letter[inner], letter[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(closes)
    at = np.concatenate([[0], np.cumsum(last - first + 1)]).astype(np.int32)
    place = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(first, ends)))
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(said[letter])), place


def said(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of at most so many rows (id, content, source), texts as `text.search_text` leaves them -> ids, terms, their number by column and row, and of each term
    column * rows + row and its place."""
    table = np.array(plain_characters(), dtype=np.int32)
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(1 + c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(COLUMNS))))
        at = 0
        while at < batch.num_rows:
            room = np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right")
            part = batch.slice(at, min(most, max(1, int(room) - at)))
            rows = part.num_rows
            at += rows
            words, place = tokens(pa.concat_arrays([part.column(1 + c) for c in range(len(COLUMNS))]), table)
            n = np.bincount(place, minlength=len(COLUMNS) * rows)
            yield part.column(0), words.dictionary_encode(), n.reshape(len(COLUMNS), rows), place, np.arange(len(place)) - (np.cumsum(n) - n)[place]


def text_blocks(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Block]]:
    """Batches of (id, content, source), texts as `text.search_text` leaves them -> ids, lengths, tokens."""
    cuts = {n: [p for p in plan.prefixes if len(p) == n] for n in sorted({len(p) for p in plan.prefixes})}
    looks = [(None, pa.array(plan.words, pa.string()), None), *((n, pa.array(own, pa.string()), np.array([plan.of[p + "*"] for p in own])) for n, own in cuts.items())]
    for ids, words, n, place, at in said(batches, plan.block):
        key, which, found = place * PLACES + at, words.indices.to_numpy(zero_copy_only=False), []
        for cut, known, of in looks:
            forms = words.dictionary if cut is None else pc.utf8_slice_codeunits(words.dictionary, 0, cut)
            number = pc.fill_null(pc.index_in(forms, value_set=known), -1).to_numpy(zero_copy_only=False)[which]
            on = np.flatnonzero(number >= 0)
            found.append((number[on].astype(np.int64) if cut is None else of[number[on]], key[on]))
        yield ids.to_numpy(zero_copy_only=False), n.sum(axis=0), Block(plan, n.shape[1], found)


def count(plan: Plan, blocks: Iterator[tuple[np.ndarray, np.ndarray, Block]]) -> Iterator[pa.RecordBatch]:
    """(unit, n): rows that hold each plain unit, all rows, and the sum of their lengths."""
    n, rows, length = np.zeros(plan.plain, dtype=np.int64), 0, 0
    for ids, lengths, block in blocks:
        n += (_matrix([block.plain()], plan.plain, block.rows) > 0).sum(axis=1)
        rows, length = rows + len(ids), length + int(lengths.sum())
    there = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[N_ROWS, LENGTHS], there]), pa.int32()), pa.array(np.concatenate([[rows, length], n[there]]), pa.int64())], names=["unit", "n"])


class _Kept:
    """The best rows of each query; least: the score that a row needs."""

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.least = top_k, np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.new = self.old = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.new += len(query)
        if self.new > max(AT_ONCE // 2, self.old):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...] | None:
        if not self.parts:
            return None
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query))
        last = np.flatnonzero(query[self.top_k - 1 :] == query[: len(query) - self.top_k + 1]) if len(query) >= self.top_k else place[:0]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else place > 0
        kth = last[first[last]] + self.top_k - 1  # of queries with so many rows
        self.least[query[kth]] = score[kth] - SLACK
        fresh = first.copy()
        fresh[1:] |= score[1:] != score[:-1]
        tied = place - np.maximum.accumulate(np.where(fresh, place, 0))
        kept = (score >= self.least[query]) & (tied < self.top_k)
        self.parts = [(query[kept], ids[kept], score[kept])]
        self.new, self.old = 0, int(kept.sum())
        return self.parts[0]


def _values(nodes: tuple, found: list, most: bool = False) -> list:
    """Whether each node holds, where found says it of phrases; most: whether it can hold, with what NOT takes away left out of account."""
    v: list = []
    for kind, kids in nodes:
        of = [found[k] for k in kids] if kind == LEAF else [v[k] for k in kids]
        if kind == NOT:
            v.append(of[0] if most else of[0] & ~of[1])
        else:
            value = of[0]
            for x in of[1:]:
                value = value | x if kind == OR else value & x
            v.append(value)
    return v


def best(plan: Plan, blocks: Iterator[tuple[np.ndarray, np.ndarray, Block]], top_k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(query_id, id, score): rows of a task that can be among the best of all."""
    kept = _Kept(len(plan.names), top_k)
    for ids, lengths, block in blocks:
        w = weight(block.frequencies().astype(np.float64), lengths, plan.mean)
        w *= plan.idf[:, None]
        most, at_once = w.max(axis=1), max(1, AT_ONCE // block.rows)
        for nodes, marks, queries, lines in plan.shapes:
            bound = most[lines]
            can = _values(nodes, [bound[:, p] > 0 for p in range(len(marks))], True)[-1]
            live = np.flatnonzero(can & (bound[:, [m[0] for m in marks]].sum(axis=1) >= kept.least[queries]))
            strict = all(k in (LEAF, AND) for k, _ in nodes)
            for at in range(0, len(live), at_once):
                own = live[at : at + at_once]
                part = [w[lines[own, p]] for p in range(len(marks))]
                v = _values(nodes, [x > 0 for x in part])
                score = np.zeros(part[0].shape)
                for x, (counted, up) in zip(part, marks, strict=True):
                    if counted:
                        score += x if strict else np.where(np.logical_and.reduce([v[n] for n in up]), x, 0.0)
                q, row = np.nonzero(v[-1] & (score >= kept.least[queries[own]][:, None]))
                kept.add(queries[own[q]], ids[row], score[q, row])
    found = kept.cut()
    for at in range(0, len(found[0]) if found else 0, AT_ONCE):
        query, ids, score = (x[at : at + AT_ONCE] for x in found)
        yield pa.RecordBatch.from_arrays([pa.array(plan.names[query]), pa.array(ids, kind), pa.array(score)], names=["query_id", "id", "score"])
