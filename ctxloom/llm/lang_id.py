"""Language ID by a byte convolutional network over fixed-length windows.

A text's UTF-8 bytes are cut into windows of WINDOW bytes (the last one padded). Filters of several widths slide over a
window; ReLU, max pooling over positions, a linear layer and softmax give each window's language probabilities, and a
text's are their mean, weighted by bytes. The network is trained in numpy on the driver from a bounded sample:
PER_LANG labelled texts a language (expected, by a hash of the id), WINDOWS windows of WINDOW characters each.

Every byte of every text is read. Null texts and texts without a letter: `und`, score 0. Without any labelled row every
text is `und`. Repeated rows get equal results; ties between languages go to the alphabetically first. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import column_of, map_slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANG, WINDOWS = 500, 4
EPOCHS, BATCH, RATE = 5, 64, 0.01
PAD = 256
#: The commonest languages among the labelled rows are learned, so that neither the sample nor the network grows without bound.
MOST_LANGS = 256
UNKNOWN = "und"


def sample_windows(labelled: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(lang, window) of a bounded, hash-chosen sample of rows (doc_id, text, lang); the same rows give the same sample."""
    rows = labelled.where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in counts.collect()}
    if not share:
        return []
    limit = F.create_map(*[F.lit(x) for lang, s in sorted(share.items()) for x in (lang, int(s * (1 << 30)))])[F.col("lang")]
    place = F.xxhash64("doc_id", "text")
    chosen = rows.where(F.pmod(place, F.lit(1 << 30)) < limit).orderBy(place, "lang").limit(2 * per_lang * len(share))  # where equal rows abound, not all of them
    at = [F.pmod(F.xxhash64("doc_id", "text", F.lit(k)), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1 for k in range(WINDOWS)]
    cut = chosen.select("doc_id", "lang", *[F.col("text").substr(a.cast("int"), F.lit(WINDOW)).alias(f"w{k}") for k, a in enumerate(at)])
    got = sorted((str(r["doc_id"]), r["lang"], *[r[f"w{k}"] for k in range(WINDOWS)]) for r in cut.collect())
    return [(r[1], w) for r in got for w in dict.fromkeys(r[2:]) if w]


def _window_array(texts: list[bytes]) -> np.ndarray:
    out = np.full((len(texts), WINDOW), PAD, np.int64)
    for i, t in enumerate(texts):
        out[i, :min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    return out


def _forward(x: np.ndarray, net: dict) -> tuple[np.ndarray, list]:
    pooled, kept = [], []
    for w in WIDTHS:
        t = net[f"t{w}"]
        n = WINDOW - w + 1
        a = net[f"b{w}"] + sum(t[j][x[:, j:j + n]] for j in range(w))
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None, :], 1)[:, 0]
        pooled.append(np.maximum(top, 0))
        kept.append((best, top > 0))
    return np.concatenate(pooled, axis=1), kept


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7) -> dict | None:
    """Adam on cross entropy; each batch also cuts half of its windows to random lengths, for short texts."""
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(lang) for lang, _ in sample])
    raw = _window_array([t.encode() for _, t in sample])
    net = {"out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), np.float32)}
    for w in WIDTHS:
        net[f"t{w}"] = rng.normal(0, 0.1, (w, PAD + 1, FILTERS)).astype(np.float32)
        net[f"t{w}"][:, PAD] = 0
        net[f"b{w}"] = np.zeros(FILTERS, np.float32)
    m = {k: np.zeros_like(v) for k, v in net.items()}
    v = {k: np.zeros_like(x) for k, x in net.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            x = raw[rows].copy()
            cut = rng.integers(8, WINDOW, len(rows))
            x[(np.arange(WINDOW)[None, :] >= cut[:, None]) & (rng.random(len(rows)) < 0.5)[:, None]] = PAD
            h, kept = _forward(x, net)
            z = h @ net["out"] + net["bias"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad = {"out": h.T @ p, "bias": p.sum(0)}
            back = p @ net["out"].T
            for i, w in enumerate(WIDTHS):
                best, on = kept[i]
                g = back[:, i * FILTERS:(i + 1) * FILTERS] * on
                grad[f"b{w}"] = g.sum(0)
                t = np.zeros_like(net[f"t{w}"])
                f = np.broadcast_to(np.arange(FILTERS), g.shape)
                for j in range(w):
                    np.add.at(t[j], (np.take_along_axis(x, best + j, 1), f), g)
                t[:, PAD] = 0
                grad[f"t{w}"] = t
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] -= (RATE * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net | {"langs": langs}


class _Scorer:
    """Window probabilities; byte pairs are looked up in summed tables, two bytes at a time."""

    def __init__(self, net: dict):
        pair = lambda t: (t[0][:, None, :] + t[1][None, :, :]).reshape(-1, FILTERS)
        self.net, self.t2 = net, pair(net["t2"]) + net["b2"]
        self.t3, self.t3c = pair(net["t3"]) + net["b3"], net["t3"][2]
        self.t4, self.t4c = pair(net["t4"]) + net["b4"], pair(net["t4"][2:])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1] * (PAD + 1) + x[:, 1:]
        pools = [
            self.t2[two].max(1),
            (self.t3[two[:, :-1]] + self.t3c[x[:, 2:]]).max(1),
            (self.t4[two[:, :-2]] + self.t4c[two[:, 2:]]).max(1),
        ]
        z = np.maximum(np.concatenate(pools, axis=1), 0) @ self.net["out"] + self.net["bias"]
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def text_probabilities(texts: pa.Array, score: _Scorer, langs: int, block: int = 64) -> np.ndarray:
    """(texts, langs): the byte-weighted mean of the windows' probabilities; zeros for an empty text."""
    buf, offsets = wh.text_buffer(texts)
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), n)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    length = np.minimum(offsets[1:][text] - start, WINDOW)
    out = np.zeros((len(size), langs))
    padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
    for at in range(0, len(text), block):
        rows = slice(at, at + block)
        x = padded[start[rows, None] + np.arange(WINDOW)].astype(np.int32)
        x[np.arange(WINDOW) >= length[rows, None]] = PAD
        np.add.at(out, text[rows], score(x) * length[rows, None])
    return out / np.maximum(size, 1)[:, None]


def predict(docs: DataFrame, net: dict | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (text, ...) -> the columns in `carry`, lang_pred, score (names that `carry` must not hold)."""
    docs = docs.select(*{c: F.col(f"`{c}`") for c in carry if c != "text"}.values(), F.col("text").cast("string").alias("text"))
    if net is None:
        return docs.select(*carry, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    made: dict = {}

    def score(batch: pa.RecordBatch) -> dict:
        if not made:
            made["scorer"] = _Scorer(shared.value)
        langs, texts = shared.value["langs"], column_of(batch, "text")
        p = text_probabilities(texts, made["scorer"], len(langs))
        known = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        return {
            **{c: column_of(batch, c) for c in carry},
            "lang_pred": [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            "score": np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0),
        }

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return map_slices(docs, score, f"{', '.join(kinds)}, lang_pred string, score double", state=made)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame, labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Train on `labelled` (doc_id, text, lang) and predict `docs`."""
    return predict(docs, train(sample_windows(labelled.select("doc_id", "text", "lang"), per_lang)))
