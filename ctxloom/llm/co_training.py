"""Quality classifier by co-training of a text-content view and a page-metadata view.

Content view: NGRAMS signed hash sums of the words and word pairs of the whole text (A-Z lower-cased), scaled to one length, and shares of
symbols, capitals, digits, other letters and white space, word length, the share of distinct words and of repeated lines, and lengths. Metadata view: source, language (hashed indicators) and the
recorded size. Each view has a logistic regression, fitted by Newton's method. Over ROUNDS rounds each view scores all rows
without labels that no round has taken, labels the most confident positives and negatives, and the other view learns from
them too. Confident are the rows beyond a quantile of the scores of all these rows: 2 MOVE of POOL rows, divided over the classes by
the prior of the labels (2 MOVE rows at least, and all rows that tie with the last), that pass the view's gate too. The gate reads
cross-fitted logits of the labelled rows to fit: each of FOLDS parts is scored by a regression without it (with the loss of the rows taken
so far as its quadratic at the view's weights). A label passes if its calibrated odds are those of CERTAIN or more, and as many times the class's
prior odds as CERTAIN is of even odds; and if, of the labelled rows beyond that limit, the lower bound (95 %, one-sided) of the share that is right is above the class's share and a half.
A view passes labels of both classes on, in the prior's ratio, or none. Those of one round and view weigh as much as 2 MOVE rows at most, however many they
are, so labels keep their weight in a large corpus. Spark sums their gradients and Hessians; the driver gets the sums. Rounds end when neither view passes a label on. Each view
is then calibrated by a Platt fit on labelled rows that neither regressions nor gates have read, and the two calibrated log odds are combined
by a third Platt fit, with the prior of the labels. All documents are scored; `kept` is score >= THRESHOLD.

Labelled rows are a bounded sample chosen by a hash of the id (LABELLED rows, expected); only their features reach the
driver. Rows without labels all take part. Null text counts as empty, null metadata as a value of its own. Without both classes among the
labels every score is 0.5. Of the rows of a labelled id one is learned from. Labels are 0 or 1, others are not learned from. Repeated rows get equal scores; columns other
than text, source, lang and n_chars are not read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import wordhash as wh
from .common import SMALL_SLICE, column_of, give_back, map_slices, materialize

LABELLED, POOL = 6000, 6000
ROUNDS, MOVE = 5, 100
META_BUCKETS = 64
#: Hashed word and word-pair features, and their length beside the other features.
NGRAMS, NGRAM_SCALE = 128, 1.0
THRESHOLD = 0.5
#: The least calibrated probability of a pseudo-label; its odds are also the least lift over the prior's odds.
CERTAIN = 0.9
FOLDS = 4
#: Of the one-sided lower bound of a share.
BOUND_Z = 1.645

_CLASS = np.zeros((256, 5), np.float32)
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-!?()"], 0] = 1
_CLASS[ord("A"):ord("Z") + 1, 1] = 1
_CLASS[ord("0"):ord("9") + 1, 2] = 1
_CLASS[128:, 3] = 1
_CLASS[[ord("!"), ord("?")], 4] = 1
_LETTER_CLASSES = (_CLASS.argmax(1) + _CLASS.any(1)).astype(np.uint8)


def hashed_ngrams(w: wh.Pieces) -> np.ndarray:
    """(texts, NGRAMS): each word and each pair of neighbours adds 1 or -1 to the place that its hash says; rows have length NGRAM_SCALE."""
    n, at = len(w.first) - 1, np.searchsorted(w.first, np.arange(len(w.hash)), side="right") - 1
    pairs = np.flatnonzero(at[1:] == at[:-1])
    h = np.concatenate([w.hash, wh.mix(w.hash[pairs] * wh._PLACE[0] + w.hash[pairs + 1] * wh._PLACE[1])])
    text = np.concatenate([at, at[pairs]])
    place, sign = (h % np.uint64(NGRAMS)).astype(np.int64), 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
    out = np.bincount(text * NGRAMS + place, sign, n * NGRAMS).reshape(n, NGRAMS)
    return out * (NGRAM_SCALE / np.maximum(np.sqrt((out ** 2).sum(1, keepdims=True)), 1.0))


def content_features(texts: pa.Array) -> np.ndarray:
    buf, offsets = wh.text_buffer(texts)
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    sums = np.zeros((n, 5))
    kind = _LETTER_CLASSES[buf]
    for c in range(5):
        run = np.zeros(len(buf) + 1, np.int32)  # a batch has less than 2 GB
        np.cumsum(kind == c + 1, out=run[1:])
        sums[:, c] = (run[offsets[1:]] - run[offsets[:-1]]) / size
    del kind, run
    w = wh.words(texts, lower=False)
    count = np.diff(w.first)
    start, end, first = wh.split(buf, offsets, wh._NEWLINE)
    line = wh.span_hash(buf, start, end)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]) if n else np.zeros(0)
    lines = np.array([len(np.unique(line[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)]) if n else np.zeros(0)
    letters = np.concatenate([[0], np.cumsum(w.end - w.start)])
    length = (letters[w.first[1:]] - letters[w.first[:-1]]) / np.maximum(count, 1)
    # Distinct words fall with length; the share is taken against the square root of the count, too.
    return np.column_stack([
        sums, length / 10, distinct / np.maximum(count, 1), distinct / np.sqrt(np.maximum(count, 1)) / 10, lines / np.maximum(np.diff(first), 1),
        np.log1p(count) / 10, count < 20, np.log1p(np.diff(first)) / 10, hashed_ngrams(wh.words(texts)),
    ]).astype(np.float32).astype(np.float64)  # as stored


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), 2 * META_BUCKETS + 2))
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, zlib.crc32(repr(s).encode()) % META_BUCKETS] = 1
        out[i, META_BUCKETS + zlib.crc32(repr(g).encode()) % META_BUCKETS] = 1
        out[i, -2:] = (np.log1p(max(c, 0)) / 10, 0) if c is not None else (0, 1)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3, more: tuple | None = None) -> np.ndarray:
    """Newton's method on the mean log loss; the last weight is the bias. `more` (weights, gradient, Hessian, rows) is the loss of
    further rows, as its quadratic at those weights, where the search starts."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1]) if more is None else more[0]
    n = len(y) + (0 if more is None else more[3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y)
        h = (x * (p * (1 - p))[:, None]).T @ x
        if more is not None:
            g, h = g + more[1] + more[2] @ (w - more[0]), h + more[2]
        step = np.linalg.solve(h / n + (decay + 1e-9) * np.eye(len(w)), g / n + decay * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _cross_fitted(x: np.ndarray, y: np.ndarray, more: tuple | None = None) -> np.ndarray | None:
    """The logit of each row by a regression without its fold; None where a fold leaves one class alone."""
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):  # every fold has its part of each class
        rows = np.flatnonzero(y == c)
        fold[rows] = np.arange(len(rows)) % FOLDS
    z = np.zeros(len(y))
    for f in range(FOLDS):
        rest = fold != f
        if len(set(y[rest].tolist())) < 2:
            return None
        z[~rest] = _logit(x[~rest], _logistic(x[rest], y[rest], more=more))
    return z


def _least_share(right: int, n: int) -> float:
    """The lower bound of a share of which `right` of n were seen (Wilson)."""
    if not n:
        return 0.0
    p, zz = right / n, BOUND_Z ** 2
    return (p + zz / 2 / n - BOUND_Z * np.sqrt(p * (1 - p) / n + zz / 4 / n / n)) / (1 + zz / n)


def _gate(z: np.ndarray | None, y: np.ndarray, prior: float) -> tuple[float, float]:
    """The logits up to which and from which a view may pass on 0 and 1, by its cross-fitted logits; infinite where it may not."""
    shut = (-np.inf, np.inf)
    if z is None:
        return shut
    slope, shift = _logistic(z[:, None], y, 1e-6)
    if slope <= 1e-6:
        return shut
    share, odds = y.mean(), lambda p: np.log(p / (1 - p))
    sure = odds(CERTAIN)
    low = (odds(share) - sure - max(0.0, odds(prior)) - shift) / slope
    high = (odds(share) + sure + max(0.0, -odds(prior)) - shift) / slope
    for rows, label, of in ((z <= low, 0, 1 - share), (z >= high, 1, share)):
        if _least_share(int((y[rows] == label).sum()), int(rows.sum())) <= max(of, 0.5):
            return shut
    return low, high


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, move: int = MOVE) -> dict | None:
    """Weights of both views, of their calibrations and of the combination, and how many labels each view passed on; None without both classes.
    The rounds of co_train_all over a pool in memory, with whole rows in place of weights."""
    fit, held = _parts(y)
    if fit is None:
        return None
    prior = y.mean()
    x = [[v[fit]] for v in views]
    t = [[y[fit]], [y[fit]]]
    free = np.ones(len(pool[0]), bool)
    models, passed = [_logistic(views[k][fit], y[fit]) for k in (0, 1)], [0, 0]
    for _ in range(rounds):
        taken = np.zeros(len(free), bool)
        for k in (0, 1):
            more = _quadratic(np.concatenate(x[k][1:]), np.concatenate(t[k][1:]), models[k]) if len(x[k]) > 1 else None
            z, limits = _logit(pool[k], models[k]), _gate(_cross_fitted(views[k][fit], y[fit], more), y[fit], prior)
            label = _taken(z, limits)
            rows = np.flatnonzero(free)
            order = rows[np.argsort(z[rows], kind="stable")]
            want = [2 * move * (1 - prior), 2 * move * prior]
            found = [side[:int(np.ceil(w))][label[side[:int(np.ceil(w))]] == c] for c, (side, w) in enumerate(zip((order, order[::-1]), want, strict=True))]
            part = min(1.0, *[len(f) / w for f, w in zip(found, want, strict=True)])
            found = [f[:int(np.ceil(part * w))] for f, w in zip(found, want, strict=True)] if part else []
            for c, rows in enumerate(found):
                x[1 - k].append(pool[1 - k][rows])
                t[1 - k].append(np.full(len(rows), float(c)))
                taken[rows] = True
                passed[k] += len(rows)
        if not taken.any():
            break
        free &= ~taken
        models = [_logistic(np.concatenate(x[k]), np.concatenate(t[k])) for k in (0, 1)]
    return _calibrated(views, y, held, models) | {"passed": passed}


def _quadratic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple:
    """The log loss of rows as _logistic takes it beside its own."""
    x = np.column_stack([x, np.ones(len(x))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return w, x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x, len(y)


def _parts(y: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Masks of the labelled rows to fit and to calibrate; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None, None
    held = np.arange(len(y)) % 3 == 2  # for calibration only
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.ones(len(y), bool)
    return (~held if not held.all() else held), held


def _calibrated(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, models: list[np.ndarray]) -> dict:
    platt = [_logistic(_logit(views[k][held], models[k])[:, None], y[held], 1e-6) for k in (0, 1)]
    both = np.column_stack([_logit(_logit(views[k][held], models[k])[:, None], platt[k]) for k in (0, 1)])
    return {"models": models, "platt": platt, "both": _logistic(both, y[held], 1e-4)}


def _taken(z: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
    """0 and 1 for the rows that a view labels in a round, else -1."""
    return np.where((z <= limits[0]) & (z < 0), 0, np.where((z >= limits[1]) & (z > 0), 1, -1))


def _meta_logit(small: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The logit of rows (source bucket, language bucket, size, no size)."""
    at = small[:, :2].astype(np.int64)
    return np.clip(w[at[:, 0]] + w[META_BUCKETS + at[:, 1]] + small[:, 2:] @ w[-3:-1] + w[-1], -30, 30)


def _dense_meta(small: np.ndarray) -> np.ndarray:
    out = np.zeros((len(small), 2 * META_BUCKETS + 2))
    rows, at = np.arange(len(small)), small[:, :2].astype(np.int64)
    out[rows, at[:, 0]] = out[rows, META_BUCKETS + at[:, 1]] = 1
    out[:, -2:] = small[:, 2:]
    return out


def _small_meta(meta: np.ndarray) -> np.ndarray:
    return np.column_stack([meta[:, :META_BUCKETS].argmax(1), meta[:, META_BUCKETS:-2].argmax(1), meta[:, -2:]])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = column_of(batch, name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 4))


def _logits(batch: pa.RecordBatch, models: list[np.ndarray]) -> list[np.ndarray]:
    """Both views' logits, rounded so that equal rows tie in every batch."""
    return [np.round(z, 9) for z in (_logit(_matrix(batch, "content"), models[0]), _meta_logit(_matrix(batch, "meta"), models[1]))]


def _free(batch: pa.RecordBatch, past: list) -> pa.RecordBatch:
    """The rows that no past round (models, limits) has taken; what a round takes depends on a row's features alone."""
    free = np.ones(batch.num_rows, bool)
    for models, limits in past if batch.num_rows else ():
        for z, limit in zip(_logits(batch, models), limits, strict=True):
            free &= _taken(z, limit) < 0
    return batch.filter(pa.array(free))


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a dict of columns for each batch that has rows."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch)):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        give_back()  # workers live on for later stages

    return df.mapInArrow(run, schema)


def _sums(taken: DataFrame, models: list[np.ndarray], weights: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradient and Hessian sums of each view's log loss over the rows that the other view has labelled."""
    sizes = [len(w) for w in models]

    def sums(batches):
        """The cells of a task's sums that are not 0."""
        total = [np.zeros(n + n * n) for n in sizes]
        for batch in batches:
            if not batch.num_rows:
                continue
            rounds = column_of(batch, "round").to_numpy()
            for k in (0, 1):
                label = column_of(batch, f"label{1 - k}").to_numpy()
                rows = np.flatnonzero(label >= 0)
                if len(rows):
                    part = _matrix(batch, "content")[rows] if k == 0 else _dense_meta(_matrix(batch, "meta")[rows])
                    weight = np.array([weights[int(r), 1 - k, int(c)] for r, c in zip(rounds[rows], label[rows], strict=True)])
                    x = np.column_stack([part, np.ones(len(rows))])
                    p = 1 / (1 + np.exp(-np.clip(x @ models[k], -30, 30)))
                    total[k] += np.concatenate([x.T @ (weight * (p - label[rows])), ((x * (weight * p * (1 - p))[:, None]).T @ x).reshape(-1)])
        some = [np.flatnonzero(t) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i * 2 + k for k, i in enumerate(some)])), pa.array(np.concatenate([t[i] for t, i in zip(total, some, strict=True)]))], names=["k", "v"])
        give_back()

    out = [np.zeros(n + n * n) for n in sizes]
    for row in taken.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # cells of two matrices at most
        out[row["k"] % 2][row["k"] // 2] = row["v"]
    return [(o[:n], o[n:].reshape(n, n)) for o, n in zip(out, sizes, strict=True)]


def _learn(views: list[np.ndarray], y: np.ndarray, taken: DataFrame, weights: dict, counts: dict, start: list[np.ndarray], decay: float = 1e-3) -> tuple[list[np.ndarray], list[tuple]]:
    """Both views' regressions over the labelled rows and the sums of those taken, by the steps of _logistic from `start`; and the
    quadratics of those taken."""
    x = [np.column_stack([v, np.ones(len(v))]) for v in views]
    models = start
    rows = [sum(weights[key] * c for key, c in counts.items() if key[1] == 1 - k) for k in (0, 1)]
    for _ in range(25):
        more, most, now = _sums(taken, models, weights), 0.0, []
        quadratics = [(w, *m, r) for w, m, r in zip(models, more, rows, strict=True)]
        for k, w in enumerate(models):
            n = len(y) + rows[k]
            p = 1 / (1 + np.exp(-np.clip(x[k] @ w, -30, 30)))
            g = (x[k].T @ (p - y) + more[k][0]) / n + decay * w
            h = ((x[k] * (p * (1 - p))[:, None]).T @ x[k] + more[k][1]) / n + (decay + 1e-9) * np.eye(len(w))
            step = np.linalg.solve(h, g)
            now.append(w - step)
            most = max(most, np.abs(step).max())
        models = now
        if most < 1e-6:
            break
    return models, quadratics


def co_train_all(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, free: DataFrame, rounds: int = ROUNDS, prior: float | None = None) -> dict | None:
    """co_train over a table of all rows without labels (content, meta); labelled rows are in numpy. prior: the share of 1 among all labels,
    where y is a sample of other shares."""
    fit, held = _parts(y)
    if fit is None:
        return None
    prior = y.mean() if prior is None else prior
    models, past, weights, counts, taken, quadratics, passed = [_logistic(v[fit], y[fit]) for v in views], [], {}, {}, None, [None, None], [0, 0]
    n = free.count()
    for r in range(rounds):
        limits = [_gate(_cross_fitted(views[k][fit], y[fit], quadratics[k]), y[fit], prior) for k in (0, 1)]
        if np.isinf(limits).all():
            break

        def scores(batch: pa.RecordBatch, models=models, past=tuple(past)) -> dict:
            rows = _free(batch, past)
            return dict(zip(("z0", "z1"), _logits(rows, models), strict=True)) if rows.num_rows else {}

        z = materialize(_arrow(free, scores, "z0 double, z1 double"), "ct-scores")
        left = z.count()
        if not left:
            break
        move = 2 * max(MOVE, n * MOVE / POOL)
        cut = z.agg(*[F.percentile_approx(f"z{k}", [min(1.0, move * (1 - prior) / left), max(0.0, 1 - move * prior / left)], 10000).alias(f"q{k}") for k in (0, 1)]).first()
        limits = [(min(cut[f"q{k}"][0], limits[k][0]), max(cut[f"q{k}"][1], limits[k][1])) for k in (0, 1)]
        found = z.agg(*[F.count_if(c).alias(f"n{k}{label}") for k in (0, 1) for label, c in _beyond(k, limits[k])]).first()
        # labels of both classes or none: a class that isn't found shuts the view's gate for the round
        limits = [limits[k] if found[f"n{k}0"] and found[f"n{k}1"] else (-np.inf, np.inf) for k in (0, 1)]
        if np.isinf(limits).all():
            break

        def take(batch: pa.RecordBatch, models=models, past=tuple(past), limits=limits, r=r) -> dict:
            rows = _free(batch, past)
            if not rows.num_rows:
                return {}
            a, b = (_taken(z, limit) for z, limit in zip(_logits(rows, models), limits, strict=True))
            rows = rows.filter(pa.array((a >= 0) | (b >= 0)))
            label = [t[(a >= 0) | (b >= 0)] for t in (a, b)]
            return {"round": np.full(rows.num_rows, r), "label0": label[0], "label1": label[1], "content": column_of(rows, "content"), "meta": column_of(rows, "meta")}

        kind = free.schema["content"].dataType.simpleString()
        got = materialize(_arrow(free, take, f"round int, label0 int, label1 int, content {kind}, meta array<double>"), "ct-taken")
        for k in (0, 1):
            if np.isinf(limits[k]).all():
                continue
            want = [2 * MOVE * (1 - prior), 2 * MOVE * prior]
            part = min(1.0, *[found[f"n{k}{c}"] / want[c] for c in (0, 1)])
            for c in (0, 1):
                counts[r, k, c] = found[f"n{k}{c}"]
                weights[r, k, c] = part * want[c] / counts[r, k, c]
                passed[k] += counts[r, k, c]
        past.append((models, limits))
        taken = got if taken is None else taken.unionByName(got)
        models, quadratics = _learn([v[fit] for v in views], y[fit], taken, weights, counts, models)
        quadratics = [q if q[3] else None for q in quadratics]
    return _calibrated(views, y, held, models) | {"passed": passed}


def _beyond(k: int, limits: tuple[float, float]) -> list:
    """_taken over the column z{k}."""
    z = F.col(f"z{k}")
    return [(0, (z <= float(limits[0])) & (z < 0)), (1, (z >= float(limits[1])) & (z > 0))]


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, content, meta (source bucket, language bucket, size, no size)."""
    def run(batch: pa.RecordBatch) -> dict:
        meta = _small_meta(meta_features(*(column_of(batch, c).to_pylist() for c in ("source", "lang", "n_chars"))))
        return {"doc_id": column_of(batch, "doc_id"), "content": list(content_features(column_of(batch, "text")).astype(np.float32)), "meta": list(meta)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, run, f"doc_id {kind}, content array<float>, meta array<double>", most=SMALL_SLICE)


def _plain(docs: DataFrame) -> DataFrame:
    """The columns the views read; missing ones are null."""
    has = set(docs.columns)
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("doc_id", *[(F.col(c) if c in has else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """docs (doc_id, text, source, lang, n_chars), labels (doc_id, quality) -> the views' models."""
    docs = _plain(docs)
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).select(F.col("doc_id").alias("id"), "quality")
    rows = materialize(_features(docs), "ct-features")
    rows = rows.join(known, F.col("doc_id") == F.col("id"), "left").withColumn("kind", F.coalesce("quality", F.lit(2))).drop("id", "quality")
    rows = materialize(rows, "ct-rows")
    n = {r["kind"]: r["n"] for r in rows.where("kind < 2").groupBy("kind").agg(F.countDistinct("doc_id").alias("n")).collect()}
    limit = F.element_at(F.array(*[F.lit(int(min(1.0, LABELLED / 2 / max(1, n.get(k, 0))) * (1 << 30))) for k in (0, 1)]), F.col("kind") + 1)
    got = rows.where("kind < 2").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    got = got.groupBy("doc_id").agg(F.min(F.struct("content", "meta", "kind")).alias("x")).select("doc_id", "x.*").collect()  # about LABELLED ids
    got.sort(key=lambda r: (str(r["doc_id"]), r["content"]))
    if not got:
        return None
    y = np.array([float(r["kind"]) for r in got])
    views = np.array([r["content"] for r in got]), _dense_meta(np.array([r["meta"] for r in got]))
    model = co_train_all(views, y, rows.where("kind = 2").select("content", "meta"), prior=n[1] / (n[0] + n[1]) if n.get(0) and n.get(1) else None)
    if model and n.get(0) and n.get(1):  # the samples of the classes are of other shares than the labels
        model["shift"] = np.log(n[1] / n[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, content_score, meta_score, kept."""
    docs = _plain(docs)

    def run(batch: pa.RecordBatch) -> dict:
        views = (content_features(column_of(batch, "text")), meta_features(*(column_of(batch, c).to_pylist() for c in ("source", "lang", "n_chars"))))
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        if model is None:
            p = each = np.full(len(views[0]), 0.5)
            each = [each, each]
        else:
            z = [_logit(_logit(v, w)[:, None], c) for v, w, c in zip(views, model["models"], model["platt"], strict=True)]
            p = sigmoid(np.clip(_logit(np.column_stack(z), model["both"]) + model.get("shift", 0.0), -30, 30))
            each = [sigmoid(x) for x in z]
        return {"doc_id": column_of(batch, "doc_id"), "score": p, "content_score": each[0], "meta_score": each[1], "kept": p >= THRESHOLD}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, run, f"doc_id {kind}, score double, content_score double, meta_score double, kept boolean", most=SMALL_SLICE)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
