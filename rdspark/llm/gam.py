"""A generalised additive model with pairwise interactions for text quality.

Features are shares and counts of a whole text, made with NumPy over the bytes of a batch. Training boosts in cycles: each feature in turn
gets a tree of at most four leaves over its bins, shrunk and added to its lookup table; then pairs of features whose
four-quadrant trees explain most of what is left get tables of their own. Scoring adds one table entry for each feature and pair.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class); bins are quantiles of that sample.

Defined results: null and empty texts have features 0 and are scored by them; rows without an id are never learned from; labels other than 0 and 1 are left out;
with one class or none the score is constant; repeated rows are repeated; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rdspark.llm.cnn import MARKERS, _hash_words, labelled_rows
from rdspark.llm.tables import fresh
from rdspark.llm.words import grams, hashes, slabs, spans, LOWER

SAMPLE = 6000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 8, 60, 0.15
NAMES = ("words", "word_length", "upper", "punctuation", "symbols", "digits", "bangs", "distinct", "top_word", "repeated_trigrams",
         "line_length", "repeated_lines", "function_words", "final_marks", "not_ascii")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[list(chars.encode())] = 1
    return out


def _range(a: int, b: int) -> np.ndarray:
    out = np.zeros(256, np.float64)
    out[a:b + 1] = 1
    return out


CLASSES = {"upper": _range(0x41, 0x5A), "lower": _range(0x61, 0x7A), "digits": _range(0x30, 0x39), "punctuation": _class(".,;:'\"-?()"),
           "symbols": _class("#$%&*|<>{}[]@^~=+_\\/"), "bangs": _class("!"), "lines": _class("\n"), "wide": _range(0x80, 0xFF), "space": _class(" \t\n\r\x0b\x0c")}
_MARKS = np.unique(_hash_words([w for words in MARKERS.values() for w in words]))


def _per_row(counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of an array over the stretches of rows."""
    sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return (sums[before[1:]] - sums[before[:-1]]).astype(np.float64)


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: distinct values and the count of its commonest one."""
    if not len(h):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    owner = (key[first] >> np.uint64(44)).astype(int)
    top = np.zeros(rows)
    np.maximum.at(top, owner, np.diff(np.r_[first, len(key)]))
    return np.bincount(owner, minlength=rows).astype(float), top


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x features of a slab."""
    rows = len(offs) - 1
    count = {}
    for name, table in CLASSES.items():
        count[name] = _per_row(table.astype(np.uint8)[data], offs)
    low = LOWER[data]
    starts, ends, before = spans(low, offs)
    h, row = hashes(low, starts, ends), np.repeat(np.arange(rows), np.diff(before))
    words, solid = np.diff(before).astype(float), np.diff(offs) - count["space"]
    w, n = np.maximum(words, 1), np.maximum(solid, 1)
    distinct, top = _repeats(h, row, rows)
    g = grams(h, 3)
    inside = row[:len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    g_row = row[:len(g)][inside]
    g_distinct, _ = _repeats(g[inside], g_row, rows)
    g_all = np.bincount(g_row, minlength=rows)
    line_starts, line_ends, line_before = spans(low, offs, CLASSES["lines"].astype(bool))
    lines = np.diff(line_before).astype(float)
    l_distinct, _ = _repeats(hashes(low, line_starts, line_ends), np.repeat(np.arange(rows), np.diff(line_before)), rows)
    marks = np.isin(h, _MARKS)
    final = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    return np.stack([
        np.log1p(words), solid / w, count["upper"] / letters, count["punctuation"] / n, count["symbols"] / n, count["digits"] / n, count["bangs"] / n,
        distinct / w, top / w, 1 - g_distinct / np.maximum(g_all, 1) * (g_all > 0) - (g_all == 0), np.log1p(solid / np.maximum(lines, 1)),
        np.where(lines > 0, 1 - l_distinct / np.maximum(lines, 1), 0), _per_row(marks, before) / w, _per_row(final, before) / w, count["wide"] / n], 1)


class Model:
    """Bin edges and lookup tables. ``constant`` stands in where there was nothing to learn."""

    def __init__(self, constant: float | None = None):
        self.constant, self.base, self.edges, self.tables, self.pairs = constant, 0.0, [], [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        z = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            z += t[bins[:, k]]
        for a, b, t in self.pairs:
            z += t[bins[:, a] * PAIR_BINS // BINS, bins[:, b] * PAIR_BINS // BINS]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -40, 40)))


def _split(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values of the best tree of this depth over ordered bins with gradient sums g and curvature sums h."""
    G, H = g.sum(), h.sum()
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g ** 2 / (left_h + 1) + (G - left_g) ** 2 / (H - left_h + 1)
        k = int(gain.argmax()) + 1
        if gain[k - 1] > G ** 2 / (H + 1) + 1e-9:
            return np.concatenate([_split(g[:k], h[:k], depth - 1), _split(g[k:], h[k:], depth - 1)])
    return np.full(len(g), G / (H + 1))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either axis of a two-way table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, values = 0.0, np.zeros_like(g)
    G, H = cg[-1, -1], ch[-1, -1]
    for i in range(len(g) - 1):
        for j in range(len(g) - 1):
            parts = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            parts.append((G - sum(p[0] for p in parts), H - sum(p[1] for p in parts)))
            gain = sum(a * a / (b + 1) for a, b in parts) - G * G / (H + 1)
            if gain > best:
                v = [a / (b + 1) for a, b in parts]
                best, values = gain, np.empty_like(g)
                values[:i + 1, :j + 1], values[:i + 1, j + 1:], values[i + 1:, :j + 1], values[i + 1:, j + 1:] = v
    return best, values


def train(x: np.ndarray, y: np.ndarray) -> Model:
    n = len(y)
    if n == 0 or y.min() == y.max():
        return Model(0.5 if n == 0 else float(y.mean()))
    m = Model()
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    m.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    m.tables = [np.zeros(BINS) for _ in m.edges]
    bins = m.bins(x)
    z = m.logits(bins)

    def gradient():
        p = 1 / (1 + np.exp(-z))
        return weight * (y - p), weight * p * (1 - p)
    for _ in range(ROUNDS):
        for k in range(len(m.tables)):
            g, h = gradient()
            add = RATE * _split(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS), 2)
            m.tables[k] += add
            z += add[bins[:, k]]
    coarse = bins * PAIR_BINS // BINS
    cells = {(a, b): coarse[:, a] * PAIR_BINS + coarse[:, b] for a in range(len(m.tables)) for b in range(a)}

    def table(c, g, h):
        return np.bincount(c, g, PAIR_BINS ** 2).reshape(PAIR_BINS, -1), np.bincount(c, h, PAIR_BINS ** 2).reshape(PAIR_BINS, -1)
    g, h = gradient()
    gains = sorted(((_quadrants(*table(c, g, h))[0], pair) for pair, c in cells.items()), reverse=True)[:PAIRS]
    found = {pair: np.zeros((PAIR_BINS, PAIR_BINS)) for gain, pair in gains if gain > 1e-6}
    for _ in range(ROUNDS // 3):
        for pair, t in found.items():
            g, h = gradient()
            add = RATE * _quadrants(*table(cells[pair], g, h))[1]
            t += add
            z += add.ravel()[cells[pair]]
    m.pairs = [(a, b, t) for (a, b), t in found.items()]
    return m


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", allowed=None, sample: int = SAMPLE) -> Model:
    """Train on the bounded sample; only features reach the driver."""
    rows = labelled_rows(docs, labels, column, F.lit(True) if allowed is None else allowed, sample)

    def run(batches):
        for batch in batches:
            for _, part, data, offs in slabs(batch):
                x = features(data, offs)
                yield pa.record_batch([part.column("doc_id"), part.column("label"), part.column("at"), pa.array(list(x), pa.list_(pa.float64()))],
                                      names=["doc_id", "label", "at", "x"])
    got = rows.mapInArrow(run, "doc_id long, label int, at long, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending")])
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(NAMES))
    return train(x, np.array(got.column("label").to_pylist(), int))


def score(docs: DataFrame, model: Model, *keep: str, out: str = "score") -> DataFrame:
    """``keep`` columns and the score, named ``out``, for each row. The model, of fixed size, travels with the function."""
    text = fresh(docs, "_scored_text")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias(text))

    def run(batches):
        for batch in batches:
            for _, part, data, offs in slabs(batch, text):
                yield pa.record_batch([*[part.column(c) for c in keep], pa.array(model.scores(features(data, offs)))], names=[*keep, out])
    kept = source.select(*[F.col(f"`{c}`") for c in keep])
    return source.mapInArrow(run, kept.withColumn(out, F.lit(0.0)).schema)
