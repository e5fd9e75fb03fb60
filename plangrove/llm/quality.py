"""Quality classifier: a generalised additive model with pairwise interactions.

Ten numbers describe a whole text.  Each is cut into bins at quantiles.  Cyclic boosting visits the
features in turn and fits a shallow tree (a few leaves over the feature's bins) to the
current gradient; its leaves are added to that feature's lookup table.  Then the pairs that
explain most of what is left get two-dimensional tables, boosted the same way with one cut on each side.
A score is the sigmoid of the sum of table entries: bin lookups and additions, vectorised.

The model is fitted on at most ``max_rows`` labelled rows, those with the least hash of the id; scoring
covers every row.  Ids, languages, sources and labels are never inputs of a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: The bound of the labelled sample that a model is fitted on.
MAX_ROWS = 8_000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "distinct_words", "same_as_previous", "upper", "digits", "marks", "exclaims", "bars", "line_words")

_UPPER, _DIGIT, _MARK = bytes(range(65, 91)), bytes(range(48, 58)), b"#$%&*@^~_<>{}[]\\=+"
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def features(text: bytes | None) -> tuple[float, ...]:
    """The description of one whole text; null and empty texts give zeros."""
    text = text or b""
    words = text.translate(_FOLDED).split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = len(text)
    less = lambda drop: (size - len(text.translate(None, drop))) / size
    return (
        math.log1p(n),
        size / n,
        len(set(words)) / math.sqrt(n),
        sum(map(eq, words, words[1:])) / n,
        less(_UPPER),
        less(_DIGIT),
        less(_MARK),
        text.count(b"!") / n,
        text.count(b"|") / n,
        n / (1 + text.count(b"\n")),
    )


@dataclass
class Gam:
    """Edges and lookup tables of a fitted model."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[bins[:, a], bins[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(self.bins(x)), -40, 40)))


def _leaves(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins: greedy best cuts, the Newton step of its leaf for each bin."""
    cuts = [(0, len(g))]
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for a, b in cuts:
            for m in range(a + 1, b):
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                if gain > best[0]:
                    best = (gain, (a, b), m)
        if best[1] is None:
            break
        (a, b), m = best[1:]
        cuts.remove((a, b))
        cuts += [(a, m), (m, b)]
    step = np.zeros(len(g))
    for a, b in cuts:
        step[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return step


def _cells(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best table of two by two cells over a pair of features, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    worth = lambda x, y: x * x / (y + ridge)
    parts = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    pg, ph = parts(cg), parts(ch)
    gain = sum(worth(x, y) for x, y in zip(pg, ph, strict=True))
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    step = np.empty(g.shape)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), pg, ph, strict=True):
        step[rows, cols] = x[i, j] / (y[i, j] + ridge)
    return step, float(gain[i, j] - worth(cg[-1, -1], ch[-1, -1]))


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 5, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Cyclic boosting of one-feature tables, then of the tables of the best pairs. Without rows or with one class: a constant."""
    k = x.shape[1]
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    edges = []
    for j in range(k):
        cut = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(cut)
    model = Gam(math.log(mean / (1 - mean)), edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(x) or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = model.margin(bins)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            r, w = slopes()
            size = len(edges[j]) + 1
            step = rate * _leaves(np.bincount(bins[:, j], r, size), np.bincount(bins[:, j], w, size), 3, ridge)
            model.tables[j] += step
            margin = margin + step[bins[:, j]]
    grid = lambda a, b, v: np.bincount(bins[:, a] * (len(edges[b]) + 1) + bins[:, b], v, (len(edges[a]) + 1) * (len(edges[b]) + 1)).reshape(len(edges[a]) + 1, -1)
    r, w = slopes()
    gains = sorted(((-_cells(grid(a, b, r), grid(a, b, w), ridge)[1], a, b) for a, b in combinations(range(k), 2)))
    model.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
    model.pair_tables = [np.zeros((len(edges[a]) + 1, len(edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for n, (a, b) in enumerate(model.pairs):
            r, w = slopes()
            step = rate * _cells(grid(a, b, r), grid(a, b, w), ridge)[0]
            model.pair_tables[n] += step
            margin = margin + step[bins[:, a], bins[:, b]]
    return model


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, max_rows: int, learn_from=None) -> DataFrame:
    """At most ``max_rows`` labelled ids' texts (``text, label``), those with the least hash of the id; the bound caps the broadcast.

    Of rows that repeat an id, the least text counts.
    """
    of = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).where("label is not null and __id is not null")
    if learn_from is not None:
        of = of.where(learn_from(F.col("__id")))
    few = of.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    found = docs.join(F.broadcast(few), docs[id_col] == few["__id"]).select("__id", F.col(text_col).alias("text"), "label")
    return found.groupBy("__id", "label").agg(F.min("text").alias("text")).select("text", "label")


def held_out(id_column):
    """A fifth of all ids, by the CRC-32 of the id as text."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def _describe():
    def step(texts):
        rows = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
        return [pa.array(list(rows), pa.list_(pa.float64()))]

    return step


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Gam:
    """A model of ``label`` from rows that are not held out. Rows without a label or id do not count."""
    few = sample_labels(docs, labels, label, id_col, text_col, max_rows, lambda c: ~held_out(c))
    got = few.select("label", text_column(_describe, "struct<f:array<double>>", ["f"])("text")["f"].alias("f")).collect()
    got.sort(key=lambda r: (r["label"], r["f"]))
    return fit(np.array([r["f"] for r in got], np.float64).reshape(len(got), len(FEATURES)), np.array([r["label"] for r in got], np.float64))


def classify(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = THRESHOLD, out: str = "quality_score") -> DataFrame:
    """Adds a struct ``out``: ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold).

    Null and empty texts are scored by their zero features; repeated rows alike; an existing column ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def step(texts):
            x = np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            score = fitted.score(x)
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())]

        return step

    return docs.withColumn(out, text_column(make, "struct<score:double,predicted:int>", ["score", "predicted"])(F.col(text_col)))
