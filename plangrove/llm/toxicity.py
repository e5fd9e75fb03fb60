"""Toxicity: cumulative-link ordinal regression on sparse word features.

Severity has ordered grades.  One weight vector over sparse features (log counts of words and word beginnings chosen by their
association with the label) is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with rising theta.  The
output is the expected grade, the sum of those probabilities, and the decision P(grade > 0) >= ``threshold``.

Labels only say toxic or not.  The grades of toxic training rows come from outside the features of the final model's own fit: the rows are dealt to
``FOLDS`` folds by the hash of their text, a binary model fitted on the other folds gives each its log odds, and the toxic rows are graded 1 to 3 by thirds of these; other rows
have grade 0.  A grade says how surely texts like this one, but not this one, were labelled toxic.  The model is fitted on
at most ``max_rows`` labelled rows (least hash of the id) that are not held out (:func:`quality.held_out`); scoring covers every row and every word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, text_column
from .decontam import words_of
from .quality import held_out, sample_labels

MAX_ROWS = 8_000
#: Bytes of labelled text that the driver takes in; beyond, longer texts are passed over.
MAX_BYTES = 128 << 20
#: Words that may carry a weight.
MAX_FEATURES = 2_000
#: Labelled texts that a word must occur in, and the standard errors it must stand out by, to be a feature.
LEAST_TEXTS = 12
LEAST_Z = 5.0
GRADES = 4
#: Parts of the training rows that are graded by the others.
FOLDS = 3
THRESHOLD = 0.4


def features_of(word: bytes) -> list[bytes]:
    """A word and its beginnings: invented and inflected insults share a stem."""
    return [word, *(b"^" + word[:k] for k in range(4, min(8, len(word))))]


def _count(text: bytes | None, only=None) -> Counter:
    out: Counter = Counter()
    for w, n in Counter(words_of(text)).items():
        for f in features_of(w):
            if only is None or f in only:
                out[f] += n
    return out


@dataclass
class Ordinal:
    weights: dict[bytes, float]
    theta: np.ndarray

    def __post_init__(self):
        self._of = ByteCache()

    def above(self, text: bytes | None) -> np.ndarray:
        """P(grade > k) for each threshold."""
        of, weights, seen = self._of, self.weights, Counter()
        for w, n in Counter(words_of(text)).items():
            known = of.get(w)
            if known is None:
                known = tuple(f for f in features_of(w) if f in weights)
                of.put(w, known, 8 * len(known))
            for f in known:
                seen[f] += n
        z = sum(weights[f] * float(np.log2(1 + seen[f])) for f in sorted(seen))
        return 1 / (1 + np.exp(-np.clip(z - self.theta, -40, 40)))


def _thetas(p: np.ndarray) -> np.ndarray:
    """Thresholds from a first one and the logarithms of the steps, so that they stay ordered."""
    return p[0] + np.concatenate(([0.0], np.cumsum(np.exp(p[1:]))))


def gradient(par: np.ndarray, cells: tuple[np.ndarray, np.ndarray, np.ndarray], grade: np.ndarray, grades: int, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of the grades (with ridge) and its gradient; ``par``: weights, then thresholds as in :func:`_thetas`."""
    rows, cols, vals = cells
    n, k = len(grade), len(par) - grades + 1
    theta = _thetas(par[k:])
    z = np.bincount(rows, par[cols] * vals, n) if len(rows) else np.zeros(n)
    p = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))
    upper, lower = np.concatenate((np.ones((n, 1)), p), 1), np.concatenate((p, np.zeros((n, 1))), 1)
    here = np.maximum(np.take_along_axis(upper - lower, grade[:, None], 1)[:, 0], 1e-9)
    slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), 1)
    d_up, d_low = np.take_along_axis(slope, grade[:, None], 1)[:, 0], np.take_along_axis(slope, grade[:, None] + 1, 1)[:, 0]
    d_score = -(d_up - d_low) / here / n
    d_theta = np.bincount(grade, d_up / here, grades)[1:] / n - np.bincount(grade, d_low / here, grades)[:-1] / n
    grad = np.zeros_like(par)
    grad[:k] = (np.bincount(cols, d_score[rows] * vals, k) if len(rows) else 0) + ridge * par[:k]
    grad[k] = d_theta.sum()
    for s in range(grades - 2):
        grad[k + 1 + s] = d_theta[s + 1 :].sum() * np.exp(par[k + 1 + s])
    return float(-np.log(here).mean() + ridge * (par[:k] ** 2).sum() / 2), grad


def _solve(cells, grade: np.ndarray, grades: int, k: int, rounds: int, rate: float, ridge: float) -> np.ndarray:
    """Adam on all rows from weights of 0 and the thresholds of the grades' shares."""
    beyond = grade[:, None] > np.arange(grades - 1)[None, :]
    first = np.log((1 - beyond.mean(0) + 1e-3) / (beyond.mean(0) + 1e-3))
    par = np.concatenate((np.zeros(k), first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for t in range(1, rounds + 1):
        _, grad = gradient(par, cells, grade, grades, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par = par - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - t / (rounds + 1))
    return par


def grades_of(texts: list[bytes | None], toxic: np.ndarray, cells, k: int, rounds: int, rate: float, ridge: float) -> np.ndarray:
    """0 for rows that are not toxic, else 1 to 3 by thirds of the log odds that the other folds' model gives."""
    rows, cols, vals = cells
    fold = np.array([zlib.crc32(t or b"") % FOLDS for t in texts])
    odds = np.zeros(len(texts))
    for f in range(FOLDS):
        at = np.flatnonzero(fold != f)
        if not 0 < toxic[at].sum() < len(at):
            continue
        place = np.full(len(texts), -1)
        place[at] = np.arange(len(at))
        own = place[rows] >= 0
        par = _solve((place[rows[own]], cols[own], vals[own]), toxic[at], 2, k, rounds, rate, ridge)
        odds += np.where(fold == f, np.bincount(rows, par[cols] * vals, len(texts)) - par[k], 0.0)
    cuts = np.quantile(odds[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 0, 0, 1 + np.searchsorted(cuts, odds, side="left")).astype(np.int64)


def fit(texts: list[bytes | None], toxic: np.ndarray, max_features: int = MAX_FEATURES, rounds: int = 400, rate: float = 0.1, ridge: float = 5e-6) -> Ordinal:
    """Chooses the words, grades the rows, fits weights and thresholds by Adam on the whole sample."""
    n = len(texts)
    n1 = int(toxic.sum())
    if not n or n1 in (0, n):
        return Ordinal({}, np.array([40.0 if n1 == 0 else -40.0] * (GRADES - 1)))
    inside, every = Counter(), Counter()
    for text, t in zip(texts, toxic, strict=True):
        found = _count(text).keys()
        every.update(found)
        if t:
            inside.update(found)
    share = n1 / n
    # how far a word's toxic share lies from the overall one, in standard errors
    z = {w: (inside[w] - m * share) / np.sqrt(m * share * (1 - share)) for w, m in every.items() if m >= LEAST_TEXTS}
    chosen = sorted((w for w in z if abs(z[w]) >= LEAST_Z), key=lambda w: (-abs(z[w]), w))[:max_features]
    at = {w: k for k, w in enumerate(chosen)}
    found = [(i, at[w], np.log2(1 + m)) for i, t in enumerate(texts) for w, m in _count(t, at).items()]
    cells = tuple(np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    k = len(chosen)
    grade = grades_of(texts, toxic, cells, k, rounds // 4, rate, ridge)
    par = _solve(cells, grade, GRADES, k, rounds, rate, ridge)
    keep = {x: float(par[i]) for i, x in enumerate(chosen) if abs(par[i]) > 1e-3}
    return Ordinal(keep, _thetas(par[k:]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Ordinal:
    """Fits on at most ``max_rows`` labelled rows, together ``max_bytes`` of text; without toxic labels nothing is ever toxic."""
    few = sample_labels(docs, labels, label, id_col, text_col, max_rows, lambda c: ~held_out(c)).select(F.col("text").cast("binary").alias("text"), "label")
    rows, size = [], 0
    for r in few.toLocalIterator():
        text = bytes(r["text"] or b"")
        if size + len(text) <= max_bytes:
            rows.append((r["label"], text))
            size += len(text)
    rows.sort()
    return fit([t for _, t in rows], np.array([y for y, _ in rows], np.int64))


def grade(docs: DataFrame, model: Ordinal, text_col: str = "text", threshold: float = THRESHOLD, out: str = "toxicity") -> DataFrame:
    """Adds a struct ``out``: ``expected_severity`` (0 to 3), ``grade`` (the likeliest), ``p_toxic``, ``toxic``.

    Null and empty texts have no words and get the base severity; repeated rows alike; an existing column ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def step(texts):
            p = np.array([fitted.above(t) for t in texts]).reshape(len(texts), GRADES - 1)
            each = np.concatenate((np.ones((len(p), 1)), p), 1) - np.concatenate((p, np.zeros((len(p), 1))), 1)
            return [
                pa.array(p.sum(1), pa.float64()),
                pa.array(each.argmax(1).astype(np.int32), pa.int32()),
                pa.array(p[:, 0], pa.float64()),
                pa.array(p[:, 0] >= threshold, pa.bool_()),
            ]

        return step

    schema = "struct<expected_severity:double,grade:int,p_toxic:double,toxic:boolean>"
    return docs.withColumn(out, text_column(make, schema, ["expected_severity", "grade", "p_toxic", "toxic"])(F.col(text_col)))
