"""Masked pseudo-likelihood by a bidirectional window network.

The network predicts every token from the token on its left and the one on its right: the two position-specific embeddings are summed,
passed through tanh, and a softmax over the vocabulary follows.  A document's score is the sum of the conditional log
probabilities of all of its tokens (its pseudo-log-likelihood).

Tokens are words (decontamination's normalisation).  The softmax is factored: the most frequent words of the whole corpus each
have a class, all others share ``BUCKETS`` classes by CRC-32, one class is the text's boundary; the network predicts classes from
classes.  Within a shared class, a word that the corpus holds ``LEAST_COUNT`` times or more has its share of the class's tokens; the
other words have the rest of the class together, dealt by a byte bigram model of the spelling of the corpus's rare words.  So every
word is predicted, and the vocabulary grows with the corpus.

Word counts and training cover every word of every document.  Classes are few, so all windows of the corpus are a table of at most
``VOCAB`` cubed counts of (left, right, centre); each task counts its own in numpy, the counts are added up, and one task trains one network on that table, equal contexts taken together,
in a fixed order.  The model therefore does not depend on how the corpus is cut into files or tasks, and its training takes the same time at every size.  The network
is of fixed size; the vocabulary stays a table.  Its ``KNOWN_WORDS`` most frequent words are known to every worker, for speed
only: occurrences of all others are joined with the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, byte_texts, materialise, slices, text_column, tidied
from .decontam import words_of

VOCAB = 256
BUCKETS = 64
HIDDEN = 32
#: Tokens whose windows a task counts at a time.
CHUNK_TOKENS = 1 << 22
#: Steps of training, and contexts of a step.
STEPS = 1500
BATCH = 512
#: Distinct words that a task holds before it reports them.
HELD_WORDS = 300_000
#: Occurrences in the corpus that give a word a probability of its own.
LEAST_COUNT = 2
#: Words that every worker knows; the results do not depend on it.
KNOWN_WORDS = 1 << 17
#: Log probabilities are added up as whole numbers of this unit, so that sums do not depend on order.
UNIT = 2.0**-24


class Ids(dict):
    """Word to id; words outside the vocabulary go to a bucket, remembered within a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__({w: k + 1 for k, w in enumerate(words)})
        self.base, self.room = len(words) + 1, 400_000

    def __missing__(self, w: bytes) -> int:
        k = self.base + zlib.crc32(w) % BUCKETS
        if self.room:
            self.room -= 1
            self[w] = k
        return k

    def of(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


@dataclass
class Network:
    left: np.ndarray
    right: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, vocab: int = VOCAB, hidden: int = HIDDEN) -> Network:
        r = np.random.default_rng(5)
        draw = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        return cls(draw(vocab, hidden), draw(vocab, hidden), np.zeros(hidden, np.float32), draw(vocab, hidden), np.zeros(vocab, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.left, self.right, self.hidden, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, vocab: int = VOCAB, hidden: int = HIDDEN) -> Network:
        shapes, at, parts = [(vocab, hidden), (vocab, hidden), (hidden,), (vocab, hidden), (vocab,)], 0, []
        for s in shapes:
            parts.append(flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32))
            at += int(np.prod(s))
        return cls(*parts)

    def log_probs(self, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(self.left[l] + self.right[r] + self.hidden)
        z = h @ self.out.T + self.bias
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return h, z


def loss_gradient(net: Network, l: np.ndarray, r: np.ndarray, seen: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean weighted cross entropy of the centres ``seen`` (counts by context and class) and its gradient.

    A context counts by the root of its windows, so that one batch is not one context.
    """
    total = seen.sum(1, keepdims=True)
    weight = 1 / np.sqrt(np.maximum(total, 1))
    scale = max(1.0, float((seen * weight).sum()))
    h, z = net.log_probs(l, r)
    g = (np.exp(z) * (total * weight) - seen * weight) / scale
    dh = (g @ net.out) * (1 - h * h)
    grads = [np.zeros_like(net.left), np.zeros_like(net.right), dh.sum(0), g.T @ h, g.sum(0)]
    np.add.at(grads[0], l, dh)
    np.add.at(grads[1], r, dh)
    return -float((seen * weight * z).sum()) / scale, grads


def fit(counts: np.ndarray, steps: int = STEPS, rate: float = 0.01) -> Network:
    """Adam on the table of counts (contexts as left * vocabulary + right, by centres); contexts without windows are left out. Without any: the start network."""
    vocab = counts.shape[1]
    net = Network.start(vocab)
    contexts = np.flatnonzero(counts.any(1))
    if not len(contexts):
        return net
    random = np.random.default_rng(len(contexts))
    m, v = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if not len(order):
            order = random.permutation(contexts)
        c, order = order[:BATCH], order[BATCH:]
        _, grads = loss_gradient(net, c // vocab, c % vocab, counts[c])
        now = rate * (1 - (t - 1) / steps)
        for p, a, b, d in zip(net.parts(), m, v, grads, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return net


def windows(ids: np.ndarray, vocab: int) -> np.ndarray:
    """left * vocab + right of every token; a text's edges see the boundary id 0."""
    around = np.concatenate(([0], ids, [0]))
    return around[:-2] * vocab + around[2:]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def report() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for piece in slices(batch.column(0)):
            for t in byte_texts(piece):
                held.update(words_of(t))
            if len(held) > HELD_WORDS:
                yield report()
                held.clear()
    if held:
        yield report()


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring bytes of distinct words, as first * 256 + second; byte 0 is in no word and stands for its ends."""
    seen = np.zeros(1 << 16, np.int64)
    for batch in batches:
        text = np.frombuffer(b"\0" + b"\0".join(batch.column(0).to_pylist()) + b"\0", np.uint8).astype(np.int64)
        seen += np.bincount(text[:-1] * 256 + text[1:], minlength=1 << 16)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["pair", "n"])


@dataclass
class Within:
    """Log probabilities of words within their shared class."""

    #: Sorted hashes of the words that every worker knows, and their log probabilities.
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Logarithm of each class's share of the words without a probability of their own.
    rest: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    #: Log probability of a byte after a byte.
    spell: np.ndarray = field(default_factory=lambda: np.full(1 << 16, -np.log(256)))

    def solve(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its hash, its log probability if every worker knows it (else NaN), and that without one of its own."""
        keys = np.frombuffer(b"".join([hashlib.md5(w).digest()[:8] for w in words]), ">u8").astype(np.uint64)
        own = np.full(len(words), np.nan)
        if len(self.keys):
            at = np.minimum(self.keys.searchsorted(keys), len(self.keys) - 1)
            own = np.where(self.keys[at] == keys, self.own[at], np.nan)
        spelled = np.zeros(len(words))
        if words:
            text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8).astype(np.int64)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            spelled = np.add.reduceat(self.spell[text[:-1] * 256 + text[1:]], np.cumsum(size) - size)
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS
            # CRC-32 spreads spellings evenly over the classes: that of a given class is so many times as likely within it
            spelled = self.rest[bucket] + np.minimum(0.0, spelled + np.log(BUCKETS))
        return keys, own, spelled

    def known(self, w: bytes) -> float:
        """The log probability of a word that every worker knows, else NaN."""
        return float(self.solve([w])[1][0])

    def spelled(self, w: bytes) -> float:
        """That of a word without a probability of its own."""
        return float(self.solve([w])[2][0])


class Words(dict):
    """Word to row of ``classes, own, keys, spelled``; new words are solved together by :meth:`settle`.

    ``top`` have classes of their own. :meth:`trim` forgets the other words once they hold ``CACHE_BYTES``.
    """

    def __init__(self, top: list[bytes], within: Within):
        super().__init__()
        self.top, self.within = top, within
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update({w: k for k, w in enumerate(self.top)})
        n = len(self.top)
        self.fresh: list[bytes] = []
        self.held = 0
        self.classes, self.own = np.arange(1, n + 1), np.zeros(n)
        self.keys, self.spelled = np.zeros(n, np.uint64), np.zeros(n)

    def __missing__(self, w: bytes) -> int:
        self[w] = k = len(self)
        self.fresh.append(w)
        return k

    def settle(self) -> None:
        if not self.fresh:
            return
        self.held += sum(map(len, self.fresh)) + 200 * len(self.fresh)
        bucket = np.fromiter(map(zlib.crc32, self.fresh), np.int64, len(self.fresh)) % BUCKETS
        keys, own, spelled = self.within.solve(self.fresh)
        self.classes = np.concatenate([self.classes, len(self.top) + 1 + bucket])
        self.own, self.keys = np.concatenate([self.own, own]), np.concatenate([self.keys, keys])
        self.spelled = np.concatenate([self.spelled, spelled])
        self.fresh = []

    def trim(self) -> None:
        if self.held > CACHE_BYTES:
            self.reset()


def _bucket():
    return F.pmod(F.crc32("word"), F.lit(BUCKETS)).cast("int")


def _within(counts: DataFrame, top: list[bytes]) -> tuple[Within, DataFrame]:
    """The factor within shared classes, from the counts of all words (``top`` have classes of their own); ``key, own`` of the vocabulary."""
    shared = counts.where(~F.col("word").isin([F.lit(w) for w in top])) if top else counts
    rare = shared.where(F.col("n") < LEAST_COUNT)
    sums = shared.groupBy(_bucket().alias("bucket")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < LEAST_COUNT, F.col("n")).otherwise(0)).alias("rare")).collect()
    rest, size = np.ones(BUCKETS), np.ones(BUCKETS)  # words that the corpus does not hold count as one
    for r in sums:
        rest[r["bucket"]] += r["rare"]
        size[r["bucket"]] += r["n"]
    pairs = rare.select("word").mapInArrow(tidied(_count_pairs), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    follow = np.ones((256, 256))
    for r in pairs:
        follow[r["pair"] >> 8, r["pair"] & 255] += r["n"]
    log_size = F.array(*(F.lit(float(x)) for x in np.log(size)))
    hashed = F.conv(F.substring(F.md5("word"), 1, 16), 16, -10).cast("long")
    words = shared.where(F.col("n") >= LEAST_COUNT).select("word", "n", hashed.alias("key"), (F.log("n") - F.get(log_size, _bucket())).alias("own"))
    known = words.orderBy(F.desc("n"), "word").limit(KNOWN_WORDS).select("key", "own").toPandas()
    keys = known["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    within = Within(keys[order], known["own"].to_numpy(np.float64)[order], np.log(rest / size), np.log(follow / follow.sum(1, keepdims=True)).ravel())
    return within, words.select("key", "own")


@dataclass
class Model:
    words: list[bytes]
    flat: np.ndarray
    within: Within = field(default_factory=Within)
    #: ``key, own`` of all words of the vocabulary; stays on the driver.
    vocabulary: DataFrame | None = None

    def table(self) -> np.ndarray:
        """Log probability of every token in every context, made once by a worker."""
        net = Network.of(self.flat)
        vocab = len(net.bias)
        out = np.empty((vocab * vocab, vocab), np.float32)
        for l in range(vocab):
            out[l * vocab : (l + 1) * vocab] = net.log_probs(np.full(vocab, l), np.arange(vocab))[1]
        return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Vocabulary, network and the factor within classes from all texts of ``docs`` (null texts add nothing; without words the start network)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(tidied(_count_words), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-words")
    words = [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "word").limit(VOCAB - BUCKETS - 1).collect()]
    within, vocabulary = _within(counts, words)
    shared = spark.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = Ids(shared.value), [], 0

        def report() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([windows(x, VOCAB) * VOCAB + x for x in held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))], ["cell", "n"])

        for batch in batches:
            for piece in slices(batch.column(0)):
                for t in byte_texts(piece):
                    held.append(ids.of(t))
                    size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((VOCAB * VOCAB, VOCAB), np.float32)
        for batch in batches:
            table.ravel()[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        flat = fit(table).flat()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64))], ["i", "w"])

    cells = texts.mapInArrow(tidied(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # one network: at most VOCAB cubed rows of 12 bytes meet in one task, whatever the corpus
    network = materialise(cells, "lm-cells").coalesce(1).mapInArrow(tidied(learn), "i int, w double")
    got = materialise(network, "lm-network").toPandas().sort_values("i")
    return Model(words, got["w"].to_numpy(np.float32), within, vocabulary)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "lm") -> DataFrame:
    """Adds a struct ``out``: ``n_tokens, log_prob`` (summed), ``mean_log_prob``.

    Null and empty texts: no tokens, 0 and null. Repeated rows are scored alike; an existing column ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, vocabulary=None))

    def make():
        fitted = shared.value
        table = getattr(fitted, "_table", None)
        if table is None:
            table = fitted._table = fitted.table()
        known = Words(fitted.words, fitted.within)

        def step(texts):
            rows = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in map(words_of, texts)]
            known.settle()
            n, total, size, left, times = [], [], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in rows:
                x, inner = known.classes[k], known.own[k]
                n.append(len(k))
                total.append(float(table[windows(x, VOCAB), x].sum(dtype=np.float64)) + float(np.nansum(inner)) if len(k) else 0.0)
                w, m = np.unique(k[np.isnan(inner)], return_counts=True)
                left.append(w)
                times.append(m.astype(np.int64))
                size.append(size[-1] + len(w))
            at = np.concatenate(left)
            parts = [pa.array(known.keys[at].view(np.int64)), pa.array(known.spelled[at]), pa.array(np.concatenate(times))]
            known.trim()
            return [pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(parts, ["key", "spelled", "times"]))]

        return step

    first = text_column(make, "struct<n_tokens:bigint,part:double,tail:array<struct<key:bigint,spelled:double,times:bigint>>>", ["n_tokens", "part", "tail"])
    scored = materialise(docs.withColumn(out, first(F.col(text_col))).withColumn("__row", F.monotonically_increasing_id()), "lm-scores")
    tails = scored.select("__row", F.explode(f"{out}.tail").alias("t")).select("__row", "t.*")
    own = F.col("spelled")
    if model.vocabulary is not None:
        tails, own = tails.join(model.vocabulary, "key", "left"), F.coalesce("own", "spelled")
    sums = tails.groupBy("__row").agg(F.sum(F.col("times") * F.round(own / UNIT).cast("long")).alias("__tail"))
    total = F.col(f"{out}.part") + F.coalesce(F.col("__tail") * UNIT, F.lit(0.0))
    n = F.col(f"{out}.n_tokens")
    done = F.struct(n.alias("n_tokens"), total.alias("log_prob"), F.when(n > 0, total / n).alias("mean_log_prob"))
    columns = docs.columns if out in docs.columns else [*docs.columns, out]
    return scored.join(sums, "__row", "left").withColumn(out, done).select(*columns)
