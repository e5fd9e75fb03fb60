"""Benchmark decontamination with a generalised suffix automaton.

The items of a benchmark, normalised to words, form one generalised suffix
automaton over word ids.  Each document is streamed through it once; the automaton
state and the current matching length give, at every word, the longest suffix of the
document so far that is a passage of some item.  A matching length of the window size
marks the window's words as hit and names the items that hold it.

Words: A-Z lower-cased, then runs of characters outside ASCII punctuation, space and
control (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``).  A window is ``window`` consecutive words of an
item; an item of fewer words, but not none, is one window.

An automaton is broadcast.  It has at most two states a word, kept in flat arrays; a benchmark of more than ``MAX_WORDS`` words is
cut into slices of whole items, one automaton and one pass each, and their spans and items are merged per document.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, materialise, text_column

WINDOW = 13
#: Words of benchmark in one broadcast automaton.
MAX_WORDS = 1_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, in flat arrays.

    Nearly every state has one transition: its word and target are array cells.  Further ones are in ``more``, under state * 2**32 + word.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, int] = {}
        self._words_of: dict[int, array] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.names: list[str] = []
        self._texts: list[array] = []

    def step(self, state: int, c: int) -> int:
        """The target of a transition, or -1."""
        return self.to[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def _set(self, state: int, c: int, target: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, target
        else:
            key = state << 32 | c
            if key not in self.more:
                self._words_of.setdefault(state, array("i")).append(c)
            self.more[key] = target

    def _state(self, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, c)
        cur, p = self._state(self.len[last] + 1), last
        while p != -1 and self.step(p, c) < 0:
            self._set(p, c, cur)
            p = self.link[p]
        if p == -1:
            self.link[cur] = 0
        else:
            q = self.step(p, c)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        copy = self._state(self.len[p] + 1)
        self.word[copy], self.to[copy], self.link[copy] = self.word[q], self.to[q], self.link[q]
        for w in self._words_of.get(q, ()):
            self._set(copy, w, self.more[q << 32 | w])
        while p != -1 and self.step(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, name: str, text: bytes | None) -> None:
        words = words_of(text)
        if not words:
            return
        last = 0
        self.names.append(name)
        ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for c in ids:
            last = self._extend(last, c)
        self._texts.append(ids)

    def finish(self) -> SuffixAutomaton:
        """Which items hold each window, and where the chain of suffixes meets a short item."""
        window, link, ln = self.window, self.link, self.len
        short: dict[int, tuple[tuple[int, int], ...]] = {}
        #: The item of each window's state, or -1 - k for the k-th of ``shared``, the sets of several items.
        self.item_at = array("i", [-1]) * len(ln)
        several: dict[int, list[int]] = {}
        self.shortest = window
        for k, ids in enumerate(self._texts):
            state = 0
            for length, c in enumerate(ids, 1):
                state = self.step(state, c)
                if length >= window:
                    at = state
                    while ln[link[at]] >= window:
                        at = link[at]
                    if self.item_at[at] < 0:
                        self.item_at[at] = k
                    elif self.item_at[at] != k and several.get(at, (-1,))[-1] != k:
                        several.setdefault(at, [self.item_at[at]]).append(k)
            if len(ids) < window:
                while state and ln[link[state]] >= len(ids):
                    state = link[state]
                short[state] = (*short.get(state, ()), (len(ids), k))
                self.shortest = min(self.shortest, len(ids))
        self.several = {s: tuple(x) for s, x in several.items()}
        n = len(ln)
        #: The state on the suffix chain whose strings include the last ``window`` words, or -1.
        self.at_window = array("i", [-1]) * n
        #: Short items that end where a state ends, the state's own first.
        self.shorts: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in np.argsort(np.frombuffer(ln, np.int32)[1:], kind="stable"):
            s = int(s) + 1
            up = link[s]
            self.at_window[s] = -1 if ln[s] < window else s if ln[up] < window else self.at_window[up]
            if s in short or up in self.shorts:
                self.shorts[s] = short.get(s, ()) + self.shorts.get(up, ())
        self._texts, self._words_of = [], {}
        return self

    def items_of(self, state: int) -> tuple[int, ...]:
        """The items that hold the window of a state."""
        at = self.at_window[state]
        return self.several.get(at) or (self.item_at[at],)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged hit spans [from, to) in words, items whose windows occur."""
        words = words_of(text)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not words or not self.names:
            return len(words), spans, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        window, word, to, more, link, ln, shorts = self.window, self.word, self.to, self.more.get, self.link, self.len, self.shorts

        def hit(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        # a word that no item holds resets the automaton, so runs of known words are independent
        for a, b in known.reshape(-1, 2).tolist():
            if b - a < self.shortest:
                continue
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while True:
                    target = to[state] if word[state] == c else more(state << 32 | c, -1)
                    if target >= 0:
                        state = target
                        length += 1
                        break
                    if not state:
                        break
                    state = link[state]
                    length = ln[state]
                if length >= window:
                    found.update(self.items_of(state))
                    hit(i + 1 - window, i + 1)
                for need, item in shorts.get(state, ()):
                    if need <= length:
                        found.add(item)
                        hit(i + 1 - need, i + 1)
        return len(words), spans, found


def build(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> Iterator[SuffixAutomaton]:
    """The automata of a benchmark table, one after another, each of whole items with ``max_words`` words at most (a longer item has one to itself).

    The driver holds one automaton at a time; items come in partitions of bounded size.
    """
    found, size = SuffixAutomaton(window), 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text")).toLocalIterator():
        text = (r["text"] or "").encode()
        n = len(words_of(text))
        if size and size + n > max_words:
            yield found.finish()
            found, size = SuffixAutomaton(window), 0
        found.add(str(r["name"]), text)
        size += n
    yield found.finish()


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
_FOUND = "struct<n_words:bigint,spans:array<struct<from:bigint,to:bigint>>,items:array<string>>"


def _scanned(automaton) -> Callable:
    """A column function: words, spans and items that one automaton finds."""

    def make():
        machine = automaton.value

        def step(texts):
            rows = [machine.scan(t) for t in texts]
            spans = pa.array([[{"from": a, "to": b} for a, b in r[1]] for r in rows], _SPANS)
            return [pa.array([r[0] for r in rows], pa.int64()), spans, pa.array([sorted({machine.names[k] for k in r[2]}) for r in rows], pa.list_(pa.string()))]

        return step

    return text_column(make, _FOUND, ["n_words", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, out: str = "decontam", max_words: int = MAX_WORDS) -> DataFrame:
    """Adds a struct ``out``: ``n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` are the merged word ranges that :func:`remove_spans` cuts.  ``contaminated``: some word is hit and hit words
    are at least a twentieth of all.  Null and empty texts have no words and are clean; repeated
    rows are judged one by one; items without words (or null) hold no window; item ids count as strings, a repeated one once; an existing column
    named ``out`` is replaced.  An empty benchmark hits nothing.
    """
    spark, found = docs.sparkSession, docs
    columns = docs.columns if out in docs.columns else [*docs.columns, out]
    for k, automaton in enumerate(build(benchmark, item_col, item_text_col, window, max_words)):
        scan = _scanned(spark.sparkContext.broadcast(automaton))(F.col(text_col))
        if not k:
            found = found.withColumn("__found", scan)
            continue
        # one automaton a pass: what has been found is written before the next is sent
        found = materialise(found, f"decontam-{k}").withColumn("__more", scan)
        both = F.struct(F.col("__found.n_words"), F.concat("__found.spans", "__more.spans").alias("spans"), F.array_union("__found.items", "__more.items").alias("items"))
        found = found.withColumn("__found", both).drop("__more")
    # spans in order; those that meet become one
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["from"].alias("from"), F.greatest(last(acc)["to"], s["to"]).alias("to"))))
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    join = lambda acc, s: F.when((F.size(acc) > 0) & (s["from"] <= F.coalesce(F.try_element_at(acc, F.lit(-1))["to"], F.lit(-1))), grown(acc, s)).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate(F.array_sort("__found.spans"), none, join) if k else F.col("__found.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["to"] - s["from"])
    names = F.array_sort("__found.items")
    judged = F.struct(
        F.col("__found.n_words").alias("n_words"), hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("__found.n_words"))).alias("contaminated"), spans.alias("spans"),
    )
    return found.withColumn(out, judged).select(*columns)


def remove_spans(docs: DataFrame, found: str = "decontam", text_col: str = "text", least_words: int = WINDOW, most_cover: float = 0.5, out: str = "cleaned") -> DataFrame:
    """Cuts what :func:`decontaminate` found: adds ``out``, the text without the words of spans of ``least_words`` or more.

    Where hit words make up more than ``most_cover`` of all words the whole text goes and ``out`` is null, as it is for a null text. What
    stands between a cut span's words goes with them; a text without such spans is kept byte for byte.
    """

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, spans, cover in batches:
            rows = zip(byte_texts(texts), spans.to_pylist(), cover.to_pylist(), strict=True)
            yield pa.array([None if t is None or share > most_cover else cut(t, [(s["from"], s["to"]) for s in found or () if s["to"] - s["from"] >= least_words]) for t, found, share in rows], pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    share = F.col(f"{found}.n_hit") / F.greatest(F.col(f"{found}.n_words"), F.lit(1))
    return docs.withColumn(out, F.arrow_udf(run, "string")(F.col(text_col), F.col(f"{found}.spans"), share))


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    if not spans:
        return text.decode()
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]]).decode()
