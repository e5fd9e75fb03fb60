"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at a position; the dynamic program keeps, per position, only the best score and
the number of pieces on its path (no back pointers, no token ids).  Tie rules are those of the tokenizers library's unigram model: paths
are tried by rising start position and a later one must be strictly better; where no one-character piece matches, an
unknown character costs the least score minus 10, and falls back to one token for each of its UTF-8 bytes.

The whole text is counted, normalised as the published file says: a space mark goes before it and each space becomes one; line ends,
tabs and other white space stay.  Pieces with other characters hold a space mark at their start only, so no piece crosses the start of a
run of space marks, nor a character that longer pieces do not hold, such as a line end: stretches between are counted independently (and cached).
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, text_column

SPACE = "▁"


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a sentencepiece model in id order, with log probabilities by rank (Zipf's law).

    The published file ranks its pieces but gives them no probabilities; nothing is trained here.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = float(np.log(np.arange(1, len(pieces) + 1) ** -1.0 @ np.ones(len(pieces))))
    return [(p, -float(np.log(k + 1)) - total) for k, p in enumerate(pieces)]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        if any(SPACE in p[1:] and p.strip(SPACE) for p, _ in pieces):
            raise ValueError("a piece goes on after a space mark; words cannot be counted apart")
        self._finder = ahocorasick.Automaton()
        for p, s in pieces:
            self._finder.add_word(p, (len(p), s))
        self._finder.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        #: Positions that the longest piece can reach back over.
        self.ring = max(len(p) for p, _ in pieces) + 1
        inside = {c for p, _ in pieces if len(p) > 1 for c in p}
        apart = "".join(re.escape(c) for c in "\t\n\v\f\r\x85" if c not in inside)
        self.stretches = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.known = ByteCache()

    def pieces(self, text: str) -> int:
        """Tokens of one stretch of text, space marks included.

        Best scores and counts of the last ``ring`` positions are kept, whatever the length; the matches come in order of their ends.
        """
        ring = self.ring
        best, count = [0.0] * ring, [0] * ring
        at, top, n, single = 0, 0.0, 0, True  # the position in work, its best score and count, whether one character matched there
        unknown = self.unknown

        def close() -> None:
            """Settles the position in work: an unmatched character costs the unknown score and its bytes."""
            nonlocal top, n
            if not single:
                before = (at - 1) % ring
                value = best[before] + unknown
                if top is None or value > top:
                    top, n = value, count[before] + len(text[at - 1].encode())
            best[at % ring], count[at % ring] = top, n

        for end, (size, score) in self._finder.iter(text):
            end += 1
            while at < end:
                close()
                at, top, single = at + 1, None, False
            before = (end - size) % ring  # longest first, so starts rise
            if size == 1:
                single = True
            value = best[before] + score
            if top is None or value > top:
                top, n = value, count[before] + 1
        while at < len(text):
            close()
            at, top, single = at + 1, None, False
        close()
        return count[at % ring]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        known, new, total = self.known, self.known.new, 0
        for m in self.stretches.finditer(SPACE + text.replace(" ", SPACE)):
            w = m[0]
            c = new.get(w)
            if c is None:
                c = known.get(w)
                if c is None:
                    c = self.pieces(w)
                known.put(w, c)
                new = known.new
            total += c
        return total


@functools.lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds ``out``: the number of tokens of the whole text (null and empty texts: 0). Repeated rows are counted alike; an existing column ``out`` is replaced."""

    def make():
        counter = _counter(path)
        return lambda texts: [pa.array([counter.count(t or "") for t in texts], pa.int64())]

    return docs.withColumn(out, text_column(make, "struct<n:bigint>", ["n"], as_bytes=False)(F.col(text_col))["n"])
