"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding.  In a proper merge list (each token has one merge, later than those of its parts; checked when the file is read) a token
sequence is the BPE encoding of its text exactly when every two neighbouring tokens are compatible (merging the
symbols of just those two gives the two back).  So the encoding of each prefix of a word is the encoding of an earlier
prefix plus one token, and the transducer extends the encodings of all prefixes symbol by symbol.

Lookahead.  Apply the merges in order to a prefix and to any continuation of it and watch the last position up to which both have the same
tokens.  It starts at the prefix's end and only moves when a merge (a, b) joins the last common token a with the next token of one of the two:
by the length of a.  From then on the token at that position is a in one and ab in the other, each of which later merges may extend to the right or join to a token on
its left.  :meth:`Bpe._sufficient_lookahead` walks the list from its last merge back and sums the longest such chain.  Tokens that end at
least that many symbols before the end of what has been read are the same in every continuation: they are emitted and forgotten, and nothing
else decides an emission.  Memory per word is that span, however long the word.

Decoding.  :class:`TokenText` is an incremental state machine from ids to text: either the
token strings joined by one space (what a tokenizer without a decoder gives), or bytes
through a UTF-8 machine with word ends turned into spaces.

The tokenizer is given by its published JSON file (NFC, white space, lower case, a split
pattern, byte alphabet, merges with a word-end mark); its path is a parameter.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, text_column

#: The word end as a symbol of its own for the matcher; no stand-in character of a byte.
MARK = "\ue000"
#: Symbols of a word that the transducer reads at a time.
CHUNK = 1024
#: Pieces whose ids are looked up, decoded and hashed at a time.
RUN_PIECES = 1 << 16


@functools.lru_cache(1)
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self._cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._split = regex.compile(split)
        self._stand = byte_alphabet()
        self._stand_in = {b: c for b, c in self._stand.items() if chr(b) != c}
        self.byte_of = {c: b for b, c in self._stand.items()}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.ids)
        self._check_proper(merges)
        self.lookahead = self._sufficient_lookahead(merges)
        self._spines: dict[str, list] = {}
        self._lefts: dict[str, list] = {}
        self._fit_ids: dict[int, bool] = {}
        self._start = len(self.names) + 1
        self.fit_limit = 600_000
        #: What each token was merged from last, and that merge's rank.
        self._made: dict[str, tuple[str, str, int]] = {}
        for k, (x, y) in enumerate(merges):
            self._made.setdefault(x + y, (x, y, k))
        self._finder = ahocorasick.Automaton()
        for t, i in self.ids.items():
            ended = self.end and t.endswith(self.end) and len(t) > len(self.end)
            symbols = t[: -len(self.end)] + MARK if ended else t
            self._finder.add_word(symbols, (i, len(symbols)))
        self._finder.make_automaton()

    def _size(self, token: str) -> int:
        return len(token.removesuffix(self.end)) if self.end and len(token) > len(self.end) else len(token)

    @staticmethod
    def _check_proper(merges: list[tuple[str, str]]) -> None:
        """Refuses a merge list for which encodings are not decided by neighbours in order of rank."""
        made: dict[str, int] = {}
        for k, (x, y) in enumerate(merges):
            if x + y in made:
                raise ValueError(f"two merges make {x + y!r}")
            made[x + y] = k
        if any(made.get(t, -1) > k for k, pair in enumerate(merges) for t in pair):
            raise ValueError("a merge comes before those of its parts")

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols by which the end of the common tokens of a prefix and its continuations can lie before the prefix's end.

        ``reach[t]``: how far the merges still to come can move it while the token t starts there.  Merge (a, b) extends a to ab, or it
        joins b to the last common token a; then a or ab starts at the new place.
        """
        reach: dict[str, int] = {}
        get = reach.get
        for a, b in reversed(merges):
            grown, here = get(a + b, 0), get(a, 0)
            joined = self._size(a) + max(here, grown)
            if grown > here:
                reach[a] = grown
            if joined > get(b, 0):
                reach[b] = joined
        return max(reach.values(), default=0)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the lowest rank first, the leftmost of equals."""
        out, rank = list(symbols), self.rank
        while len(out) > 1:
            best, at = min(((rank.get(p, 1 << 40), k) for k, p in enumerate(zip(out, out[1:], strict=False))))
            if best == 1 << 40:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces of a token along one edge, each with the rank of the merge that consumes it."""
        out, until = [], 1 << 40
        while True:
            out.append((token, until))
            made = self._made.get(token)
            if made is None:
                return out
            until, token = made[2], made[side]

    def fits(self, a: str, b: str) -> bool:
        """Whether the encoding of a followed by b is just those two tokens.

        It is not if some piece on the right edge of a and some piece on the left edge of b merge before
        either is consumed in its own token (of equal ranks the left one goes first).
        """
        rank = self.rank
        right = self._spines.get(a)
        if right is None:
            right = self._spines[a] = self._spine(a, 1)
        left = self._lefts.get(b)
        if left is None:
            left = self._lefts[b] = self._spine(b, 0)
        for x, x_until in right:
            for y, y_until in left:
                k = rank.get((x, y))
                if k is not None and k < x_until and k <= y_until:
                    return False
        return True

    def _read(self, matches, base: int, last: list[int], back: list[int], ended: bool) -> None:
        """The transducer's step: extends the encodings of prefixes by the matches that end in what has been read.

        If the word has ``ended``, the place before its mark lies on no path: every token with the mark covers the last symbol too. Place k holds the last token of the encoding of the symbols up to there and the place where it starts; place 0 is the last final boundary.
        """
        fits, fit, done = self._fit_ids, self._fit, 0
        unused, shift = len(last) - 2 if ended else -1, 1 - base
        for end, (token, size) in matches:
            end += shift
            if end == done or end == unused:  # a match that fits came before (an encoding is unique), or none is needed
                continue
            j = end - size
            if j < 0:  # it would cross a final boundary
                continue
            key = last[j] << 20 | token
            ok = fits.get(key)
            if ok is None:
                ok = fit(key)
            if ok:
                last[end], back[end], done = token, j, end
        if done < len(last) - 1:
            raise ValueError("no token of the vocabulary ends here")

    def transduce(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Token ids of one word, given in chunks of symbols with ``MARK`` at its end; after each chunk those that the lookahead makes final."""
        last, back, base = [self._start], [0], 0
        finder, ended = self._finder.iter(""), False
        for chunk in chunks:
            finder.set(chunk)
            last += [self._start] * len(chunk)
            back += [0] * len(chunk)
            ended, n = chunk.endswith(MARK), len(last) - 1
            self._read(finder, base, last, back, ended)
            out, at = self._path(last, back, n, n if ended else n - self.lookahead)
            if at > 0:
                yield out
                base += at
                last, back = last[at:], [max(0, b - at) for b in back[at:]]
        if not ended:
            raise ValueError("the word has no end")

    @staticmethod
    def _path(last: list[int], back: list[int], at: int, until: int) -> tuple[list[int], int]:
        """The tokens on the path to place ``at`` that end at ``until`` or before, and where the last of them ends."""
        while at > max(until, 0):
            at = back[at]
        end, out = at, []
        while at > 0:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out, end

    def word(self, word: str) -> list[int]:
        """Token ids of one word of plain symbols."""
        word += MARK
        n = len(word)
        if n > CHUNK:
            return [i for x in self.transduce(word[k : k + CHUNK] for k in range(0, n, CHUNK)) for i in x]
        last, back = [self._start] * (n + 1), [0] * (n + 1)
        self._read(self._finder.iter(word), 0, last, back, True)
        return self._path(last, back, n, n)[0]

    def _fit(self, key: int) -> bool:
        """Whether the second token of a pair may follow the first (or begin a word); remembered within a bound."""
        if key in self._fit_ids:
            return self._fit_ids[key]
        if len(self._fit_ids) > self.fit_limit:
            self._fit_ids.clear()
        a, b = key >> 20, self.names[key & 0xFFFFF]
        ok = self._is_own(b) if a == self._start else self.fits(self.names[a], b)
        self._fit_ids[key] = ok
        return ok

    def _is_own(self, token: str) -> bool:
        """Whether the token encodes to itself."""
        return self.merge(self._symbols(token)) == [token]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pre-tokens in stand-in characters; a special token comes as it is, marked True."""
        at = 0
        for m in [*(self._cut_special.finditer(text) if self._cut_special else ()), None]:
            plain = text[at : m.start() if m else len(text)]
            if plain:
                if not plain.isascii():
                    plain = unicodedata.normalize("NFC", plain)
                # character by character, which matters to a final sigma only
                lower = plain.lower() if "\u03a3" not in plain else "".join(map(str.lower, plain))
                for word in self._split.findall(lower):
                    if word:
                        yield word.encode().decode("latin-1").translate(self._stand_in), False
            if m:
                yield m[0], True
                at = m.end()

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        out: list[int] = []
        if text.isascii() and text.isalpha() and text.islower():
            return self.word(text)
        for word, special in self.parts(text):
            if special:
                out.append(self.special[word])
            else:
                out += self.word(word)
        return out


class TokenText:
    """Incremental decoder: feed ids, get text as soon as it is certain.

    ``joined``: token strings with one space between.  Otherwise: the bytes behind the tokens through a
    UTF-8 state machine (a broken sequence becomes U+FFFD), a word end as one space.
    """

    def __init__(self, bpe: Bpe, joined: bool = True):
        self.bpe, self.joined, self.first = bpe, joined, True
        self._utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, *ids: int) -> str:
        """The text that these ids add."""
        names = self.bpe.names
        if self.joined:
            out = " ".join([names[i] for i in ids])
            if ids and not self.first:
                out = " " + out
            self.first = self.first and not ids
            return out
        return "".join([self._bytes_of(names[i]) for i in ids])

    def _bytes_of(self, name: str) -> str:
        if name in self.bpe.special:
            return self._utf8.decode(b"", True) + name
        ended = bool(self.bpe.end) and name.endswith(self.bpe.end) and len(name) > len(self.bpe.end)
        body = name[: -len(self.bpe.end)] if ended else name
        known = self.bpe.byte_of
        return self._utf8.decode(bytes([known[c] for c in body]), ended) + (" " if ended else "")

    def close(self) -> str:
        return "" if self.joined else self._utf8.decode(b"", True)


class ChunkCache:
    """Ids by white-space-free piece of text, bounded by bytes.

    No pre-token crosses ASCII white space, and ASCII case does not matter unless a special token's
    mark occurs, so a text's ids are those of its pieces in order.
    """

    def __init__(self, solve, split):
        self.solve, self.split, self.known = solve, split, ByteCache()

    def words(self, piece: bytes) -> list[bytes]:
        """The words of an ASCII piece without special tokens, each of which is a word by itself too; others are not cut."""
        return [w.encode() for w in self.split(piece.decode())] if piece.isascii() and b"<|" not in piece and not piece.isalpha() else []

    @staticmethod
    def pieces(text: bytes) -> list[bytes]:
        return (text if b"<|" in text else text.lower()).split()

    def fetch(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        got = list(map(self.known.new.get, pieces))
        if None in got:
            for k, x in enumerate(got):
                if x is None:
                    got[k] = self.one(pieces[k])
        return got

    def one(self, piece: bytes) -> tuple[int, ...]:
        found = self.known.get(piece)
        if found is None:
            stem = piece[:-1]
            if piece[-1] in b".," and stem and 97 <= stem[-1] <= 122:
                found = self.one(stem) + self.one(piece[-1:])
            elif len(words := self.words(piece)) > 1:
                found = tuple(chain.from_iterable(map(self.one, words)))
            else:
                found = tuple(self.solve(piece.decode()))
            self.known.put(piece, found, 8 * len(found))
        return found


@functools.lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


@functools.lru_cache(2)
def _cached(path: str) -> ChunkCache:
    return ChunkCache(loaded(path).encode, loaded(path)._split.findall)


def encode_digests(docs: DataFrame, path: str, text_col: str = "text", out: str = "bpe") -> DataFrame:
    """Adds a struct ``out``: ``n_tokens, ids_sha256, decoded_sha256`` of whole texts; the ids go through the incremental decoder.

    A null text counts as empty: no tokens, the digests of nothing.  Repeated rows are encoded one by
    one; an existing column named ``out`` is replaced.
    """

    def make():
        bpe, cache = loaded(path), _cached(path)
        digits = {i: b"%d" % i for i in bpe.names}

        def digests(text: bytes | None) -> tuple[int, str, str]:
            machine, total, ids_sha, text_sha = TokenText(bpe), 0, hashlib.sha256(), hashlib.sha256()
            pieces = cache.pieces(text or b"")
            for k in range(0, len(pieces), RUN_PIECES):
                ids = list(chain.from_iterable(cache.fetch(pieces[k : k + RUN_PIECES])))
                if total and ids:
                    ids_sha.update(b" ")
                total += len(ids)
                ids_sha.update(b" ".join([digits[i] for i in ids]))
                text_sha.update(machine.feed(*ids).encode())
            text_sha.update(machine.close().encode())
            return total, ids_sha.hexdigest(), text_sha.hexdigest()

        def step(texts):
            rows = [digests(t) for t in texts]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

        return step

    schema = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
    return docs.withColumn(out, text_column(make, schema, ["n_tokens", "ids_sha256", "decoded_sha256"])(F.col(text_col)))


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids themselves as array<int> and, if named, the decoded text (null text: no ids, empty text)."""

    def make():
        bpe = loaded(path)

        def step(texts):
            ids = [bpe.encode((t or b"").decode()) for t in texts]
            said = []
            for x in ids:
                machine = TokenText(bpe)
                said.append(machine.feed(*x) + machine.close())
            return [pa.array(ids, pa.list_(pa.int32())), pa.array(said, pa.string())]

        return step

    both = text_column(make, "struct<ids:array<int>,said:string>", ["ids", "said"])(F.col(text_col))
    got = docs.withColumn(out, both)
    return got.withColumns({out: F.col(f"{out}.ids")} | ({decoded: F.col(f"{out}.said")} if decoded else {}))
