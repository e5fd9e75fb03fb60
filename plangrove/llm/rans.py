"""Token ids in a binary file: static range asymmetric numeral systems in interleaved blocks.

File format.  A file is a sequence of segments in document order, one row each of a Parquet
container (``part, seq, n_docs, n_tokens, blob``).  A segment's blob holds

* a header (magic, scale, lanes, tokens a block, counts),
* one frequency table that all its blocks share,
* document ids and lengths,
* the block directory: for each block a checkpoint (byte and token offset), CRC-32 of its bytes and CRC-32 of its ids,
* the blocks.

A block is coded by ``lanes`` interleaved states of 64 bits that renormalise by 32-bit words, so it is decoded without
any other block.  A segment closes at ``segment_tokens`` tokens or at the end of its partition, which bounds
a worker's memory whatever the partition's size.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ByteCache, byte_texts, materialise, slices, tidied

MAGIC = b"PGR1"
LANES = 2048
BLOCK_TOKENS = 1 << 19
SEGMENT_TOKENS = 1 << 22
#: Text that is split and numbered at a time.
SLICE_BYTES = 1 << 22
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_HEAD = struct.Struct("<4sIIIQQIIII")


def frequencies(counts: np.ndarray, scale: int) -> np.ndarray:
    """Counts scaled to sum to 2**scale, at least 1 each; the remainder goes to the most frequent."""
    total, room = int(counts.sum()), 1 << scale
    freq = np.maximum(1, counts.astype(np.float64) * (room / total)).astype(np.int64)
    excess = int(freq.sum()) - room
    order = np.argsort(-freq, kind="stable")
    if excess < 0:
        freq[order[0]] -= excess
    while excess > 0:
        give = np.minimum(freq[order] - 1, -(-freq[order] * excess // int(freq.sum())))
        run = np.minimum(np.cumsum(give), excess)
        give = np.diff(np.concatenate(([0], run)))
        freq[order] -= give
        excess -= int(give.sum())
    return freq.astype(np.uint64)


class Table:
    """A static frequency table over the symbols that occur."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, scale: int):
        self.symbols, self.freq, self.scale = symbols.astype(np.uint32), freq.astype(np.uint64), scale
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        scale = max(14, int(len(symbols)).bit_length() + 2)
        return cls(symbols, frequencies(counts[symbols], scale), scale)

    @functools.cached_property
    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))


def encode_block(index: np.ndarray, table: Table, lanes: int) -> bytes:
    """One block of table indexes."""
    n = len(index)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, int(np.argmax(table.freq)), np.int64)
    padded[:n] = index
    padded = padded.reshape(steps, lanes)
    scale = np.uint64(table.scale)
    bound = (_LOW >> scale) << _WORD
    x = np.full(lanes, _LOW, np.uint64)
    words = []
    freq, start = table.freq, table.start
    for t in range(steps - 1, -1, -1):
        f, c = freq[padded[t]], start[padded[t]]
        full = x >= bound * f
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << scale) + (x - q * f) + c
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return x.astype("<u8").tobytes() + stream.astype("<u4").tobytes()


def decode_block(data: bytes, n: int, table: Table, lanes: int) -> np.ndarray:
    """The table indexes of one block of ``n`` tokens."""
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    x = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", -1, 8 * lanes).astype(np.uint64)
    out = np.empty((steps, lanes), np.int32)
    scale, mask = np.uint64(table.scale), np.uint64((1 << table.scale) - 1)
    freq, start, slots, at = table.freq, table.start, table.slots, 0
    for t in range(steps):
        low = x & mask
        s = slots[low.astype(np.int64)]
        out[t] = s
        x = freq[s] * (x >> scale) + low - start[s]
        need = np.flatnonzero(x < _LOW)
        k = len(need)
        x[need] = (x[need] << _WORD) | words[at : at + k]
        at += k
    if at != len(words) or not (x == _LOW).all():
        raise ValueError("a block does not end where it should")
    return out.reshape(-1)[:n]


def pack_segment(doc_ids: list, lengths: list[int], ids: np.ndarray, lanes: int = LANES, block_tokens: int = BLOCK_TOKENS) -> bytes:
    """A segment's blob."""
    ids = ids.astype(np.uint32)
    table = Table.of(ids) if len(ids) else Table(np.zeros(0, np.uint32), np.zeros(0, np.uint64), 14)
    where = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    where[table.symbols] = np.arange(len(table.symbols))
    blocks, directory, at = [], [], 0
    for a in range(0, len(ids), block_tokens):
        part = ids[a : a + block_tokens]
        data = encode_block(where[part], table, lanes)
        directory.append(struct.pack("<QQII", at, a, zlib.crc32(data), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(data)
        at += len(data)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    columns = [
        np.diff(table.symbols.astype("<i8"), prepend=0).astype("<u4").tobytes() + table.freq.astype("<u4").tobytes(),
        known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes(),
        b"".join(directory),
    ]
    columns = [zlib.compress(c, 1) for c in columns]
    head = _HEAD.pack(MAGIC, table.scale, lanes, block_tokens, len(doc_ids), len(ids), len(table.symbols), *map(len, columns))
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *columns, *blocks])


def unpack_segment(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, lengths and token ids of a segment, all checksums verified."""
    magic, scale, lanes, block_tokens, n_docs, n_tokens, n_symbols, *sizes = _HEAD.unpack_from(blob)
    if magic != MAGIC or struct.unpack_from("<I", blob, _HEAD.size)[0] != zlib.crc32(blob[: _HEAD.size]):
        raise ValueError("not a segment")
    at, columns = _HEAD.size + 4, []
    for size in sizes:
        columns.append(zlib.decompress(blob[at : at + size]))
        at += size
    deltas, freq = np.frombuffer(columns[0], "<u4").reshape(2, n_symbols)
    table = Table(np.cumsum(deltas.astype(np.int64)), freq, scale)
    known = np.frombuffer(columns[1], np.uint8, n_docs)
    doc_ids = np.frombuffer(columns[1], "<i8", n_docs, n_docs)
    lengths = np.frombuffer(columns[1], "<u4", n_docs, 9 * n_docs).astype(np.int64)
    ids = np.empty(n_tokens, np.uint32)
    entries = list(struct.iter_unpack("<QQII", columns[2]))
    for k, (offset, first, data_crc, ids_crc) in enumerate(entries):
        stop = entries[k + 1][0] if k + 1 < len(entries) else len(blob) - at
        data = blob[at + offset : at + stop]
        n = min(block_tokens, n_tokens - first)
        if zlib.crc32(data) != data_crc:
            raise ValueError(f"block {k} is damaged")
        part = table.symbols[decode_block(data, n, table, lanes)]
        if zlib.crc32(part.astype("<u4").tobytes()) != ids_crc:
            raise ValueError(f"block {k} decodes to other ids")
        ids[first : first + n] = part
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, ids


@functools.lru_cache(2)
def _library(path: str) -> PieceIds:
    """Ids by piece of text, from the tokenizers library; unknown pieces go to it many at a time."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.no_truncation()
    known.no_padding()

    #: A word of its own in any text; splits the ids of many pieces that one call encodes.
    (mark,) = known.encode("0", add_special_tokens=False).ids
    def encode(pieces: list[bytes]) -> list[bytes]:
        plain = [p for p in pieces if b"0" not in p and b"<|" not in p]
        out = {}
        for k in range(0, len(plain), 200):
            some = plain[k : k + 200]
            ids = np.array(known.encode(b" 0 ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == mark)
            if len(cut) != len(some) - 1:
                raise ValueError("the mark between pieces is not a token of its own")
            raw, at = ids.tobytes(), 0
            for p, b in zip(some, [*(4 * cut).tolist(), 4 * len(ids)], strict=True):
                out[p] = raw[at:b]
                at = b + 4
        apart = [p for p in pieces if p not in out]
        for p, x in zip(apart, known.encode_batch_fast([p.decode() for p in apart], add_special_tokens=False), strict=True):
            out[p] = np.array(x.ids, "<u4").tobytes()
        return [out[p] for p in pieces]

    return PieceIds(encode)


class PieceIds:
    """Ids of white-space-free pieces as bytes, remembered within a number of bytes."""

    def __init__(self, encode):
        self.encode, self.known = encode, ByteCache()

    def of(self, distinct: list[bytes]) -> list[bytes]:
        codes = list(map(self.known.get, distinct))
        ask = [k for k, c in enumerate(codes) if c is None]
        for k, c in zip(ask, self.encode([distinct[k] for k in ask]), strict=True):
            codes[k] = c
            self.known.put(distinct[k], c, len(c))
        return codes


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARKS = np.array([chr(c) in ".,#$%&*!|" for c in range(256)])


def _apart(texts: pa.Array) -> pa.Array:
    """The texts in lower case (A-Z), with a space between a letter and a mark behind it: a tokenizer splits there anyway.

    A text with a special token's mark stays as it is.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    lower = _LOWER[data]
    cut = np.flatnonzero(_MARKS[lower[1:]] & _LETTER[lower[:-1]]) + 1
    moved = offsets - offsets[0]
    moved = moved + np.searchsorted(cut, moved, side="left")
    # a cut at a text's very start belongs to the text before: it would be a space at its end
    spaced = np.insert(lower, cut, 32)
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(spaced))
    special = pc.match_substring(texts, "<|")
    return pc.if_else(special, texts, out) if pc.any(special).as_py() else out


def _coded(cache, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, each with the end id, and their numbers.

    Arrow splits the texts and numbers their distinct pieces; only those are looked up, all else is indexing.
    """
    lists = pc.ascii_split_whitespace(_apart(texts))
    numbered = lists.flatten().dictionary_encode()
    codes = cache.of(byte_texts(numbered.dictionary))
    flat, sizes = np.frombuffer(b"".join(codes), "<u4"), np.array([len(c) >> 2 for c in codes], np.int64)
    starts = np.cumsum(sizes) - sizes
    index = numbered.indices.to_numpy(zero_copy_only=False)
    n = sizes[index]
    ends = np.concatenate(([0], np.cumsum(n)))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    per_text = np.diff(ends[bounds - bounds[0]])
    at = np.arange(ends[-1])
    ids = np.full(len(at) + len(texts), end_id, np.uint32)
    ids[at + np.repeat(np.arange(len(texts)), per_text)] = flat[np.repeat(starts[index] - ends[:-1], n) + at]
    return ids, per_text + 1


def _encode(path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part, seq = _library(path), TaskContext.get().partitionId(), 0
        docs, lengths, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            ids = np.concatenate(held)
            row = [[part], [seq], [len(docs)], [len(ids)], [pack_segment(docs, lengths, ids)]]
            seq, size = seq + 1, 0
            docs.clear(), lengths.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            at, doc_ids = 0, batch.column(0).to_pylist()
            for piece in slices(batch.column(1), SLICE_BYTES):
                coded, n = _coded(cache, piece, end_id)
                docs += doc_ids[at : at + len(piece)]
                lengths += n.tolist()
                at += len(piece)
                size += len(coded)
                held.append(coded)
                if size >= segment_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Encodes every whole text, writes the segment file in ascending id order to the shared folder, returns it as a DataFrame.

    A null text is empty (the end id alone); a null id comes first; rows that repeat an id are ordered by their
    text's hash.  An empty table gives a file without segments.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    coded = ordered.mapInArrow(tidied(_encode(path, end_id, segment_tokens)), "part int, seq int, n_docs long, n_tokens long, blob binary")
    return materialise(coded, "rans-file")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            doc_ids, lengths, ids = unpack_segment(blob)
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def read_digests(segments: DataFrame) -> DataFrame:
    """Decodes a segment file: ``doc_id, start, n_tokens, ids_crc32`` per document."""
    # a running total over partitions (few rows), then one inside each
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before("part")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n_tokens").over(before("part", "seq")), F.lit(0))
    base = sizes.withColumn("inside", inside).join(parts, "part").select("part", "seq", (F.col("first") + F.col("inside")).alias("base"))
    docs = segments.select("part", "seq", "blob").mapInArrow(tidied(_decode), "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(segments: DataFrame) -> DataFrame:
    """Decodes a segment file to ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                doc_ids, lengths, ids = unpack_segment(blob)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return segments.select("blob").mapInArrow(tidied(run), "doc_id long, ids array<int>")
