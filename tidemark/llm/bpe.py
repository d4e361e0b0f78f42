"""Byte-level BPE encoding and decoding by the ranks of a given vocabulary.

A text is split by the vocabulary's pattern. Each piece is looked up in two tiers. A minimal perfect hash
over the vocabulary resolves the pieces that are tokens themselves: a displacement per bucket sends every
vocabulary entry to a slot of its own, so one probe and one comparison of the bytes settle a piece, and
NumPy does that for all pieces of a block at once. The other pieces are merged: their bytes form a
linked list, a heap yields the adjacent pair whose joined bytes have the lowest rank, leftmost first,
until no pair is a token; that takes n log n steps for a piece of n bytes. A task remembers the
merged ids of up to ``CACHE_PIECES`` short pieces.

A null text is the empty text and has no ids; a text of any length is encoded whole. Equal texts have equal
ids. Decoding joins the tokens' bytes; a null array, or a null in it, stands for nothing, and an id outside of
the vocabulary is an error. Columns of the input named like an output column are replaced. A task holds
one block of text (``text_blocks``) with its pieces beside the Arrow batch.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import BLOCK_BYTES, as_bytes, mix, text_blocks

CACHE_PIECES = 500_000
CACHE_BYTES = 64  # longest piece that is remembered
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

# Letters and digits of Unicode 17 and 18. The tiktoken library splits by Unicode 16, which
# does not know them; here they stand for symbols while a text is split.
NEWER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
_SYMBOL = "\uE000"
_NEWER_LEAD = chr(NEWER[0][0]).encode()[0]  # smallest first byte of such a character


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def words_at(padded: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``padded`` ends with eight spare bytes."""
    return np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))


def piece_words(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, number: int) -> np.ndarray:
    """The bytes 8 * number and on of each piece, zero beyond its end."""
    left = np.clip(lengths - 8 * number, 0, 8)
    return words[np.minimum(starts + 8 * number, len(words) - 1)] & _MASK[left]


def piece_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces; a piece of 8 bytes or fewer costs one step."""
    out = mix(piece_words(words, starts, lengths, 0) + _STEP * lengths.astype(np.uint64))
    longer, number = np.flatnonzero(lengths > 8), 1
    while len(longer):
        out[longer] = mix(out[longer] * _STEP ^ piece_words(words, starts[longer], lengths[longer], number))
        number += 1
        longer = longer[lengths[longer] > 8 * number]
    return out


class PerfectHash:
    """A minimal perfect hash: n distinct keys, n slots, one probe.

    Keys fall into about n / 4 buckets. The fullest buckets first, each bucket tries displacements until its
    keys meet free slots only; buckets of one key are then given the slots that are left.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.slots = n
        self.shift = np.zeros(max(1, n // 4), np.int64)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(len(self.shift) + 1))
        sizes = np.diff(starts)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            members = keys[order[starts[b]: starts[b + 1]]]
            if len(members) < 2:
                break
            at = 1
            while True:
                tried = np.arange(at, at + 64)
                slots = self._displaced(members[None, :], tried[:, None])
                fits = free[slots].all(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    pick = int(np.argmax(fits))
                    self.shift[b] = tried[pick]
                    free[slots[pick]] = False
                    break
                at += 64
        # A negative displacement is the slot itself.
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -1 - np.flatnonzero(free)[: len(single)]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(len(self.shift))).astype(np.int64)

    def _displaced(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + _STEP * shift.astype(np.uint64)) % np.uint64(self.slots)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """The only slot where each key can be."""
        shift = self.shift[self._bucket(keys)]
        return np.where(shift < 0, -1 - shift, self._displaced(keys, np.maximum(shift, 0)))


class Merged(dict):
    """Ids of pieces that are no token themselves, as 32-bit numbers, merged when first asked for.

    Two generations of half of ``CACHE_PIECES`` each are kept, so that pieces in use outlive the others.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.older = ranks, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", merge(piece, self.ranks)).tobytes()
        if len(piece) <= CACHE_BYTES:
            if len(self) >= CACHE_PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of the lowest rank, leftmost first, until no pair is a token."""
    n, rank_of = len(piece), ranks.get
    end = list(range(1, n + 1))         # of the part that starts here
    before = list(range(-1, n - 1))     # start of the part before
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := rank_of(piece[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, stop = heapq.heappop(heap)
        right = end[left]
        # Parts that were joined since have another end; 0 marks a start that is none any more.
        if right == 0 or right == n or end[right] != stop:
            continue
        end[left], end[right] = stop, 0
        if stop < n:
            before[stop] = left
            if (rank := rank_of(piece[left: end[stop]])) is not None:
                heapq.heappush(heap, (rank, left, end[stop]))
        start = before[left]
        if start >= 0 and (rank := rank_of(piece[start: stop])) is not None:
            heapq.heappush(heap, (rank, start, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at: end[at]]])
        at = end[at]
    return ids


class Tokenizer:
    """Encoder and decoder for a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        if len(set(ranks.values())) < len(ranks) or min(ranks.values()) < 0:
            raise ValueError("ranks must be distinct and not negative")
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(tokens) + bytes(8), np.uint8)
        words = words_at(data)
        keys = piece_hashes(words, starts, lengths)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two tokens with the same 64-bit hash")
        self.hash = PerfectHash(keys)
        place = np.empty(len(tokens), np.int64)
        place[self.hash.slot(keys)] = np.arange(len(tokens))
        # By slot: id, length and bytes of the token there.
        self.ids = np.array(list(ranks.values()), np.int32)[place]
        self.lengths = lengths[place]
        self.words = [piece_words(words, starts[place], self.lengths, i) for i in range(-(-int(lengths.max()) // 8))]
        # By id: where its bytes are.
        self.data = data
        self.first = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size = np.full(len(self.first), -1, np.int64)
        values = np.array(list(ranks.values()))
        self.first[values], self.size[values] = starts, lengths

    @classmethod
    def load(cls, path: str, pattern: str) -> Tokenizer:
        return cls(read_ranks(path), pattern)

    def whole(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of the pieces that are tokens, -1 for the others."""
        out = np.full(len(starts), -1, np.int32)
        able = np.flatnonzero(lengths <= 8 * len(self.words))
        starts, lengths = starts[able], lengths[able]
        slot = self.hash.slot(piece_hashes(words, starts, lengths))
        same = self.lengths[slot] == lengths
        for number, expected in enumerate(self.words):
            look = np.flatnonzero(same & (lengths > 8 * number))
            if not len(look):
                break
            same[look] = expected[slot[look]] == piece_words(words, starts[look], lengths[look], number)
        out[able[same]] = self.ids[slot[same]]
        return out

    def encode_block(self, texts: list[str], data: np.ndarray, merged: Merged,
                     find) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        if (data >= _NEWER_LEAD).any():
            pieces = [find(_NEWER.sub(_SYMBOL, t)) for t in texts]
        else:
            pieces = [find(t) for t in texts]
        counts = np.array([len(p) for p in pieces], np.int64)
        chars = np.fromiter(map(len, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        del pieces
        if not len(chars):
            return np.zeros(0, np.int32), counts
        # From characters to bytes.
        letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        borders = letters[np.concatenate(([0], np.cumsum(chars)))]
        starts, lengths = borders[:-1], np.diff(borders)
        words = words_at(np.concatenate((data, np.zeros(8, np.uint8))))
        ids = self.whole(words, starts, lengths)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, counts
        raw = data.tobytes()
        parts = [merged[raw[a:b]] for a, b in zip(starts[lost].tolist(), borders[lost + 1].tolist(), strict=True)]
        width = np.ones(len(ids), np.int64)
        width[lost] = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        out = np.repeat(ids, width)
        out[out < 0] = np.frombuffer(b"".join(parts), np.int32)
        return out, np.add.reduceat(np.append(width, 0), np.cumsum(counts) - counts) * (counts > 0)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the end of each id's bytes."""
        inside = (ids >= 0) & (ids < len(self.size))
        if not inside.all() or (self.size[ids] < 0).any():
            raise ValueError("an id outside of the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - (ends - size), size)
        return self.data[places], ends


def _extended(frame: DataFrame, count: int, *more: T.StructField) -> T.StructType:
    return T.StructType([*frame.schema.fields[:count], *more])


def encode_texts(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "ids",
                 keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with the ids of each text as an array."""
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    frame = docs.select(*names, F.col(text).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, merged = regex.compile(tokenizer.pattern).findall, Merged(tokenizer.ranks)
        for batch in batches:
            for first, end, texts in text_blocks(batch.rename_columns([f"c{i}" for i in range(batch.num_columns)]),
                                                 f"c{len(names)}"):
                ids, counts = tokenizer.encode_block(texts.to_pylist(), as_bytes(texts)[0], merged, find)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(ids))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], lists], names=[*names, out])

    return frame.mapInArrow(encode, _extended(frame, len(names), T.StructField(out, T.ArrayType(T.IntegerType()))))


def decode_ids(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "decoded",
               keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with the bytes that the ids stand for."""
    names = [c for c in (encoded.columns if keep is None else keep) if c != out]
    known = F.coalesce(F.array_compact(F.col(ids)), F.array().cast("array<int>"))
    frame = encoded.select(*names, known.alias("__ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                used = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, used + BLOCK_BYTES, "right")))
                part = batch.slice(first, end - first)
                data, stops = tokenizer.decode(part.column(len(names)).flatten().to_numpy(zero_copy_only=False))
                borders = np.concatenate(([0], stops))[np.concatenate(([0], ends[first:end] - used))]
                made = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), end - first, [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], made.cast(pa.binary())], names=[*names, out])
                first = end

    return frame.mapInArrow(decode, _extended(frame, len(names), T.StructField(out, T.BinaryType())))
