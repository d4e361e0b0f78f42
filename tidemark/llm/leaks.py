"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of n characters leaks into a document if some passage of the document turns into the whole
item with at most k = floor(``error`` * n) edits. Such a passage shares at least n - q + 1 - k q of the
item's q-grams, and all of them lie within k + 1 neighbouring diagonals (position in the text minus
position in the item). So shared q-grams are counted in overlapping bands of 2 (k + 1) diagonals, only
bands that reach the bound are kept, and those are aligned with the item inside the band. The filter
loses nothing: every alignment with at most k edits lies whole in one of the bands.

Characters are lower-cased one by one and every run of whitespace counts as one space. k is lowered for
short items so that the bound stays at least 1; items shorter than q characters are too short to be
evidence and match nothing. Null and empty texts match nothing.

The items are indexed in blocks of ``block_chars`` characters, so what is sent to the executors is bounded;
each block is one pass over the documents without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import text_blocks

Q = 8
ERROR = 0.08
BLOCK_CHARS = 2_000_000
BLOCK_TEXT = 4 << 20
_TABLE_BITS = 20
_ALIGN_AT_ONCE = 1024
_NO_CHAR = 0xFFFFFFFF


def _lower_table() -> np.ndarray:
    """Lower case of each character up to U+24FF whose lower case is one character; whitespace becomes a space."""
    table = np.arange(0x2500, dtype=np.uint32)
    for code in range(len(table)):
        char = chr(code)
        if char.isspace():
            table[code] = 0x20
        elif len(char.lower()) == 1:
            table[code] = ord(char.lower())
    return table


def normalised(texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the place of each in its own text, and the offset of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < len(lower), lower.take(codes, mode="clip"), codes)
    space = codes == 0x20
    first = np.cumsum(lengths) - lengths
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[first[lengths > 0]] = True
    kept = np.cumsum(np.concatenate(([0], keep)))
    offsets = kept[np.concatenate((first, [lengths.sum()]))]
    place = np.flatnonzero(keep)
    return codes[place], place - np.repeat(first, np.diff(offsets)), offsets


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q characters from each position, built from hashes of half as many."""
    if q == 1:
        return codes.astype(np.uint64)
    half = grams(codes, q // 2)
    out = half[: max(0, len(codes) - q + 1)] * np.uint64(0x9E3779B97F4A7C15 + 2 * q)
    out += half[q // 2: q // 2 + len(out)]
    if q % 2:
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += codes[q - 1: q - 1 + len(out)]
    if q == Q:
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass
class ItemIndex:
    """q-grams of a block of items: distinct hashes, and item and place of each occurrence in their order."""

    ids: list
    codes: np.ndarray    # (item, place), filled up with a code that no text has
    lengths: np.ndarray
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    first: np.ndarray    # first occurrence of each hash, and one more
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray  # marks the leading hash bits that occur
    lower: np.ndarray


def index_items(items: list[tuple[object, str | None]], q: int = Q, error: float = ERROR) -> ItemIndex:
    lower = _lower_table()
    ids, codes, edits = [], [], []
    for name, text in items:
        chars = normalised([(text or "").strip()], lower)[0]
        if len(chars) >= q:
            ids.append(name)
            codes.append(chars)
            edits.append(min(int(error * len(chars)), (len(chars) - q) // q))
    lengths = np.array([len(c) for c in codes], np.int64)
    edits = np.array(edits, np.int64)
    filled = np.full((len(codes), lengths.max(initial=0)), _NO_CHAR, np.uint32)
    for row, chars in zip(filled, codes, strict=True):
        row[: len(chars)] = chars
    made = [grams(c, q) for c in codes]
    hashes = np.concatenate([np.zeros(0, np.uint64), *made])
    order = np.argsort(hashes, kind="stable")
    item = np.repeat(np.arange(len(codes)), [len(m) for m in made])[order]
    place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(m)) for m in made]])[order]
    distinct = np.unique(hashes)
    first = np.append(np.searchsorted(hashes[order], distinct), len(hashes))
    table = np.zeros(1 << _TABLE_BITS, bool)
    table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
    return ItemIndex(ids, filled, lengths, edits, lengths - q + 1 - q * edits, distinct, first, item, place, table, lower)


def find_leaks(texts: list[str], index: ItemIndex, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best passage of each item in each text, in places of the given text."""
    codes, place, offsets = normalised(texts, index.lower)
    hashes = grams(codes, q)
    at = np.flatnonzero(index.table[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
    if not len(at):
        return []
    which = np.minimum(np.searchsorted(index.hashes, hashes[at]), len(index.hashes) - 1)
    owner = np.searchsorted(offsets, at, "right") - 1
    good = (index.hashes[which] == hashes[at]) & (at + q <= offsets[owner + 1])  # no q-gram across two texts
    at, which, owner = at[good], which[good], owner[good]
    count = index.first[which + 1] - index.first[which]
    entry = np.repeat(index.first[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
    at, owner, item = np.repeat(at, count), np.repeat(owner, count), index.item[entry]
    # Diagonals start at the text, less the longest item and one band, so band numbers are never negative.
    shift = 2 * index.codes.shape[1] + 2
    diagonal = at - offsets[owner] - index.place[entry] + shift
    band = diagonal // (index.edits[item] + 1)
    bands = int(band.max(initial=0)) + 1
    key = (owner * len(index.ids) + item) * bands + band
    key = np.sort(np.concatenate((key, key - 1)))
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    hits, key = np.diff(np.append(starts, len(key))), key[starts]
    item = key // bands % len(index.ids)
    enough = hits >= index.needed[item]
    key, item = key[enough], item[enough]
    owner, width = key // bands // len(index.ids), index.edits[item] + 1
    begin = offsets[owner] + key % bands * width - shift
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for part in range(0, len(key), _ALIGN_AT_ONCE):
        some = slice(part, part + _ALIGN_AT_ONCE)
        aligned = align(codes, begin[some], 2 * width[some], offsets[owner[some]], offsets[owner[some] + 1],
                        index.codes[item[some]], index.lengths[item[some]])
        for text, number, (edits, start, end) in zip(owner[some].tolist(), item[some].tolist(), aligned, strict=True):
            if edits <= index.edits[number]:
                best[text, number] = min(best.get((text, number), (edits, start, end)), (edits, start, end))
    return [(text, number, int(place[start]), int(place[end - 1]) + 1, edits)
            for (text, number), (edits, start, end) in sorted(best.items())]


def align(codes: np.ndarray, begin: np.ndarray, widths: np.ndarray, first: np.ndarray, last: np.ndarray,
          items: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Fewest edits, start and end of each item in its region, along ``widths`` diagonals from ``begin``.

    Row i of a band holds the cost of the item's first i characters ending at each diagonal. A step to the
    right inside a row is a running minimum, so a row of all regions is a few array operations.
    """
    rows = np.arange(len(begin))
    longest = int(lengths.max())
    span = np.arange(int(widths.max()))
    far = longest + len(span)
    first, last = first[:, None], last[:, None]
    position = begin[:, None] + span  # text place behind which row 0 of the diagonal stands
    valid = (position >= first) & (position <= last) & (span < widths[:, None])
    cost = np.where(valid, 0, far)
    start = position.copy()
    out = np.zeros((3, len(begin)), np.int64)
    for i in range(longest):
        here = position + i  # the text character this diagonal reads
        inside = (here >= first) & (here < last)
        same = codes.take(here, mode="clip") == items[:, i: i + 1]
        through = np.where(inside, cost + ~same, far)
        # Leaving out an item character moves one diagonal down.
        skip = np.full_like(cost, far)
        skip[:, :-1] = cost[:, 1:] + 1
        nearer = skip < through
        cost = np.where(nearer, skip, through)
        start[:, :-1] = np.where(nearer[:, :-1], start[:, 1:], start[:, :-1])
        # An extra text character moves one diagonal up, as often as it pays.
        level = cost - span
        lowest = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == lowest, span, 0), axis=1)
        start = start[rows[:, None], source]
        cost = np.where((here + 1 >= first) & (here + 1 <= last) & (span < widths[:, None]), lowest + span, far)
        for j in np.flatnonzero(lengths == i + 1):
            low = int(cost[j].argmin())
            out[:, j] = cost[j, low], start[j, low], position[j, low] + i + 1
    return list(zip(*out.tolist(), strict=True))


def mark_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               keep: list[str] | None = None, error: float = ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The kept columns (all by default) and ``leaks``: array of (item_id, start, end, edits) sorted by item.

    ``start`` and ``end`` (exclusive) are code points of the text. A column named ``leaks`` is replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "leaks"]
    kind = items.schema[item_id].dataType.simpleString()
    leak = f"array<struct<item_id:{kind},start:long,end:long,edits:long>>"
    out = docs.select(*names, F.col(text).alias("__text"), F.array().cast(leak).alias("leaks"))
    for block in _blocks(items.select(item_id, item_text), error, block_chars):
        out = _scan(out, block)
    return out.drop("__text").withColumn("leaks", F.sort_array("leaks"))


def _scan(frame: DataFrame, index: ItemIndex) -> DataFrame:
    context = frame.sparkSession.sparkContext
    sent = context.broadcast(index)
    schema = frame.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            leaks = batch.column(batch.num_columns - 1)
            for first, end, texts in text_blocks(batch, "__text", BLOCK_TEXT, 4096):
                found = leaks.slice(first, end - first).to_pylist()
                for number, item, start, stop, edits in find_leaks(texts.to_pylist(), known):
                    found[number].append({"item_id": known.ids[item], "start": start, "end": stop, "edits": edits})
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(part.num_columns - 1)), pa.array(found, leaks.type)],
                    names=part.schema.names)

    return frame.mapInArrow(scan, schema)


def _blocks(items: DataFrame, error: float, block_chars: int) -> Iterator[ItemIndex]:
    block, chars = [], 0
    for name, text in items.dropDuplicates().toLocalIterator():
        if block and chars + len(text or "") > block_chars:
            yield index_items(block, error=error)
            block, chars = [], 0
        block.append((name, text))
        chars += len(text or "")
    if block:
        yield index_items(block, error=error)
