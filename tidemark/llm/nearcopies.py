"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Two texts are near-duplicates when the probability Jaccard similarity of their five-word shingles, each
weighted by its count, is at least ``threshold``. Every text gets ``REGISTERS`` registers: each shingle
is a Poisson process with its weight as rate, every arrival falls into a random register, and a register
keeps the shingle that arrives first. Arrivals stop as soon as none can be earlier than what all registers
of the text already hold. Two texts agree in a register with a probability equal to their similarity.

Equal texts are merged first, so a group of copies costs one signature's worth of rows however large it
is. Registers are grouped into bands; texts that agree in a band share a bucket. In a bucket all texts are
compared with its leader, and the links give first classes. Then texts outside a bucket's largest class are
compared with all texts of the bucket that are in other classes. So a bucket of near-copies costs about one
comparison a text, no candidate is left out, and no pair but a link is ever a row. Comparisons are exact. They
are dealt out in chunks and blocks of bounded size, so a large bucket is split over many tasks.

Texts with fewer than five words are one shingle; a text without words (or null) is a class of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.text import SPACE, as_bytes, mix, run_hashes, runs, text_blocks

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
CHUNK = 64
HOT_SHARE, HOT_ROWS = 2000, 500
BLOCK_TEXTS, BLOCK_BYTES = 256, 4 << 20  # of a bucket that one task holds
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def node_of(text: str) -> Column:
    """Identity of a text: 16 bytes, null if it has no word."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct word shingles of each text."""
    starts, ends, owner = runs(~SPACE[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = run_hashes(data, starts, ends)
    per_text = np.bincount(owner, minlength=len(offsets) - 1)
    first = np.cumsum(per_text) - per_text
    short = (per_text > 0) & (per_text < size)
    hashes = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        hashes = mix(hashes * _GOLD + words[i: i + len(hashes)])
    inside = owner[: len(hashes)] == owner[size - 1:] if len(hashes) else np.zeros(0, bool)
    texts, values = owner[: len(hashes)][inside], hashes[inside]
    few = np.flatnonzero(short)
    whole = np.zeros(len(few), np.uint64)
    for i in range(size - 1):
        longer = per_text[few] > i
        whole[longer] = mix(whole[longer] * _GOLD + words[first[few[longer]] + i])
    texts, values = np.concatenate((texts, few)), np.concatenate((values, whole))
    # The hash mixed with the text number is unique to the pair, so one sort finds the counts.
    _, at, counts = np.unique(mix(values ^ mix(texts.astype(np.uint64))), return_index=True, return_counts=True)
    return texts[at], values[at], counts


def signatures(texts: np.ndarray, values: np.ndarray, weights: np.ndarray, count: int,
               registers: int = REGISTERS) -> np.ndarray:
    """(text, register): hash of the first shingle to arrive; zero for a text without shingles."""
    best = np.full(count * registers, np.inf)
    holder = np.zeros(count * registers, np.uint64)
    time, drawn = np.zeros(len(values)), np.zeros(len(values), np.uint64)
    alive = np.arange(len(values))
    # Enough arrivals a shingle in the first round to fill most registers, one in each later round.
    needed = registers * np.log(registers) * 1.3
    rounds = np.clip(np.ceil(needed / np.maximum(1, np.bincount(texts, minlength=count))), 1, needed).astype(np.int64)
    repeat = rounds[texts]
    while len(alive):
        element = np.repeat(alive, repeat)
        turn = np.arange(len(element)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        seed = mix(values[element] + (drawn[element] + turn.astype(np.uint64) + np.uint64(1)) * _GOLD)
        register = (seed & np.uint64(0xFFFF)).astype(np.int64) * registers >> 16
        wait = -np.log(((seed >> np.uint64(16)).astype(np.float64) + 0.5) / float(1 << 48)) / weights[element]
        waited = np.cumsum(wait)
        last = np.cumsum(repeat) - 1
        before = np.concatenate(([0.0], waited[last[:-1]]))
        arrival = time[element] + waited - np.repeat(before, repeat)
        cell = texts[element] * registers + register
        early = arrival < best[cell]
        cell, arrival, element = cell[early], arrival[early], element[early]
        np.minimum.at(best, cell, arrival)
        won = arrival == best[cell]
        holder[cell[won]] = values[element[won]]
        time[alive] += waited[last] - before
        drawn[alive] += repeat.astype(np.uint64)
        latest = best.reshape(count, registers).max(axis=1)
        alive = alive[time[alive] < latest[texts[alive]]]
        repeat = np.ones(len(alive), np.int64)
    return holder.reshape(count, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(text, band): hash of the band's registers and its number."""
    parts = signature.reshape(len(signature), bands, -1)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        out = mix(out * _GOLD + parts[:, :, i])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, given as sorted hashes and weights."""
    common, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][at].astype(float), b[1][bt].astype(float)
    if (x == x[0]).all() and (y == x[0]).all() and len(a[0]) == a[1].sum() / x[0] and len(b[0]) == b[1].sum() / x[0]:
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    # sum over j of max(x_j / x_i, y_j / y_i): x counts where its share of the ratio is the larger one.
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = np.searchsorted(ratio, ratio, "left")
    x_after = np.concatenate((np.cumsum(x[::-1])[::-1], [0.0]))[above] + only_a
    y_before = np.concatenate(([0.0], np.cumsum(y)))[above] + only_b
    return float((1 / (x_after / x + y_before / y)).sum())


def _band_rows(frame: DataFrame) -> DataFrame:
    """(node, bucket) from (node, text), a row per band."""
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch, "text"):
                found = signatures(*shingles(*as_bytes(texts)), len(texts))
                keys = band_hashes(found).view(np.int64)
                nodes = batch.column(0).slice(first, end - first).take(pa.array(np.repeat(np.arange(end - first), BANDS)))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(keys.reshape(-1))], names=["node", "bucket"])

    return frame.select("node", "text").mapInArrow(bands, "node binary, bucket long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (leader, node) whose texts are near-duplicates."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(sizes, "leader").select(
        "leader", "node", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    leaders = sizes.select(F.col("leader"), F.col("leader").alias("node"),
                           F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = (leaders.withColumn("role", F.lit(0)).unionByName(dealt.withColumn("role", F.lit(1)))
            .join(texts, "node").repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", "role"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, against = None, None
        for batch in batches:
            for first, end, texts in text_blocks(batch, "text"):
                part = batch.slice(first, end - first)
                names, roles = part.column(0).to_pylist(), part.column(1).to_numpy()
                keep = np.zeros(len(texts), bool)
                for i, mine in enumerate(_sets(texts)):
                    if roles[i] == 0:
                        leader, against = names[i], (mine[0].copy(), mine[1].copy())
                    elif names[i] == leader:
                        keep[i] = similarity(against, mine) >= threshold
                yield part.filter(pa.array(keep)).select([0, 2])

    return rows.select("leader", "role", "node", "text").mapInArrow(compare, "leader binary, node binary")


def _hot(keys: DataFrame, column: str, total: int) -> DataFrame:
    """(hot, parts): keys that hold more than a ``HOT_SHARE``-th of the rows, so at most ``HOT_SHARE`` of them, and into
    how many parts they are cut."""
    most = max(HOT_ROWS, total // HOT_SHARE)
    return (keys.groupBy(F.col(column).alias("hot")).count().where(F.col("count") > most)
            .select("hot", F.ceil(F.col("count") / most).cast("int").alias("parts")))


def components(edges: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (leader, node) is connected with.

    Labels spread along the edges and then jump to their own label, so the rounds grow with the
    logarithm of a path's length. ``known`` are labels from earlier edges. The edges of a node with very many
    are dealt out in parts, each of which meets its label; a label that very many nodes share jumps by a broadcast.
    """
    both = edges.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    if known is not None:
        both = both.unionByName(known.select(F.col("label").alias("a"), F.col("node").alias("b")))
    both = both.where("a != b").distinct()
    both = scratch.save(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    total = both.count()
    busy = scratch.save(_hot(both, "a", total), "busy")
    dealt = scratch.save(both.join(F.broadcast(busy), both.a == busy.hot, "left").select(
        "a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "dealt")
    labels = scratch.save(both.groupBy(F.col("b").alias("node")).agg(F.least(F.min("a"), F.col("b")).alias("label")), "labels")
    scratch.drop(both)
    while True:
        told = labels.join(F.broadcast(busy), labels.node == busy.hot, "left").select(
            "node", "label", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        heard = (dealt.join(told, (dealt.a == told.node) & (dealt.part == told.part)).groupBy(F.col("b").alias("node"))
                 .agg(F.min("label").alias("heard")))
        spread = scratch.save(labels.join(heard, "node").select(
            "node", F.least("label", "heard").alias("label"), (F.col("heard") < F.col("label")).alias("moved")), "spread")
        if not spread.where("moved").take(1):
            scratch.drop(dealt, busy, spread)
            return labels
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        common = scratch.save(_hot(spread, "label", total).select(F.col("hot").alias("label")).join(jump, "label"), "common")
        marked = spread.join(F.broadcast(common), "label", "left")
        rest = marked.where("next is null").drop("next").join(jump, "label")
        jumped = scratch.save(marked.where("next is not null").unionByName(rest).select(
            "node", F.least("label", "next").alias("label")), "labels")
        scratch.drop(labels, spread, common)
        labels = jumped


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, node, class_id, class_docs): one row per input row.

    ``class_id`` is the smallest doc_id of the class (null if all are null), ``class_docs`` counts its rows
    and ``node`` identifies the text. Rows whose text has no word have a null node and their own doc_id.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), node_of(text).alias("node"))
    slim = scratch.save(rows.select("doc_id", "node"), "rows")
    bands = scratch.save(_band_rows(rows.where("node is not null")).distinct(), "bands")
    shared = scratch.save(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "shared")
    members = scratch.save(bands.join(shared, "bucket"), "members")
    scratch.drop(bands, shared)
    texts = _texts_of(rows, slim, members, scratch)
    labels = _link(members, texts, threshold, scratch)
    scratch.drop(texts)
    named = slim.join(labels, "node", "left").select(
        "doc_id", "node", F.coalesce("label", "node").alias("label"))
    classes = (named.where("node is not null").groupBy("label")
               .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_docs")))
    classes, named = scratch.save(classes, "classes"), scratch.save(named, "named")
    scratch.drop(labels, slim)
    return named.join(classes, "label", "left").select(
        "doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1).cast("long")).alias("class_docs"))


def _texts_of(rows: DataFrame, slim: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) of each text that shares a bucket; one document of each group of copies is read."""
    # Copies are merged before they are shuffled, so a large group of them is one row of the join.
    chosen = (slim.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
              .join(members.select("node").distinct(), "node", "left_semi"))
    chosen = scratch.save(chosen, "chosen").withColumnRenamed("node", "chosen_node")
    # The same plan at every size: texts are shuffled by their key.
    picked = rows.join(chosen.hint("merge"), (F.col("node") == F.col("chosen_node")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    # Only rows that agree in id and text are left to merge.
    return scratch.save(picked.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _settle(members: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Links (leader, node) between the labels of classes whose texts share a bucket.

    Texts outside a bucket's largest class are compared with all texts of the bucket, two of them once. These
    are dealt out in blocks of bounded size, each with its own task, which the texts outside pass through one by
    one; only links come out. Classes that a block's links have joined are one class from then on, so texts of a
    large group are not compared again and again.
    """
    sized = members.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    per_class = sized.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    buckets = per_class.groupBy("bucket").agg(
        F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes"))
    # In a bucket of two the leader has met the other text already.
    open_buckets = buckets.where("classes > 1 and n > 2").select(
        "bucket", F.col("top.label").alias("largest"),
        F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    still = members.join(scratch.save(open_buckets, "open"), "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    outside = F.col("label") != F.col("largest")
    held = still.select("bucket", own.alias("block"), F.lit(0).alias("role"), "node", "label", outside.alias("outside"))
    passing = still.where(outside).select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node", "label",
        F.lit(True).alias("outside"))
    rows = (held.unionByName(passing).join(texts, "node").select("bucket", "block", "role", "label", "outside", "text")
            .repartition("bucket", "block").sortWithinPartitions("bucket", "block", "role"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, texts_held, block = None, [], None
        for batch in batches:
            for first, end, texts in text_blocks(batch, "text"):
                part = batch.slice(first, end - first)
                buckets, blocks, roles = (part.column(i).to_numpy() for i in range(3))
                labels, outside = part.column(3).to_pylist(), part.column(4).to_pylist()
                sets = _sets(texts)
                found = []
                for i, mine in enumerate(sets):
                    if (buckets[i], blocks[i]) != place:
                        place, texts_held, block = (buckets[i], blocks[i]), [], None
                    if roles[i] == 0:
                        texts_held.append((labels[i], outside[i], mine[0].copy(), mine[1].copy()))
                        continue
                    if not texts_held:  # few long texts: the hash may leave a block without any
                        continue
                    block = _Block(texts_held) if block is None else block
                    found += [(label, labels[i]) for label in block.links(labels[i], mine, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)],
                                                 names=["leader", "node"])

    return rows.mapInArrow(compare, "leader binary, node binary")


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted shingles and their counts of each text."""
    owner, values, weights = shingles(*as_bytes(texts))
    order = np.lexsort((values, owner))
    owner, values, weights = owner[order], values[order], weights[order]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(values[a:b], weights[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class _Block:
    """Texts of a bucket, as (label, outside the largest class, shingles, counts), that others are compared with."""

    def __init__(self, texts: list[tuple]):
        self.texts = texts
        self.labels = np.array([t[0] for t in texts], object)
        self.outside = np.array([t[1] for t in texts])
        self.numbers: dict[bytes, int] = {}  # of the labels
        self.joined: list[int] = []  # the class that a number's class has been joined with, or itself
        self.classes = np.array([self._class_of(t[0]) for t in texts])
        # Shingle, text number and share of the text's weight, sorted by shingle.
        values = np.concatenate([t[2] for t in texts])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owner = np.repeat(np.arange(len(texts)), [len(t[2]) for t in texts])[order]
        self.share = np.concatenate([t[3] / t[3].sum() for t in texts])[order]

    def _class_of(self, label: bytes) -> int:
        number = self.numbers.setdefault(label, len(self.joined))
        if number == len(self.joined):
            self.joined.append(number)
        while self.joined[number] != number:
            number = self.joined[number] = self.joined[self.joined[number]]
        return number

    def links(self, label: bytes, mine: tuple[np.ndarray, np.ndarray], threshold: float) -> list[bytes]:
        """Labels of other classes that a text outside the largest class is linked with, one a class."""
        own, found = self._class_of(label), []
        # Two texts outside the largest class meet in the block of either.
        among = (self.classes != own) & (~self.outside | (self.labels < label).astype(bool))
        for j in self.likely(mine, among, threshold) if among.any() else ():
            other, _, *theirs = self.texts[j]
            # One link to a class is enough; the class is the link's other end.
            if self.classes[j] != own and similarity(tuple(theirs), mine) >= threshold:
                found.append(other)
                self.joined[self.classes[j]] = own
                self.classes[self.classes == self.classes[j]] = own
        return found

    def likely(self, mine: tuple[np.ndarray, np.ndarray], among: np.ndarray, threshold: float) -> np.ndarray:
        """Texts among those marked that may be similar enough.

        The probability Jaccard sums 1 / (sum over j of max(x_j / x_i, y_j / y_i)) over the common shingles i. It is at
        most the share of either text's weight that lies on common shingles. The inner sum is x_j / x_i over the
        shingles of one text only, y_j / y_i over those of the other, and over the common ones at least the larger of
        the two; with that the bound is exact where the counts of common shingles agree.
        """
        low, high = np.searchsorted(self.values, mine[0], "left"), np.searchsorted(self.values, mine[0], "right")
        hits = high - low
        entry = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        x = np.repeat(mine[1] / mine[1].sum(), hits)
        marked = among[self.owner[entry]]
        entry, x = entry[marked], x[marked]
        owner, y = self.owner[entry], self.share[entry]
        ours, theirs = np.bincount(owner, x, len(among)), np.bincount(owner, y, len(among))
        near = (np.minimum(ours, theirs) >= threshold - 1e-9)[owner]
        owner, x, y = owner[near], x[near], y[near]
        on_x, on_y = ours[owner], theirs[owner]
        inner = np.maximum(on_x / x, on_y / y) + (1 - on_x) / x + (1 - on_y) / y
        return np.flatnonzero(np.bincount(owner, 1 / inner, len(among)) >= threshold - 1e-9)


def _link(members: DataFrame, texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Classes of the texts that share buckets (node, label); a text without a link may be absent."""
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"))
    pairs = members.join(scratch.save(leaders, "leaders"), "bucket").where("node != leader").select("leader", "node")
    pairs = scratch.save(pairs.distinct(), "pairs")
    first = scratch.save(_verified(pairs, texts, threshold), "links")
    labels = components(first, scratch)
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    named = scratch.save(named, "named")
    more = scratch.save(_settle(named, texts, threshold, scratch).distinct(), "links")
    if more.take(1):
        labels = components(more, scratch, labels)
    scratch.drop(pairs, first, named, more)
    return labels


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; all columns.

    Rows that agree in doc_id and text are copies too, so one of them stays. Texts without a word all stay.
    """
    scratch = Scratch(docs.sparkSession, "first")
    classes = scratch.save(near_classes(docs, doc_id, text, threshold).where("node is not null"), "classes")
    # Of the texts that share the class's smallest id, the smallest text stays.
    stays = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id", "class_docs").agg(
        F.min("node").alias("_node")).select(F.col("class_id").alias("_id"), "_node", "class_docs")
    stays = scratch.save(stays, "stays")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).alias("_doc"), node_of(text).alias("_mine"))
    kept = rows.where("_mine is not null").join(
        stays.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_mine") == F.col("_node")))
    # Only a class of several rows can hold a row twice.
    alone = kept.where("class_docs = 1").select("row")
    merged = kept.where("class_docs > 1").groupBy("_doc", "_mine").agg(F.first("row").alias("row")).select("row")
    out = alone.unionByName(merged).unionByName(rows.where("_mine is null").select("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
