"""Ranked lexical search, term at a time with a limited set of accumulators.

The documents become an index over the terms of the queries: a row per document with its length and the
number of occurrences of each query term. Every task scores its part of the index in shards of bounded
size. In a shard a query takes its terms from the rarest to the most frequent; each posting adds to its
document's accumulator and creates it where it is missing. As soon as the largest scores that the
remaining terms can add up to stay below the k-th best score found so far, a document that has no
accumulator yet can no longer enter the result, so none is created any more; the existing ones are still
updated by all remaining terms, which makes their scores exact. The k-th best score counts finished
documents of the task's earlier shards too. A task returns its best k documents of each query, and those
of all tasks are ranked once more, so nothing but k rows per query and task is ever shuffled.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z in lower case. Scores
are 64-bit integers (see ``impacts``). All documents with a term count in the statistics, a null text has
no term. Documents with equal scores rank by ascending id, a null id last; repeated rows are documents of
their own. Query rows with the same id form one query with the terms of all; a query without a term, or
with terms that no document holds, has no rows. Empty tables give no rows. Only the named columns are
read, so others may have any name.

Memory: a task holds one block of text (``text_blocks``, longer texts in pieces of ``PIECE_BYTES``) and in
the second pass one shard of at most ``SHARD_POSTINGS`` postings beside the Arrow batch. The queries
reach the tasks in groups of about ``QUERY_TERMS`` terms, each with an index of its own.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.text import BLOCK_BYTES, as_bytes, run_hashes, runs, text_blocks

# A run of anything but ASCII characters that are neither letters nor digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
QUERY_TERMS = 500_000
SHARD_POSTINGS = 1 << 20
PIECE_BYTES = BLOCK_BYTES
SCALE = 1_000_000_000

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Terms:
    """The distinct terms of a group of queries, ordered by hash, and the queries as term numbers."""

    hashes: np.ndarray
    lengths: np.ndarray
    queries: list[np.ndarray]

    @classmethod
    def of(cls, queries: list[list[str]]) -> Terms:
        words = sorted({w for q in queries for w in q})
        encoded = [w.encode() for w in words]
        lengths = np.array([len(w) for w in encoded], np.int64)
        # One at a time: a hash does not depend on where the term stands.
        hashes = np.array([run_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in encoded],
                          np.uint64)
        order = np.argsort(hashes)
        place = dict(zip([words[i] for i in order], range(len(words)), strict=True))
        return cls(hashes[order], lengths[order], [np.array(sorted(place[w] for w in set(q)), np.int64) for q in queries])


def term_pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, ...]]:
    """(hashes, lengths, text numbers) of the terms, in pieces of about ``size`` bytes cut between terms."""
    at = 0
    while at < len(data):
        end, step = min(at + size, len(data)), 1 << 10
        while end < len(data):
            outside = np.flatnonzero(~_INSIDE[data[end: end + step]])
            if len(outside):
                end += int(outside[0])
                break
            end, step = min(end + step, len(data)), 2 * step
        first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
        borders = np.clip(offsets[first: last + 1], at, end) - at
        piece = _LOWER[data[at:end]]
        starts, ends, owner = runs(_INSIDE[piece], borders)
        yield run_hashes(piece, starts, ends), ends - starts, owner + first
        at = end


def count_terms(terms: Terms, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(terms per text, then text number, term number and occurrences of every query term in a text)."""
    n_texts, n_terms = len(offsets) - 1, len(terms.hashes)
    length = np.zeros(n_texts, np.int64)
    cells, times = [], []
    for hashes, lengths, owner in term_pieces(data, offsets):
        length += np.bincount(owner, minlength=n_texts)
        if n_terms:
            place = np.minimum(np.searchsorted(terms.hashes, hashes), n_terms - 1)
            known = (terms.hashes[place] == hashes) & (terms.lengths[place] == lengths)
            cell, n = np.unique(owner[known] * n_terms + place[known], return_counts=True)
            cells.append(cell)
            times.append(n)
    if not cells:
        none = np.zeros(0, np.int64)
        return length, none, none, none
    # A text cut into pieces has the same term in several of them.
    cell, back = np.unique(np.concatenate(cells), return_inverse=True)
    tf = np.bincount(back, np.concatenate(times), len(cell)).astype(np.int64)
    return length, cell // max(1, n_terms), cell % max(1, n_terms), tf


def build_index(docs: DataFrame, terms: Terms, doc_id: str, text: str) -> DataFrame:
    """doc, n (terms of the text), terms and tfs (query terms held, ascending) of every document with a term."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch, "text"):
                length, owner, term, tf = count_terms(terms, *as_bytes(texts))
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=end - first)))).astype(np.int32)
                made = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(length),
                     pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(tf))], names=["doc", "n", "terms", "tfs"])
                yield made.filter(pa.array(length > 0))

    frame = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return frame.mapInArrow(index, "doc long, n long, terms array<int>, tfs array<long>")


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's occurrences are worth in a document of this length, before the term's weight."""
    norm = 100 - 90 + (90 * length * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + 8 * norm)


class Ranker:
    """The best k documents of each query over all shards given so far."""

    def __init__(self, queries: list[np.ndarray], df: np.ndarray, weight: np.ndarray, k: int):
        # Rarest term first; the number breaks ties.
        self.queries = [q[np.lexsort((q, df[q]))] for q in queries]
        self.weight, self.k = weight, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in queries]
        self.created = 0  # accumulators

    def add(self, ids: np.ndarray, missing: np.ndarray, owner: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        """Score one shard: postings of documents ``ids`` (``missing`` marks null ids)."""
        order = np.argsort(term, kind="stable")
        owner, term, impact = owner[order], term[order], impact[order]
        starts = np.searchsorted(term, np.arange(len(self.weight) + 1))
        held = np.flatnonzero(np.diff(starts))
        most = np.zeros(len(self.weight), np.int64)
        if len(held):
            most[held] = np.maximum.reduceat(impact, starts[held])
        for number, query in enumerate(self.queries):
            docs, scores = self._scores(query, owner, impact, starts, most, self.best[number][0], len(ids))
            self._keep(number, ids[docs], missing[docs], scores)

    def _scores(self, query, owner, impact, starts, most, finished, n_docs) -> tuple[np.ndarray, np.ndarray]:
        query = query[starts[query + 1] > starts[query]]
        weight = self.weight[query]
        # What the terms from each place on can add at most.
        left = np.concatenate((np.cumsum((weight * most[query])[::-1])[::-1], [0]))
        if len(finished) == self.k and left[0] < finished.min():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums, docs, scores = np.zeros(n_docs, np.int64), None, None
        for place, (t, w) in enumerate(zip(query, weight, strict=True)):
            found, worth = owner[starts[t]: starts[t + 1]], impact[starts[t]: starts[t + 1]]
            if docs is None:
                sums[found] += w * worth
                if left[place + 1] < sums.max() and self._settled(finished, sums, left[place + 1]):
                    docs = np.flatnonzero(sums)
                    scores = sums[docs]
            else:
                at = np.minimum(np.searchsorted(found, docs), len(found) - 1)
                hit = found[at] == docs
                scores[hit] += w * worth[at[hit]]
        if docs is None:
            docs = np.flatnonzero(sums)
            scores = sums[docs]
        self.created += len(docs)
        return docs, scores

    def _settled(self, finished: np.ndarray, sums: np.ndarray, left: int) -> bool:
        """Whether k documents already score more than the remaining terms can give."""
        return np.count_nonzero(finished > left) + np.count_nonzero(sums > left) >= self.k

    def _keep(self, number: int, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > self.k:
            enough = scores >= np.partition(scores, -self.k)[-self.k]
            ids, missing, scores = ids[enough], missing[enough], scores[enough]
        old = self.best[number]
        scores, ids, missing = (np.concatenate(pair) for pair in zip(old, (scores, ids, missing), strict=True))
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.best[number] = scores[order], ids[order], missing[order]


def score_index(index: DataFrame, ranker: Ranker, n_docs: int, n_terms: int, limit: int = SHARD_POSTINGS) -> DataFrame:
    """query (number), doc, score: the best k of each query in every task."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> None:
            ids, missing, length, lists, term, tf = (np.concatenate(part) for part in zip(*waiting, strict=True))
            owner = np.repeat(np.arange(len(ids)), lists)
            ranker.add(ids, missing, owner, term, impacts(tf, length[owner], n_docs, n_terms))

        for batch in batches:
            at = 0
            ends = np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                used = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, used + limit, "right")))
                part = batch.slice(at, end - at)
                doc, n, terms, tfs = part.columns
                waiting.append((doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False),
                                n.to_numpy(zero_copy_only=False), terms.value_lengths().to_numpy(zero_copy_only=False),
                                terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)))
                size += len(waiting[-1][-1]) + len(waiting[-1][0])
                if size >= limit:
                    flush()
                    waiting, size = [], 0
                at = end
        if waiting:
            flush()
        for number, (scores, ids, missing) in enumerate(ranker.best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), number, np.int32)), pa.array(ids, mask=missing), pa.array(scores)],
                    names=["query", "doc", "score"])

    return index.mapInArrow(score, "query int, doc long, score long")


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item and its distinct terms, one row per item that has any."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = items.select(F.col(item_id).alias("item"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))).alias("term"))
    return found.groupBy("item").agg(F.collect_set("term").alias("terms"))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id",
                   text: str = "text", item_text: str = "text", group_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the best ``k`` documents of each query with a score above 0.

    ``doc_id`` is an integer column; ``item_id`` may have any type.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    queries = scratch.save(query_terms(items, item_id, item_text), "queries")
    pairs = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    groups = -(-pairs // group_terms)
    group = F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(max(1, groups)))
    name = queries.schema["item"].dataType.simpleString()
    ranked = [spark.createDataFrame([], f"item {name}, rank int, doc long, score long")]
    for number in range(groups):
        rows = queries.where(group == number).collect()
        terms = Terms.of([r["terms"] for r in rows])
        index = scratch.save(build_index(docs, terms, doc_id, text), "index")
        totals = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"]:
            continue
        # At most one row per term of the group.
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(totals["docs"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        df, weights = np.zeros((2, len(terms.hashes)), np.int64)
        for r in held.withColumn("weight", weight).collect():
            df[r["term"]], weights[r["term"]] = r["df"], r["weight"]
        found = score_index(index, Ranker(terms.queries, df, weights, k), totals["docs"], totals["terms"])
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"query int, item {name}")
        ranked.append(found.join(F.broadcast(names), "query").select("item", "rank", "doc", "score"))
    out = ranked[0]
    for part in ranked[1:]:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")
