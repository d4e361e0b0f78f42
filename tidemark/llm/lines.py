"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` is a store of runs: tables of (line hash, number of documents, largest document), each sorted
by hash. A batch of documents adds one run of level 0. When ``FANOUT`` runs have gathered on a level they are
merged into one run of the next, so a key is rewritten a logarithmic number of times. A line found in
``min_docs`` documents of the runs is settled: batches come in descending order of doc_id, so its keeper is
known, and a later batch merge-anti-joins the settled lines before it counts the rest.

A line's key is the line without whitespace at both ends, A-Z in lower case; keys of at least ``min_chars``
code points that occur in at least ``min_docs`` documents lose all their lines except in the largest doc_id.
Rows count as documents; of rows that share the largest doc_id all keep the line. A null doc_id is below all others.
Null and empty texts are one empty line. Lines that a large part of the documents share are few by
counting, so they are broadcast; all others meet in an ordinary shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.llm.scratch import Scratch

FANOUT = 4
MIN_CHARS = 20
MIN_DOCS = 3
HOT_SHARE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns but ``text``, with (place, k1, k2) of each line that is long enough to be dropped."""
    others = [c for c in docs.columns if c != "text"]
    lines = docs.select(*others, F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.select(*others, "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    digest = F.md5("key")
    return lines.select(*others, "place", *[
        F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(k) for k, at in zip(KEY, (1, 16), strict=True)])


class LineRuns:
    """Runs of line hashes in the shared folder, by level."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT):
        self.scratch = Scratch(spark, "line-runs")
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.stale: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame | None:
        """All runs as one: (k1, k2, docs, keeper)."""
        runs = self.runs() if runs is None else runs
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def settled(self) -> DataFrame | None:
        merged = self.merged()
        return None if merged is None else merged.where(F.col("docs") >= self.min_docs)

    def add(self, lines: DataFrame) -> DataFrame:
        """Count a batch of (doc, k1, k2) whose docs are below all earlier ones.

        Returns the batch's lines that were not settled before; lines of settled keys are repeats. They are
        to be read before the next batch, which removes runs that this one has merged.
        """
        self.scratch.drop(*self.stale)
        self.stale = []
        settled = self.settled()
        counts = lines.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
        fresh = lines
        if settled is not None:
            counts = counts.join(settled.hint("merge"), KEY, "left_anti")
            fresh = lines.join(settled.hint("merge"), KEY, "left_anti")
        self._put(self.scratch.save(counts.sortWithinPartitions(*KEY), "run"), 0)
        return fresh

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            older, self.levels[level] = self.levels[level], []
            whole = self.scratch.save(self.merged(older).sortWithinPartitions(*KEY), "run")
            self.stale += older
            self._put(whole, level + 1)


def dedup_lines(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4) -> DataFrame:
    """The kept columns (all by default) with n_lines, n_dropped and ``kept_text``.

    Columns of these names in the input are replaced. Ids that are not numbers make a single batch.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_dropped", "kept_text")]
    work = docs.select(F.struct(*names).alias("kept") if names else F.lit(0).alias("kept"),
                       F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows that agree in id and text lose the same lines, so the pair may stand for the row.
    work = work.withColumn("row", F.xxhash64("doc", "text"))
    edges = []
    if isinstance(docs.schema[doc_id].dataType, NumericType):
        shares = [i / batches for i in range(1, batches)]
        edges = docs.agg(F.percentile_approx(doc_id, shares, F.lit(1000)).alias("q")).first()["q"] or []
    batch = F.lit(0)
    for edge in edges:
        batch = batch + F.coalesce(F.col("doc") <= edge, F.lit(True)).cast("int")
    lines = scratch.save(lines_of(work.select("doc", "row", batch.alias("batch"), "text"), min_chars), "lines")
    runs = LineRuns(docs.sparkSession, min_docs)
    for number in range(len(edges) + 1):
        runs.add(lines.where(F.col("batch") == number))
    settled = scratch.save(runs.settled(), "settled")
    total = lines.count()
    # Counts of all keys add up to at most the number of lines, so there are at most HOT_SHARE hot ones.
    is_hot = F.col("docs") * HOT_SHARE >= total
    hot = F.broadcast(settled.where(is_hot).select(*KEY, "keeper"))
    cold = settled.where(~is_hot).select(*KEY, "keeper").hint("merge")
    hit = lines.join(hot, KEY).unionByName(lines.join(hot, KEY, "left_anti").join(cold, KEY).select(*lines.columns, "keeper"))
    dropped = (hit.where(~F.col("doc").eqNullSafe(F.col("keeper"))).groupBy("doc", "row")
               .agg(F.collect_set("place").alias("dropped"))).withColumnsRenamed({"doc": "_doc", "row": "_row"})
    joined = work.join(dropped.hint("merge"), (F.col("row") == F.col("_row")) & F.col("doc").eqNullSafe(F.col("_doc")), "left")
    split = F.split("text", "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n"))
    return joined.withColumn("lines", split).select(
        *[F.col("kept").getField(c).alias(c) for c in names], F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))
