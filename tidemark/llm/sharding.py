"""Shards of bounded size by extendible hashing.

A shard is a bucket of documents whose hash begins with the same bits. Only a bucket above the byte limit
is split, on one more bit, until every bucket fits; so a bucket exists at depth d exactly if it fits and
its parent does not. The directory holds one row per bucket and is grown from a histogram of hash prefixes
a few bits finer than the expected depth; only buckets that are still too large there are counted more
finely. No document moves before the directory is complete.

The bits come from the hash of the document id, so a document keeps its place when others come or go.
Rows that agree in all these bits and together exceed the limit are split on the hash of their row
number. A single document above the limit is a shard of its own. A null text counts as empty, a null id is
an id like any other, and every document counts one byte for its end, so a shard's rows are bounded too.
Repeated rows are documents of their own. :func:`deliver_shards` writes the texts, a folder per shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import Scratch
from tidemark.llm.small import attach
from tidemark.session import scratch_path

BITS = 60
FINER = 6


def hash_bits(value: Column) -> Column:
    """60 bits of the value's hash as a long."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def document_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def directory(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Buckets of (group, key, bytes): group, depth, prefix, shard_bytes, shard_docs.

    Each group has a directory of its own. Buckets of full depth may be above the limit.
    """
    total = rows.groupBy("group").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
    known = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + FINER)
    start, pending, done = 0, rows, []
    while True:
        cells = scratch.save(pending.groupBy("group", F.shiftright("key", BITS - known).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
        depth = F.explode(F.sequence(F.lit(start), F.lit(known))).alias("depth")
        prefixes = cells.select("group", depth, "cell", "bytes", "docs").withColumn(
            "prefix", F.expr(f"shiftright(cell, {known} - depth)"))
        buckets = scratch.save(prefixes.groupBy("group", "depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")), "buckets")
        large = buckets.where(F.col("shard_bytes") > limit).select(
            "group", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        fits = buckets.where((F.col("shard_bytes") <= limit) | F.lit(known == BITS) & (F.col("depth") == known))
        children = fits.withColumn("parent", F.shiftright("prefix", 1)).join(large, ["group", "depth", "parent"], "left_semi")
        done.append(children.drop("parent"))
        done.append(fits.where(F.col("depth") == start) if start == 0 else fits.limit(0))
        over = buckets.where((F.col("depth") == known) & (F.col("shard_bytes") > limit))
        if known == BITS or not over.take(1):
            break
        # What is left is a few buckets above the limit; their rows are counted with more bits.
        left = over.select("group", F.col("prefix").alias("_p"))
        pending = scratch.save(attach(
            pending.withColumn("_p", F.shiftright("key", BITS - known)), left, ["group", "_p"], "left_semi").drop("_p"), "pending")
        start, known = known, min(BITS, known + 2 * FINER)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return scratch.save(out, "directory")


def assign_shards(docs: DataFrame, limit: int, keep: list[str] | None = None, doc_id: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """The kept columns (all by default) with n_bytes, shard (its bits), depth, shard_bytes and shard_docs.

    Columns of these names in the input are replaced. The input is read twice, so it should be a stored table;
    only ids that by themselves exceed the limit make it necessary to write the kept columns to the shared folder.
    """
    added = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    scratch = Scratch(docs.sparkSession, "shards")
    rows = docs.select(F.struct(*names).alias("row") if names else F.lit(0).alias("row"),
                       document_bytes(text).alias("bytes"), hash_bits(F.col(doc_id)).alias("key"),
                       F.monotonically_increasing_id().alias("number"))
    slim = scratch.save(rows.select(F.lit(0).cast("long").alias("group"), "key", "bytes"), "keys")
    first = directory(slim, limit, scratch)
    # Rows of one full key above the limit: the next bits are those of the row number.
    full = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    crowded = first.where(full).select(F.col("prefix").alias("key"))
    some = crowded.take(1)
    if some:  # row numbers must not change any more
        rows = scratch.save(rows, "rows")
    parts = [_placed(rows, first.where(~full), F.lit(0).cast("long"), F.col("key"), F.lit(""))]
    if some:
        spare = scratch.save(attach(rows, crowded, ["key"], "left_semi"), "crowded")
        second = directory(spare.select(F.col("key").alias("group"), hash_bits(F.col("number")).alias("key"), "bytes"),
                           limit, scratch)
        begin = F.lpad(F.bin("key"), BITS, "0")
        parts.append(_placed(spare, second, F.col("key"), hash_bits(F.col("number")), begin)
                     .withColumn("depth", F.col("depth") + BITS))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("bytes").alias("n_bytes"),
                      "shard", "depth", "shard_bytes", "shard_docs")


def _placed(rows: DataFrame, buckets: DataFrame, group: Column, key: Column, begin: Column) -> DataFrame:
    """Rows with their bucket; rows of no bucket are left out."""
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # at most 61
    named = buckets.withColumn("shard", F.when(F.col("depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(bin(prefix), depth, '0')")))
    tried = rows.withColumns({"group": group, "_key": key, "_begin": begin}).withColumn(
        "depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    tried = tried.withColumn("prefix", F.expr(f"shiftright(_key, {BITS} - depth)")).drop("_key")
    return (attach(tried, named, ["group", "depth", "prefix"]).withColumn("shard", F.concat("_begin", "shard"))
            .drop("group", "prefix", "_begin"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder of Parquet files per shard, each shard written by one task; columns about the shard are left out."""
    rows = assigned.drop("n_bytes", "depth", "shard_bytes", "shard_docs")
    (rows.withColumn("shard", F.concat(F.lit("s"), "shard")).repartition("shard").sortWithinPartitions("shard")
     .write.partitionBy("shard").parquet(path))


def read_shards(spark: SparkSession, path: str, schema: T.StructType, text: str = "text") -> DataFrame:
    """The rows of written shards with n_bytes, shard, depth, shard_bytes and shard_docs, all taken from the files.

    ``schema`` has the written columns without ``shard``. A shard is small enough for one task.
    """
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("shard", T.StringType())])).parquet(path)
    sized = found.withColumns({"n_bytes": document_bytes(text), "shard": F.substring("shard", 2, 2 * BITS)})
    per = sized.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return attach(sized, per, F.col("shard") == F.col("_shard")).drop("_shard").select(
        *[f.name for f in schema.fields], "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")


def deliver_shards(docs: DataFrame, limit: int, keep: list[str] | None = None, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Write the kept columns (all by default; ``text`` among them) into shards below the shared folder and read them back."""
    spark = docs.sparkSession
    assigned = assign_shards(docs, limit, keep, doc_id, text)
    path = scratch_path(spark, "delivered")
    write_shards(assigned, path)
    kept = [f for f in assigned.schema.fields if f.name not in ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")]
    return read_shards(spark, path, T.StructType(kept), text)
