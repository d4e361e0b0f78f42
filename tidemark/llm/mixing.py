"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total in proportion to its weight, but at most ``max_epochs`` times its
own size. What a clamped source cannot take is spread over the others by weight, until nobody is above.
A source whose target is e times its size is taken floor(e) times whole, and a part of it once more: the
documents in the order of a seeded hash up to the one that brings the source nearest to its target.

That cut is found digit by digit over the hash: one aggregate per twelve bits, each over the rows that
share the digits found so far, so no source is ever sorted or gathered. Sizes are counts of words. Rows
that agree in doc_id and text have the same hash and are taken alike. A null text has size 0, a null
source is a source like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.small import attach
from tidemark.llm.text import WORD

KEY_BITS = 60
DIGIT_BITS = 12


@dataclass
class Mix:
    """``rows`` has doc_id, source, size and key of every document; ``plan`` a row per source with its
    size, weight, target, number of whole copies and the first key that gets no extra copy."""

    rows: DataFrame
    plan: DataFrame


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sample_key(doc_id: str, text: str, seed: int) -> Column:
    """60 bits of a seeded hash of the document."""
    parts = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
                        F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, KEY_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to (source_size, weight); a source without weight gets 0.

    The level rises with each round that clamps more sources, so the rounds end when none is added.
    If even the caps do not reach the total, every weighted source gets its cap.
    """
    cap, weight = F.col("source_size") * F.lit(float(max_epochs)), F.col("weight").cast("double")
    level, clamped = 0.0, -1
    while True:
        over = (cap < level * weight) & (weight > 0)
        now = sources.agg(
            F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, cap)).alias("caps"),
            F.sum(F.when(~over, weight)).alias("open")).first()
        if now["n"] == clamped:
            break
        clamped = now["n"]
        if not now["open"]:
            level = float("inf")
            break
        level = (total - (now["caps"] or 0.0)) / now["open"]
    open_target = cap if level == float("inf") else F.when(cap < level * weight, cap).otherwise(level * weight)
    return sources.withColumn("target", F.when(weight > 0, open_target).otherwise(F.lit(0.0)))


def plan_mix(docs: DataFrame, weigh, total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
             doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Decide how often each document is taken.

    ``weigh`` gets the table (source, source_size) with one row per source and returns it with ``weight``.
    The total is ``total_share`` times the size of all documents.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                    word_count(text).alias("size"), sample_key(doc_id, text, seed).alias("key")), "rows")
    sources = scratch.save(weigh(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    plan = water_fill(sources, total_share * words, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("copies", F.floor(epochs).cast("long"))
    plan = scratch.save(plan.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")), "plan")
    cuts = _cuts(rows, plan, scratch)
    plan = plan.join(cuts.select(F.col("source").alias("_s"), "cut"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return Mix(rows, scratch.save(plan.drop("_s").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long"))), "cuts"))


def _cuts(rows: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, cut): rows with a key below the cut get the extra copy."""
    zero = F.lit(0).cast("long")
    state = plan.where("need > 0").select("source", "need", zero.alias("prefix"), zero.alias("before"))
    finished, level = [], 0
    while True:
        level += DIGIT_BITS
        at = state.select(F.col("source").alias("_s"), "need", "prefix", "before")
        inside = attach(rows, at, F.col("source").eqNullSafe(F.col("_s"))
                        & (F.shiftright("key", KEY_BITS - level + DIGIT_BITS) == F.col("prefix")))
        cells = (inside.groupBy("source", "need", "before", F.shiftright("key", KEY_BITS - level).alias("cell"))
                 .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("key").alias("key")))
        # At most 2**DIGIT_BITS cells a source.
        up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumn("after", F.col("before") + F.sum("words").over(up_to))
        crossing = cells.where(F.col("after") >= F.col("need")).groupBy("source", "need").agg(
            F.min(F.struct("cell", "after", "words", "n", "key")).alias("c"))
        found = scratch.save(crossing.select(
            "source", "need", F.col("c.cell").alias("prefix"), (F.col("c.after") - F.col("c.words")).alias("before"),
            F.col("c.after").alias("after"), F.col("c.n").alias("n"), F.col("c.key").alias("key")), "crossing")
        single = (F.col("n") == 1) | F.lit(level >= KEY_BITS)
        nearer = F.col("after") - F.col("need") <= F.col("need") - F.col("before")
        finished.append(found.where(single).select("source", F.when(nearer, F.col("key") + 1).otherwise(F.col("key")).alias("cut")))
        state = found.where(~single).select("source", "need", "prefix", "before")
        if level >= KEY_BITS or not state.take(1):
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return out


def with_copies(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds source_size, weight, target and ``copies`` to rows that have source and key."""
    plan = mix.plan.select(F.col("source").alias("_s"), "source_size", "weight", "target", F.col("copies").alias("_whole"), "cut")
    joined = attach(rows, plan, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("_whole") + F.when(F.col("key") < F.col("cut"), 1).otherwise(0)
    return joined.withColumn("copies", copies).drop("_s", "_whole", "cut")


def mix_documents(docs: DataFrame, mix: Mix, seed: int = 17, doc_id: str = "doc_id", text: str = "text",
                  source: str = "source") -> DataFrame:
    """The documents themselves, each as often as the mix takes it. ``seed`` must be the one of the plan."""
    columns = docs.columns
    work = docs.select(F.struct(*columns).alias("row"), F.col(source).alias("source"),
                       sample_key(doc_id, text, seed).alias("key"))
    counted = with_copies(work, mix).where("copies > 0")
    repeated = counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in columns])
