"""From documents to shards: language, near-copies, benchmark leaks, mixing and sharding.

Every stage gets (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet below the
cluster's shared folder and reads again as the next stage's documents, so a lost executor never costs
more than one stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, leaks, mixing, nearcopies, sharding
from tidemark.llm.queries import SHARD_BYTES, remainder, weights_in_turn
from tidemark.llm.scratch import Scratch

MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known go on, with the predicted one in ``lang``.

    Texts that are null, have no letter or fit no language go. Without a single labelled document there is
    nothing to learn; then all texts with a letter go on as they are.
    """
    model = language.fit_languages(docs.where(remainder(4) != 2))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted = language.predict_languages(docs, model)
    known = predicted.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class stays."""
    return nearcopies.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.mark_leaks(docs, items).where(F.size("leaks") == 0).drop("leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs, mixing.plan_mix(docs, weights_in_turn))


def make_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with its text, as it was written into its shard."""
    return sharding.deliver_shards(docs, SHARD_BYTES)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", make_shards),
]

# The recurrent network and the sketches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
