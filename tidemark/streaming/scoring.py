"""The last rows of every entity, kept current from a stream, and their scores.

Every micro-batch adds its newest ``input_len`` rows per entity to a :class:`RunTable`, which holds the newest
rows of all batches in buckets of the key. Scoring a batch reads the buckets of the entities it touches, not
the history of the others. Late rows take their place in the window, and nothing is dropped for its time.
A rank filter keeps ``input_len`` rows per entity in every task before the shuffle, so a busy entity stays cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.windows import edge_window, flat
from tidemark.plans.scoring import sanitize
from tidemark.plans.training import predict_all
from tidemark.sources.runs import SEQUENCE, RunTable
from tidemark.streaming.materialize import stream_id


def newest_rows(rows: DataFrame, key: str, order: Sequence[str], count: int) -> DataFrame:
    """The last ``count`` rows of every entity; rows that agree in entity and order are one, added last."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    kept = rows.withColumn("_rank", F.dense_rank().over(newest)).where(F.col("_rank") <= count).drop("_rank")
    others = [c for c in kept.columns if c not in (key, *order)]
    last = F.max_by(F.struct(*others), F.col(SEQUENCE)).alias("_last")
    return kept.groupBy(key, *order).agg(last).select(key, *order, *[f"_last.{c}" for c in others])


def newest_table(spark: SparkSession, path: str, key: str, order: Sequence[str], input_len: int, **options) -> RunTable:
    return RunTable(spark, path, [key], lambda rows: newest_rows(rows, key, order, input_len), **options)


def keep_newest(
    rows: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], features: Sequence[str],
    input_len: int, available_now: bool = True, **options,
) -> StreamingQuery:
    """Keep the newest rows of every entity below ``path``; ``order`` must be total within an entity."""
    table = newest_table(rows.sparkSession, path, key, order, input_len, **options)
    return _start(rows, table, checkpoint, [key, *order, *features], available_now, lambda batch, name: None)


def last_windows(
    spark: SparkSession, path: str, key: str, order: Sequence[str], features: Sequence[str], input_len: int,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The window of every entity (or of the ``wanted`` keys) over all batches written so far."""
    rows = newest_table(spark, path, key, order, input_len).read(wanted)
    return edge_window(rows, features, order, input_len, [key])


def score_stream(
    rows: DataFrame, model, path: str, out: str, checkpoint: str, key: str, order: Sequence[str],
    features: Sequence[str], input_len: int, available_now: bool = True, **options,
) -> StreamingQuery:
    """Score the window of every entity that a batch touches; one folder of ``out`` per batch.

    A window with a missing value gets a null prediction.
    """
    table = newest_table(rows.sparkSession, path, key, order, input_len, **options)

    def score(batch: DataFrame, name: str) -> None:
        frame = edge_window(table.read(batch.select(key).distinct()), features, order, input_len, [key])
        scored = predict_all(model, frame.withColumn("_flat", flat("x")))
        scored.select(key, "window_end", sanitize("prediction").alias("predictions")).write.mode(
            "overwrite").parquet(f"{out}/batch={name}")

    return _start(rows, table, checkpoint, [key, *order, *features], available_now, score)


def newest_scores(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Each entity's score from the last batch that touched it."""
    number = F.element_at(F.split("batch", "-"), -1).cast("long")
    scored = spark.read.parquet(out)
    last = F.max_by(F.struct("window_end", "predictions"), number).alias("_last")
    return scored.groupBy(key).agg(last).select(key, "_last.*")


def _start(rows, table: RunTable, checkpoint, columns, available_now, then) -> StreamingQuery:
    columns = list(dict.fromkeys(columns))
    spark = rows.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        name = stream_id(spark, checkpoint)
        table.append(batch.select(*columns), name, batch_id)
        then(batch, f"{name}-{batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
