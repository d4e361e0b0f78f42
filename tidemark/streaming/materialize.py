"""Keeping the latest-value table current from a stream.

Every micro-batch reduces its rows to one per key and appends them to a :class:`RunTable` under the stream's
name and the batch's number, so a batch that Spark repeats is not added twice, a row that arrives late does
not replace a newer one, and what a reader has to open does not grow with the number of batches.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.asof import latest_rows
from tidemark.sources.runs import SEQUENCE, RunTable


def latest_table(
    spark: SparkSession, path: str, keys: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = (), **options,
) -> RunTable:
    """The newest row per key; of rows that agree in time and ``tie`` the one that was added last."""
    kept = list(dict.fromkeys([*tie, *columns]))
    return RunTable(spark, path, keys, lambda rows: latest_rows(rows, keys, time, [*kept, SEQUENCE], [*tie, SEQUENCE]), **options)


def materialize_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Start the job; with ``available_now`` it stops when the source is used up."""
    spark = rows.sparkSession
    table = latest_table(spark, path, keys, time, columns, tie, **options)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, stream_id(spark, checkpoint), batch_id)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the stream when it made the checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def read_latest(
    spark: SparkSession, path: str, keys: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = (),
    wanted: DataFrame | None = None,
) -> DataFrame:
    """The newest row per key over all batches written so far, or of the ``wanted`` keys."""
    found = latest_table(spark, path, keys, time, columns, tie).read(wanted)
    return found.select(*keys, time, *[c for c in columns if c != time])


def compact(
    spark: SparkSession, path: str, keys: Sequence[str], time: str, columns: Sequence[str], tie: Sequence[str] = (), **options,
) -> None:
    """Merge all that was written into one run. Readers that were planned before still find their files."""
    latest_table(spark, path, keys, time, columns, tie, **options).compact()
