"""Streaming jobs, run over the event table until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.catalogue.training import FITTED, next_values_model
from tidemark.session import scratch_path
from tidemark.streaming import materialize, scoring


def event_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/events*.parquet")


@query("""
SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value
FROM events GROUP BY user_id
""")
def materialize_stream(spark, folder):
    path = scratch_path(spark, "latest")
    columns = ["event_id", "value"]
    job = materialize.materialize_stream(
        event_stream(spark, folder), path, path + "-state", ["user_id"], "ts", columns, ["event_id"])
    job.awaitTermination()
    return materialize.read_latest(spark, path, ["user_id"], "ts", columns, ["event_id"])


@query("""
WITH e AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, (r - (n - 12))::INT AS step, value FROM e WHERE r >= n - 12 AND n >= 12
""")
def stream_last_window(spark, folder):
    """The newest window each user had."""
    path, order = scratch_path(spark, "windows"), ["ts", "event_id"]
    scoring.keep_newest(
        event_stream(spark, folder), path, path + "-state", "user_id", order, ["value"], 12).awaitTermination()
    steps = scoring.last_windows(spark, path, "user_id", order, ["value"], 12).select(
        "user_id", F.posexplode("x").alias("step", "_values"))
    return steps.select("user_id", "step", F.col("_values")[0].alias("value"))


@query("""
SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value
FROM events GROUP BY user_id
""")
def materialize_stream_in_parts(spark, folder):
    """Two streams, each over several files in falling order of time, and a compaction between them."""
    path, columns = scratch_path(spark, "parts"), ["event_id", "value"]
    events = table(spark, folder, "events")
    schema = events.schema
    for name, part in (("odd", events.where("event_id % 2 = 1")), ("even", events.where("event_id % 2 = 0"))):
        source = f"{path}-{name}"
        for late in (False, True):
            early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
            part.where(early if late else ~early).write.mode("append").parquet(source)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        materialize.materialize_stream(
            rows, path, f"{path}-{name}-state", ["user_id"], "ts", columns, ["event_id"]).awaitTermination()
        materialize.compact(spark, path, ["user_id"], "ts", columns, ["event_id"])
    return materialize.read_latest(spark, path, ["user_id"], "ts", columns, ["event_id"])


@query(FITTED + """SELECT user_id, ts AS window_end, s.step::INT AS step,
  (CASE WHEN s.step = 0 THEN a0 + b0 * x ELSE a1 + b1 * x END)::FLOAT::DOUBLE AS prediction
FROM e, m, range(2) s(step) WHERE r = n - 1""")
def score_stream(spark, folder):
    """Two late halves of the events as a stream; every user's score after the last batch that touched it."""
    path, events = scratch_path(spark, "scores"), table(spark, folder, "events")
    schema = events.schema
    for part in ("event_id % 2 = 1", "event_id % 2 = 0"):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{path}-in")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-in")
    model = next_values_model(spark, folder)
    scoring.score_stream(rows, model, path, f"{path}-out", f"{path}-state", "user_id", ["ts", "event_id"], ["value"], 1).awaitTermination()
    cells = scoring.newest_scores(spark, f"{path}-out", "user_id").select(
        "user_id", "window_end", F.posexplode("predictions").alias("step", "prediction"))
    return cells.withColumn("prediction", F.col("prediction").cast("double"))
