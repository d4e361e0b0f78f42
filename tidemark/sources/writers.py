"""Writing features, predictions, fitted state and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import DATE
from tidemark.operators.prep import FittedState
from tidemark.session import cut_lineage


def write_features(df: DataFrame, path: str, time: str = "event_timestamp", mode: str = "overwrite") -> None:
    """Offline feature table, one folder per day, so a time range reads only its days.

    The rebalance hint gathers a day's rows into few files and lets adaptive
    execution split a day that is too large for one task.
    """
    dated = df.withColumn(DATE, F.to_date(time))
    dated.hint("rebalance", DATE).write.mode(mode).partitionBy(DATE).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, keys: Sequence[str], time: str = "event_timestamp", buckets: int = 64,
    path: str | None = None, mode: str = "overwrite",
) -> None:
    """Offline feature table in the catalog, bucketed by key and sorted by time within a bucket.

    Point-in-time joins read it bucket by bucket and leave it where it is. One task writes a bucket, so there
    should be enough of them for each to stay at a few hundred MB.
    """
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys, time)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_predictions(
    scored: DataFrame, path: str, columns: Sequence[str] = (), prediction: str = "prediction",
    form: str = "csv", mode: str = "overwrite",
) -> None:
    """The prediction column, with the asked input columns next to it."""
    out = scored.select(*columns, prediction)
    writer = out.write.mode(mode)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported prediction format: {form}")


def save_state(state: FittedState, spark: SparkSession, path: str) -> None:
    """Three small tables: fills, classes and scales."""
    fills = [
        (c, m, float(v) if isinstance(v, (int, float)) else None, v if isinstance(v, str) else None)
        for c, (m, v) in state.fills.items()
    ]
    spark.createDataFrame(
        fills, "column string, method string, number double, text string"
    ).write.mode("overwrite").parquet(f"{path}/fills")
    classes = state.classes if state.classes is not None else spark.createDataFrame(
        [], "column string, class string, code long")
    classes.write.mode("overwrite").parquet(f"{path}/classes")
    scales = [(c, state.scale_method, a, b) for c, (a, b) in state.scales.items()]
    spark.createDataFrame(
        scales, "column string, method string, centre double, width double"
    ).write.mode("overwrite").parquet(f"{path}/scales")


def _part(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def load_state(spark: SparkSession, path: str) -> FittedState:
    """Read a saved state; each of its tables may be absent."""
    state = FittedState()
    fills, classes, scales = (_part(spark, f"{path}/{name}") for name in ("fills", "classes", "scales"))
    if fills is not None:
        state.fills = {
            r["column"]: (r["method"], r["text"] if r["text"] is not None else r["number"]) for r in fills.collect()
        }
    if classes is not None:
        counts = {r["column"]: r["count"] for r in classes.groupBy("column").count().collect()}
        if counts:
            state.class_counts, state.classes = counts, cut_lineage(classes)
    if scales is not None:
        rows = scales.collect()
        state.scales = {r["column"]: (r["centre"], r["width"]) for r in rows}
        state.scale_method = rows[0]["method"] if rows else None
    return state


def write_metrics(metrics: DataFrame, path: str, run: str, step: int = 0) -> None:
    """Append finite metric values under a run and step."""
    value = F.col("value").cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    metrics.where(finite).select(
        F.lit(run).alias("run"), F.lit(step).cast("long").alias("step"), "metric", value.alias("value")
    ).write.mode("append").parquet(path)
