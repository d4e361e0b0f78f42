"""Data quality and output profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import beside_groups, merged_values, quantile_of, value_groups


def data_quality(df: DataFrame) -> DataFrame:
    """Per column its type, null count and the table size, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    kinds = dict(df.dtypes)
    total = sum((F.col(f"n{i}") for i in range(len(df.columns))), F.lit(0))
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(f"n{i}").alias("nulls"))
        for i, c in enumerate(df.columns)
    ])).alias("cell")
    return counts.select(
        cells, F.col("_rows").alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        total.alias("total_nulls"),
    ).select("cell.*", "row_count", "column_count", "total_nulls")


def cluster_distribution(df: DataFrame, label: str) -> DataFrame:
    """Per cluster the size and share; the totals are repeated on every row."""
    counts = df.groupBy(F.col(label).cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("rows").alias("rows"), F.min("rows").alias("low"), F.max("rows").alias("high"),
        F.stddev_pop("rows").alias("std")))
    return counts.withColumn("all", totals.scalar()).select(
        "cluster", "rows",
        F.round(F.col("rows") / F.col("all.rows") * 100, 2).alias("percentage"),
        F.col("all.n").alias("n_clusters"),
        F.col("all.rows").alias("n_samples"),
        F.col("all.low").alias("min_cluster_size"),
        F.col("all.high").alias("max_cluster_size"),
        F.round("all.std", 2).alias("std_cluster_size"),
        F.round(F.col("all.low") / F.col("all.high"), 4).alias("balance_ratio"),
    )


def value_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, moments, range and exact quartiles per group; nulls count as samples only.

    Everything follows from the merged values, so the table is read once, with and without groups.
    """
    by = list(by)
    number = F.col(value).cast("double")
    # NaN is a missing value here, as null is.
    clean = df.select(*by, F.when(~F.isnan(number), number).alias("_x"))
    values = merged_values(clean, by, "_x")
    beside = beside_groups(values, value_groups(values, by), by)
    gap = F.col("_v") - F.col("_mean")
    stats = beside.groupBy(*by).agg(
        F.first("_all").alias("n_samples"), F.first("_mean").alias("mean"),
        F.sqrt(F.sum(F.col("_rows") * gap * gap) / F.first("_n")).alias("std"),
        F.first("_low").alias("min"), F.first("_high").alias("max"), quantile_of(0.5).alias("median"),
        quantile_of(0.25).alias("q25"), quantile_of(0.75).alias("q75"))
    if not by:
        stats = stats.withColumn("n_samples", F.coalesce("n_samples", F.lit(0).cast("long")))
    names = ["mean", "std", "min", "max", "median", "q25", "q75"]
    return stats.select(*by, "n_samples", *[F.round(c, 6).alias(c) for c in names])


def prediction_stats(df: DataFrame, predictions: str, by: Sequence[str] = ()) -> DataFrame:
    """Statistics per target and step of an array-of-steps prediction column."""
    steps = df.select(*by, F.posexplode(predictions).alias("step", "_targets"))
    cells = steps.select(*by, "step", F.posexplode("_targets").alias("target", "_value"))
    return value_stats(cells, "_value", [*by, "target", "step"])


def metric_summary(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Rounded values with the names of the smallest and the largest value."""
    real = metrics.where(F.col(value).isNotNull() & ~F.isnan(value))
    everything = Window.partitionBy(F.lit(0))  # one row per metric
    return real.select(
        F.col(metric).alias("metric"), F.round(value, 6).alias("value"),
        F.min_by(F.col(metric), F.struct(F.col(value), F.col(metric))).over(everything).alias("best"),
        F.max_by(F.col(metric), F.struct(F.col(value), F.col(metric))).over(everything).alias("worst"),
    )


def frame_profile(df: DataFrame, time: str = "event_timestamp") -> DataFrame:
    """Rows, columns, nulls and the time range."""
    nulls = [F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).alias("column_count"),
        sum(nulls[1:], nulls[0]).alias("null_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time"),
    )


def array_summary(df: DataFrame, column: str) -> DataFrame:
    """Shape of an array column: rows, shortest and longest array, element type and element count."""
    kind = df.schema[column].dataType
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(F.size(column)).alias("min_size"),
        F.max(F.size(column)).alias("max_size"), F.sum(F.size(column)).alias("elements"),
    ).withColumn("element_type", F.lit(kind.elementType.simpleString()))
