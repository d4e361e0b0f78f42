"""Reading tables: CSV, parquet, catalog tables and feature views."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of data set, the default time column, the store scheme.
KINDS = ("timeseries", "tabular")
DEFAULT_TIME = "date"
STORE_SCHEME = "feast://"


def check_kind(kind: str) -> str:
    lowered = kind.lower()
    if lowered not in KINDS:
        raise ValueError(f"unknown kind of data set: {kind}")
    return lowered


def _raw_csv(spark: SparkSession, path: str, schema: T.StructType | str | None) -> DataFrame:
    # With a schema the file is read once; inference needs a second scan.
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    try:
        return reader.csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise ValueError(f"cannot read CSV: {path}") from error


def read_csv(
    spark: SparkSession,
    path: str,
    kind: str = "tabular",
    time: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV with a header. A time series needs its time column and gets it parsed.

    An empty file gives an empty table. A time column keeps its raw values when
    any non-null value is not a timestamp.
    """
    df = _raw_csv(spark, path, schema)
    if check_kind(kind) == "tabular" or not df.columns:
        return df
    time = time or DEFAULT_TIME
    if time not in df.columns:
        raise ValueError(f"time column '{time}' not found in {path}")
    return parse_time(df, time)


def parse_time(df: DataFrame, column: str) -> DataFrame:
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        return df
    parsed = F.try_to_timestamp(F.col(column).cast("string"))
    bad = df.where(F.col(column).isNotNull() & parsed.isNull())
    return df.withColumn(column, parsed) if bad.isEmpty() else df


def read_source(
    spark: SparkSession,
    location: str,
    kind: str = "tabular",
    time: str | None = None,
    schema: T.StructType | str | None = None,
    store=None,
    **request,
) -> DataFrame:
    """Choose the reader by prefix, then by extension."""
    check_kind(kind)
    if location.startswith(STORE_SCHEME):
        if store is None:
            raise ValueError("a feature view location needs a store")
        return store.load(kind=kind, **request)
    if location.startswith("table://"):
        return spark.table(location.removeprefix("table://"))
    extension = os.path.splitext(location.rstrip("/"))[1].lower()
    if extension == ".csv":
        return read_csv(spark, location, kind, time, schema)
    if extension == ".parquet":
        return spark.read.parquet(location)
    raise ValueError(f"no reader for {location}")


def read_entities(
    spark: SparkSession, path: str, key: str, time: str, targets: Sequence[str] = ()
) -> DataFrame:
    """Entity rows with their labels: key, time and target columns of a parquet or CSV table."""
    extension = os.path.splitext(path)[1].lower()
    if extension == ".parquet":
        df = spark.read.parquet(path)
    elif extension == ".csv":
        df = parse_time(_raw_csv(spark, path, None), time)
    else:
        raise ValueError(f"unsupported entity table: {path}")
    return df.select(key, time, *targets)


def read_splits(
    spark: SparkSession,
    path: str | None = None,
    train_path: str | None = None,
    test_path: str | None = None,
    val_path: str | None = None,
    out: str = "dataset",
    **options,
) -> DataFrame:
    """One untagged table, or separate tables stacked with their split tag.

    Without a validation table the test table serves as one.
    """
    if path:
        return read_source(spark, path, **options)
    if not train_path:
        raise ValueError("train_path is required when there is no single path")
    if not test_path:
        raise ValueError("test_path is required when there is no single path")
    parts = {"train": train_path, "val": val_path or test_path, "test": test_path}
    frames = [
        read_source(spark, location, **options).withColumn(out, F.lit(tag))
        for tag, location in parts.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
