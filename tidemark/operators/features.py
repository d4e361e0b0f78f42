"""Lag, rolling and calendar features, cleaning steps and the ready-made bundles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import clip, cyclic_time, high_amount_flag, risk_score
from tidemark.operators.ordering import SeriesLayout, carry, row_frame

ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


@dataclass(frozen=True)
class Lag:
    column: str
    steps: int

    @property
    def before(self) -> int:
        return self.steps

    def build(self, window: WindowSpec) -> Column:
        return F.lag(self.column, self.steps).over(window).alias(f"{self.column}_lag{self.steps}")


@dataclass(frozen=True)
class Rolling:
    """Trailing statistic over ``rows`` rows; null until all of them have a value."""

    column: str
    rows: int
    how: str = "mean"

    @property
    def before(self) -> int:
        return self.rows - 1

    def build(self, window: WindowSpec) -> Column:
        if self.how not in ROLLING:
            raise ValueError(f"unknown rolling statistic: {self.how}")
        frame = window.rowsBetween(-(self.rows - 1), Window.currentRow)
        full = F.count(self.column).over(frame) == self.rows
        return F.when(full, ROLLING[self.how](self.column).over(frame)).alias(
            f"{self.column}_roll{self.rows}_{self.how}"
        )


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def row_features(
    df: DataFrame,
    features: Sequence[Lag | Rolling],
    order: Sequence[str],
    keys: Sequence[str] = (),
    layout: SeriesLayout | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add all lag and rolling features in one pass: one shuffle and one sort per series."""
    require(df, [f.column for f in features])
    reach = max((f.before for f in features), default=0)
    return row_frame(
        df, keys, order, reach, 0, lambda w: [f.build(w) for f in features],
        layout=layout, block_rows=block_rows,
    )


def lag_features(df, columns, lags, order, keys=(), layout=None) -> DataFrame:
    return row_features(df, [Lag(c, k) for c in columns for k in lags], order, keys, layout)


def rolling_features(df, columns, rows, order, keys=(), hows=("mean",), layout=None) -> DataFrame:
    sizes = [rows] if isinstance(rows, int) else rows
    return row_features(
        df, [Rolling(c, w, h) for c in columns for w in sizes for h in hows], order, keys, layout
    )


def time_features(df: DataFrame, time: str) -> DataFrame:
    require(df, [time])
    return df.withColumns(cyclic_time(time))


def sensor_features(df, order, keys=(), lag=24, rows=12, layout=None) -> DataFrame:
    """Temperature one day back and the trailing demand mean."""
    return row_features(df, [Lag("temperature", lag), Rolling("demand", rows)], order, keys, layout)


def hourly_load_features(
    df, columns, time, keys=(), tie=(), lag=24, rows=12, layout=None
) -> DataFrame:
    """Lag and trailing mean of each load column plus the calendar angles."""
    features = [Lag(c, lag) for c in columns] + [Rolling(c, rows) for c in columns]
    return time_features(row_features(df, features, [time, *tie], keys, layout), time)


def fraud_features(df: DataFrame) -> DataFrame:
    require(df, ["amount", "device_risk", "tx_count_30m"])
    amount, count, device = F.col("amount"), F.col("tx_count_30m"), F.col("device_risk")
    return df.withColumns(
        {"high_amount_flag": high_amount_flag(amount), "risk_score": risk_score(amount, count, device)}
    )


def sanitize_ratio(df: DataFrame, column: str = "like_ratio") -> DataFrame:
    if column not in df.columns:
        return df
    return df.withColumn(column, clip(F.col(column), 0.0, 1.0))


def downcast(df: DataFrame, column: str = "production") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("float"))


def normalise_series(df, time="date", entity="location_id", entity_value=1, out="event_timestamp") -> DataFrame:
    """Rename the time column to the store's name and give the table a constant entity."""
    require(df, [time])
    kind = df.schema[time].dataType
    moment = F.col(time) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.to_timestamp(time)
    return df.withColumns({out: moment, entity: F.lit(entity_value)}).drop(time)


def normalise_rows(df, categories, key, timestamp, entity="passenger_id", out="event_timestamp") -> DataFrame:
    """Text categories without nulls, the row key as entity, one ingestion time for all rows."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in categories}
    return df.withColumns({**filled, entity: F.col(key), out: F.lit(timestamp)})


def forward_fill(df, columns, order, keys=(), layout: SeriesLayout | None = None) -> DataFrame:
    """Replace nulls by the last earlier value of the series."""
    filled = carry(df, keys, order, {f"_f_{c}": c for c in columns}, layout=layout)
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(*[f"_f_{c}" for c in columns])


def fill_both_ways(df, columns, order, keys=(), layout: SeriesLayout | None = None) -> DataFrame:
    """Forward fill, then backward fill what is still null at the start of a series."""
    from tidemark.operators.ordering import measure

    layout = layout if layout is not None else measure(df, list(keys), list(order))
    out = carry(df, keys, order, {f"_f_{c}": c for c in columns}, True, layout)
    out = carry(out, keys, order, {f"_b_{c}": c for c in columns}, False, layout)
    return out.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in columns}).drop(
        *[f"_{d}_{c}" for d in "fb" for c in columns]
    )


def null_columns(df: DataFrame) -> list[str]:
    """Columns that hold at least one null, found in one aggregate."""
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def clean_station(df: DataFrame, time: str = "event_timestamp", keys=(), tie=()) -> DataFrame:
    """Forward-fill, in time order, every column that has nulls."""
    columns = [c for c in null_columns(df) if c not in (time, *keys, *tie)]
    return forward_fill(df, columns, [time, *tie], keys) if columns else df
