"""Fit on the training rows, apply anywhere.

Steps are dictionaries with a ``name`` and parameters, applied in order. Fitting
walks the same list over the training rows: statistics are taken from the table
as the earlier stateless steps and directional fills left it, while the fitted
fills, codes and scales themselves are not applied before the next fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expressions import binary, checked_log, clip, exponential
from tidemark.operators.features import fill_both_ways
from tidemark.operators.ordering import MAX_ROWS_PER_TASK, percentiles, sorted_index
from tidemark.session import cut_lineage

FILL_METHODS = ("mean", "median", "mode", "ffill")
SCALE_METHODS = ("zscore", "minmax")
# Class tables up to this many rows are broadcast; counted when fitted.
MAX_BROADCAST_CLASSES = 500_000


@dataclass
class FittedState:
    """What the training rows taught: one value per column, plus a class table."""

    fills: dict[str, tuple[str, float | str | None]] = field(default_factory=dict)
    class_counts: dict[str, int] = field(default_factory=dict)
    classes: DataFrame | None = None  # column, class, code
    scale_method: str | None = None
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)  # column: centre, width


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def select_columns(df: DataFrame, features: Sequence[str] = (), targets: Sequence[str] = ()) -> DataFrame:
    """Configured columns that exist, sorted by name; all columns when none is configured or found."""
    present = sorted({c for c in [*features, *targets] if c in df.columns})
    return df.select(*present) if features and present else df


# --------------------------------------------------------------------------
# stateless steps


def _columns(step: dict) -> list[str]:
    columns = step.get("columns", [])
    if not isinstance(columns, (list, tuple)):
        raise TypeError(f"step '{step['name']}' needs `columns` as a list")
    return list(columns)


def _strict(df: DataFrame, step: dict) -> list[str]:
    columns = _columns(step)
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"column '{c}' not found for step '{step['name']}'")
    return columns


def _lenient(df: DataFrame, step: dict) -> list[str]:
    return [c for c in _columns(step) if c in df.columns and _is_number(df, c)]


def _clip(df, step):
    low, high = step.get("min"), step.get("max")
    return {c: clip(F.col(c), low, high) for c in _lenient(df, step)}


def _log(df, step):
    offset = float(step.get("offset", 0.0))
    return {c: checked_log(F.col(c), offset, c) for c in _lenient(df, step)}


def _abs(df, step):
    return {c: F.abs(c) for c in _strict(df, step)}


def _round(df, step):
    # bround rounds halves to the even neighbour.
    return {c: F.bround(c, int(step.get("decimals", 0))) for c in _strict(df, step)}


def _binary(df, step):
    threshold = float(step.get("threshold", 0.0))
    return {c: binary(F.col(c), threshold) for c in _strict(df, step)}


def _exponential(df, step):
    scale = float(step.get("scale", 1.0))
    return {c: exponential(F.col(c), scale) for c in _strict(df, step)}


def _function(df, step):
    """``func`` maps a Column to a Column; a ``pandas_udf`` fits as well."""
    func = step.get("func")
    if not callable(func):
        raise ValueError("a udf step needs a callable `func`")
    return {c: func(F.col(c)) for c in _columns(step) if c in df.columns}


STATELESS = {
    "clip": _clip, "log": _log, "abs": _abs, "round": _round,
    "binary": _binary, "exponential": _exponential, "udf": _function,
}
STATEFUL = ("fill_missing", "label_encoding", "normalize")


def check_steps(steps: Sequence[dict]) -> list[dict]:
    if not isinstance(steps, (list, tuple)):
        raise TypeError("preprocessing steps must be a list")
    for step in steps:
        if not isinstance(step, dict) or not isinstance(step.get("name"), str):
            raise ValueError("each preprocessing step needs a string `name`")
        if step["name"] not in STATELESS and step["name"] not in STATEFUL:
            raise ValueError(f"unknown preprocessing step: {step['name']}")
        if step["name"] == "fill_missing" and step.get("method", "mean") not in FILL_METHODS:
            raise ValueError(f"invalid fill method: {step['method']}")
        if step["name"] == "normalize" and step.get("method", "zscore") not in SCALE_METHODS:
            raise ValueError(f"invalid scale method: {step['method']}")
    return list(steps)


# --------------------------------------------------------------------------
# fitting


def fit(
    train: DataFrame,
    steps: Sequence[dict],
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> FittedState:
    """Learn fills, classes and scales; ``order`` is needed only by directional fills."""
    state, work = FittedState(), train
    averages: list[tuple[str, Column, callable]] = []
    by_class: list[DataFrame] = []

    def settle() -> None:
        """One aggregate for everything asked of the current working table."""
        if averages:
            row = work.agg(*[expr.alias(f"a{i}") for i, (_, expr, _) in enumerate(averages)]).first()
            for i, (_, _, keep) in enumerate(averages):
                keep(row[i])
            averages.clear()

    for step in check_steps(steps):
        name = step["name"]
        if name == "fill_missing":
            method = step.get("method", "mean")
            columns = [c for c in step.get("columns", work.columns) if c not in (*order, *keys)]
            if method == "ffill":
                settle()
                work = fill_both_ways(work, [c for c in columns if c in work.columns], order, keys)
                continue
            columns = [c for c in columns if c in work.columns]
            if method == "mean":
                for c in columns:
                    averages.append((c, F.avg(c), _keep_fill(state, c, method)))
            elif method == "median":
                state.fills.update(_fit_medians(work, columns))
            else:
                state.fills.update(_fit_modes(work, columns))
        elif name == "label_encoding":
            for c in step.get("columns", []):
                if c in work.columns:
                    by_class.append(work.where(F.col(c).isNotNull()).select(
                        F.lit(c).alias("column"), F.col(c).cast("string").alias("class")).distinct())
        elif name == "normalize":
            columns = [c for c in step.get("columns", []) if c in work.columns]
            if columns:
                state.scale_method, state.scales = step.get("method", "zscore"), {}
                for c in columns:
                    averages.append((c, _scale_facts(c), _keep_scale(state, c, state.scale_method)))
        else:
            settle()
            work = work.withColumns(STATELESS[name](work, step))
    settle()
    _fit_classes(state, by_class)
    return state


def _keep_fill(state, column, method):
    def keep(value):
        state.fills[column] = (method, value)
    return keep


def _scale_facts(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.struct(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                    F.min(value).alias("low"), F.max(value).alias("high"))


def _keep_scale(state, column, method):
    def keep(facts):
        centre, width = (
            (facts["mean"], facts["std"]) if method == "zscore"
            else (facts["low"], None if facts["low"] is None else facts["high"] - facts["low"])
        )
        state.scales[column] = (centre, width or 1.0)
    return keep


def _cells(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """Long form (column, value) of some columns, without nulls."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns
    ])).alias("cell")
    return df.select(cells).select("cell.*").where("value is not null")


def _fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, float | None]]:
    found: dict[str, tuple[str, float | None]] = {c: ("median", None) for c in columns}
    if columns:
        for row in percentiles(_cells(df, columns, "double"), ["column"], "value", [0.5]).collect():
            found[row["column"]] = ("median", row["value"])
    return found


def _fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, float | str]]:
    """Most frequent value per column, the smallest among equals, 0.0 without values."""
    found: dict[str, tuple[str, float | str]] = {c: ("mode", 0.0) for c in columns}
    for numeric in (True, False):
        group = [c for c in columns if _is_number(df, c) == numeric]
        if not group:
            continue
        cells = _cells(df, group, "double" if numeric else "string")
        counts = cells.groupBy("column", "value").count()
        best = counts.groupBy("column").agg(F.min(F.struct(-F.col("count"), "value")).alias("best"))
        for row in best.select("column", "best.value").collect():
            found[row["column"]] = ("mode", row["value"])
    return found


def _fit_classes(state: FittedState, parts: list[DataFrame]) -> None:
    if not parts:
        return
    distinct = parts[0]
    for part in parts[1:]:
        distinct = distinct.unionByName(part)
    distinct = cut_lineage(distinct.distinct())
    counts = {r["column"]: r["count"] for r in distinct.groupBy("column").count().collect()}
    if sum(counts.values()) > MAX_ROWS_PER_TASK:
        # A dictionary too long for one task: index it over a distributed sort.
        indexed = sorted_index(distinct, ["column", "class"], "_at")
        start = indexed.groupBy("column").agg(F.min("_at").alias("_start"))
        coded = cut_lineage(
            indexed.join(F.broadcast(start), "column").withColumn("code", F.col("_at") - F.col("_start")))
    else:
        window = Window.partitionBy("column").orderBy("class")
        coded = distinct.withColumn("code", F.row_number().over(window).cast("long") - 1)
    state.class_counts = counts
    state.classes = coded.select("column", "class", "code")


# --------------------------------------------------------------------------
# applying


def apply(
    df: DataFrame,
    state: FittedState,
    steps: Sequence[dict],
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
    keep_raw: Sequence[str] = (),
) -> DataFrame:
    """Run the steps with fitted values; ``keep_raw`` columns come out untouched."""
    raw = {c: f"_raw_{c}" for c in keep_raw if c in df.columns}
    out = df.withColumns({alias: F.col(c) for c, alias in raw.items()}) if raw else df
    fixed = (*order, *keys, *raw.values())
    for step in check_steps(steps):
        name = step["name"]
        if name == "fill_missing":
            if step.get("method", "mean") == "ffill":
                columns = [c for c in step.get("columns", out.columns) if c in out.columns and c not in fixed]
                out = fill_both_ways(out, columns, order, keys)
            else:
                out = apply_fills(out, state)
        elif name == "label_encoding":
            out = apply_codes(out, state)
        elif name == "normalize":
            out = apply_scales(out, state)
        else:
            out = out.withColumns(STATELESS[name](out, step))
    if raw:
        out = out.withColumns({c: F.col(alias) for c, alias in raw.items()}).drop(*raw.values())
    return out


def apply_fills(df: DataFrame, state: FittedState) -> DataFrame:
    filled = {}
    for c, (_, value) in state.fills.items():
        if c in df.columns and value is not None:
            filled[c] = F.coalesce(F.col(c), F.lit(value))
    return df.withColumns(filled) if filled else df


def apply_codes(df: DataFrame, state: FittedState) -> DataFrame:
    """Class codes; null stays null and a value not seen in training gets code 0."""
    out = df
    for c, n in state.class_counts.items():
        if c not in out.columns:
            continue
        codes = state.classes.where(F.col("column") == c).select(
            F.col("class").alias("_class"), F.col("code").alias("_code"))
        if n <= MAX_BROADCAST_CLASSES:
            codes = F.broadcast(codes)
        joined = out.join(codes, F.col(c).cast("string") == F.col("_class"), "left")
        out = joined.withColumn(
            c, F.when(F.col(c).isNotNull(), F.coalesce("_code", F.lit(0)))
        ).drop("_class", "_code")
    return out


def apply_scales(df: DataFrame, state: FittedState) -> DataFrame:
    missing = [c for c in state.scales if c not in df.columns]
    if missing and len(missing) < len(state.scales):
        raise ValueError(f"columns the scaler was fitted on are missing: {missing}")
    if missing or not state.scales:
        return df
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(centre)) / F.lit(width)
        for c, (centre, width) in state.scales.items() if centre is not None
    })


def fit_apply(
    df: DataFrame,
    steps: Sequence[dict],
    dataset: str = "dataset",
    order: Sequence[str] = (),
    keys: Sequence[str] = (),
    keep_raw: Sequence[str] = (),
) -> tuple[DataFrame, FittedState]:
    """Fit on the rows tagged ``train`` and apply to all rows, tags untouched."""
    train = df.where(F.col(dataset) == "train").drop(dataset)
    state = fit(train, steps, order, keys)
    tagged = [dataset, *keep_raw]
    return apply(df, state, steps, order, keys, tagged), state


def report(state: FittedState, spark) -> DataFrame:
    """What was fitted: per column the kind, detail and value as text."""
    rows = [("fill", c, m, None if v is None else str(v)) for c, (m, v) in state.fills.items()]
    rows += [("classes", c, "count", str(n)) for c, n in state.class_counts.items()]
    rows += [("scale", c, state.scale_method, f"{a} {b}") for c, (a, b) in state.scales.items()]
    if state.scales:
        rows.append(("scaler", "*", state.scale_method, str(len(state.scales))))
    out = spark.createDataFrame(rows, "kind string, column string, detail string, value string")
    if state.classes is not None:
        first = state.classes.where("code < 5").select(
            F.lit("class").alias("kind"), "column", F.col("code").cast("string").alias("detail"),
            F.col("class").alias("value"))
        out = out.unionByName(first)
    return out


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Imputer step; ``most_frequent`` is the mode."""
    names = list(columns)
    kind = "mode" if strategy == "most_frequent" else strategy
    if kind == "median":
        # Spark's own imputer approximates; one row of exact medians is attached instead.
        out = df
        for name in names:
            finite = df.select(F.nanvl(F.col(name).cast("double"), F.lit(None)).alias(name))
            middle = percentiles(finite, [], name, [0.5]).select("value")
            value = F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)), middle.scalar())
            out = out.withColumn(name, value.cast(df.schema[name].dataType))
        return out
    return Imputer(strategy=kind, inputCols=names, outputCols=names).fit(df).transform(df)
