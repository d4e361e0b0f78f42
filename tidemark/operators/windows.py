"""Sliding windows: one output row per window, values as an array of steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import SeriesLayout, row_index


def _step(columns: Sequence[str]) -> Column:
    # A struct keeps steps whose values are null; a bare collect_list drops them.
    return F.struct(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))


# A block holds at most so many windows, values of windows and rows.
BLOCK_WINDOWS, BLOCK_VALUES, BLOCK_ROWS = 1024, 250_000, 16_384


def sliding_windows(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    input_len: int,
    output_len: int = 0,
    targets: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    stride: int = 1,
    layout: SeriesLayout | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Windows of ``input_len`` rows, with the ``output_len`` following rows when asked.

    Result: keys, ``window_index`` (row number of the window's first row divided
    by the stride), ``window_count`` of the series, ``window_end`` (order value
    of the last input row), ``x`` and, with targets, ``y`` as arrays of steps.
    A series that is too short gives no window.

    Rows are numbered first, which tells how many windows there are. Then every row is gathered once into
    the block of windows it belongs to, and again into the next block where the windows reach over its end;
    a window is a slice of its block. So a long series is spread over its blocks, rows that no window holds
    are never gathered, and nothing is counted over rows that already carry windows. ``block_rows`` sets
    the number of windows in a block.
    """
    keys, order = list(keys), list(order)
    needed = list(dict.fromkeys([*keys, *order, *features, *(targets or [])]))
    span = input_len + (output_len if targets else 0)
    values = span * (len(features) + len(targets or []))
    per = block_rows or max(1, min(BLOCK_WINDOWS, BLOCK_VALUES // values, BLOCK_ROWS // min(stride, span)))
    at, windows = F.col("_row"), F.floor((F.col("_rows") - span) / stride).cast("long") + 1
    indexed = row_index(df.select(*needed), keys, order, "_row", "_rows", layout).withColumn("_windows", windows)
    used = (F.col("_windows") > 0) & (at < (F.col("_windows") - 1) * stride + span)
    if stride > span:
        used &= F.pmod(at, F.lit(stride)) < span  # the rows between two windows
    first = F.greatest(F.lit(0), F.ceil((at - (per - 1) * stride - span + 1) / (per * stride))).cast("long")
    last = F.least(F.floor(at / (per * stride)), F.floor((F.col("_windows") - 1) / per)).cast("long")
    placed = indexed.where(used).withColumn("_block", F.explode(F.sequence(first, last)))
    parts = [_step(features).alias("x"), F.col(order[0]).alias("end")] + ([_step(targets).alias("y")] if targets else [])
    blocks = placed.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct(at.alias("at"), *parts))).alias("_steps"), F.max("_windows").alias("_windows"))
    begin = F.col("_block") * per
    numbers = F.sequence(F.lit(0).cast("long"), F.least(F.lit(per), F.col("_windows") - begin) - 1)
    made = blocks.select(*keys, F.col("_windows").alias("window_count"), F.explode(
        F.transform(numbers, lambda j: _slice(j, min(stride, span), input_len, output_len if targets else 0, begin + j))).alias("_w"))
    return made.select(*keys, "_w.window_index", "window_count", "_w.window_end", "_w.x", *(["_w.y"] if targets else []))


def _slice(number: Column, step: int, input_len: int, output_len: int, index: Column) -> Column:
    """Window ``number`` of the rows gathered in ``_steps``, in which windows begin every ``step`` rows."""
    start = (number * step).cast("int")
    values = lambda name, skip, count: F.transform(
        F.slice("_steps", start + skip + 1, F.lit(count)), lambda s: s[name]["v"]).alias(name)
    return F.struct(
        index.alias("window_index"), F.get("_steps", start + input_len - 1)["end"].alias("window_end"),
        values("x", 0, input_len), *([values("y", input_len, output_len)] if output_len else []))


def first_windows(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    input_len: int,
    count: int,
    shift: int = 1,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The first ``count`` windows of every series, ``shift`` rows apart: keys, window_index, window_end, x.

    Only the rows that these windows reach are shuffled; a rank filter keeps them in every task.
    """
    keys = list(keys)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    held = ranked.where(F.col("_rank") <= (count - 1) * shift + input_len)
    if shift > input_len:
        held = held.where(F.pmod(F.col("_rank") - 1, F.lit(shift)) < input_len)
    step = min(shift, input_len)
    steps = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_rank").alias("at"), _step(features).alias("x"), F.col(order[0]).alias("end")))).alias("_steps"))
    whole = F.least(F.lit(count), F.floor((F.size("_steps") - input_len) / step) + 1).cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), whole - 1)
    made = steps.where(F.size("_steps") >= input_len).select(*keys, F.explode(
        F.transform(numbers, lambda j: _slice(j, step, input_len, 0, j))).alias("_w"))
    return made.select(*keys, "_w.*")


def supervised_windows(df, features, targets, order, input_len, output_len, keys=(), stride=1, **kw):
    """Training pairs: past features, future targets."""
    return sliding_windows(df, features, order, input_len, output_len, targets, keys, stride, **kw)


def inference_windows(df, features, order, input_len, output_len, keys=(), stride=None, **kw):
    """Windows from the first row on; the default stride is the forecast length."""
    return sliding_windows(df, features, order, input_len, keys=keys, stride=stride or output_len, **kw)


def evaluation_windows(df, columns, order, input_len, output_len, keys=(), stride=None, **kw):
    """Inputs and following rows over the same columns."""
    return sliding_windows(
        df, columns, order, input_len, output_len, columns, keys, stride or output_len, **kw
    )


def require_windows(windows: DataFrame) -> DataFrame:
    """Fail when no series was long enough for a single window."""
    if windows.isEmpty():
        raise ValueError("no series has enough rows for one window")
    return windows


def edge_window(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    input_len: int,
    keys: Sequence[str] = (),
    anchor: str = "last",
) -> DataFrame:
    """The last (or first) ``input_len`` rows of each series as one window.

    The rank filter lets Spark keep ``input_len`` rows per key in every task
    before the shuffle, so a very long series stays cheap.
    """
    if anchor not in ("last", "first"):
        raise ValueError(f"anchor must be 'last' or 'first': {anchor}")
    keys = list(keys)
    direction = [F.col(c).desc() if anchor == "last" else F.col(c).asc() for c in order]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*direction)))
    steps = ranked.where(F.col("_rank") <= input_len).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, _step(features).alias("_step")))).alias("_steps")
    )
    return steps.where(F.size("_steps") == input_len).select(
        *keys,
        F.element_at("_steps", -1)[order[0]].alias("window_end"),
        F.transform("_steps", lambda s: s["_step"]["v"]).alias("x"),
    )


def flat(window: str = "x") -> Column:
    """Steps one after the other, features within a step in order."""
    return F.flatten(F.col(window))


def flat_vector(window: str = "x") -> Column:
    return array_to_vector(flat(window))
