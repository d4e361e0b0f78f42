"""Putting feature sources side by side.

Prefer a key join where both sides share a key. Sources that only agree on
position are aligned through a row index; ``position`` is the index column that
:func:`~tidemark.operators.ordering.row_index` adds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import carry, measure, row_index

# "tile", "truncate" and "pad_start" belong to one family of rules,
# "spread" and "pad_end" to the other; "broadcast" to both.
# Sources up to this many rows are broadcast; counted first.
MAX_BROADCAST_ROWS = 500_000
METHODS = ("broadcast", "tile", "spread", "truncate", "pad_start", "pad_end")


def infer_method(have: int, want: int, family: str = "tile") -> str:
    """How to stretch ``have`` rows to ``want`` rows."""
    if have == want:
        return "none"
    if have == 1:
        return "broadcast"
    if family == "tile":
        if have > want:
            return "truncate"
        return "tile" if want % have == 0 else "pad_start"
    if want % have == 0:
        return "spread"
    return "truncate" if have > want else "pad_end"


def source_position(position: Column, have: int, want: int, method: str) -> Column:
    """Which source row goes to the given target position."""
    if method == "truncate" and have < want:
        raise ValueError(f"cannot truncate {have} rows to {want}")
    if method in ("none", "truncate") or (method == "pad_start" and have >= want):
        return position
    if method == "broadcast":
        return F.lit(0).cast("long")
    if method == "tile":
        if want % have:
            raise ValueError(f"cannot tile {have} rows to {want}")
        return position % have
    if method == "spread":
        # Every row in turn; what is left over starts again from the first row.
        times = max(want // have, 1)
        run = have * times
        return F.when(position < run, F.floor(position / times)).otherwise(position - run).cast("long")
    if method == "pad_start":
        # A longer source gives its first rows, a shorter one repeats its first row in front.
        return F.greatest(position - (want - have), F.lit(0)).cast("long")
    if method == "pad_end":
        return F.least(position, F.lit(have - 1)).cast("long")
    raise ValueError(f"unknown alignment method: {method}")


def align(
    base: DataFrame,
    source: DataFrame,
    base_order: Sequence[str],
    source_order: Sequence[str],
    columns: Sequence[str],
    method: str = "auto",
    family: str = "tile",
    prefix: str = "",
    width: int | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Zip ``source`` columns to ``base`` by position, stretching as ``method`` says.

    In the ``spread`` family a broadcast also stretches a single source column to
    ``width`` columns (by default as many as the base has), named ``c_0``, ``c_1``, ...

    The two row counts are counted first; they decide the method. A small source
    is broadcast; otherwise the join is an equi-join on the computed source
    position, split further by :func:`spread_join` when one source row serves very
    many base rows.
    """
    want, have = base.count(), source.count()
    chosen = infer_method(have, want, family) if method == "auto" else ("none" if have == want else method)
    left = row_index(base, [], base_order, "_row", layout=measure(base, [], base_order, max_rows))
    right = row_index(source, [], source_order, "_row", layout=measure(source, [], source_order, max_rows))
    values = [F.col(c).alias(f"{prefix}{c}") for c in columns]
    if chosen == "broadcast" and family == "spread":
        width = width or len(base.columns)
        if len(columns) not in (1, width):
            raise ValueError(f"cannot broadcast {len(columns)} columns to {width}")
        if len(columns) < width:
            values = [F.col(columns[0]).alias(f"{prefix}{columns[0]}_{i}") for i in range(width)]
    right = right.select(F.col("_row").alias("_at"), *values)
    placed = left.withColumn("_at", source_position(F.col("_row"), have, want, chosen))
    if have <= MAX_BROADCAST_ROWS:
        return placed.join(F.broadcast(right), "_at").drop("_at", "_row")
    heavy = chosen in ("broadcast", "pad_start", "pad_end", "tile", "spread")
    # Enough copies of each repeated source row that no position serves too many rows.
    copies = -(-want // (max_rows or 1_000_000)) if heavy else 1
    return spread_join(placed, right, "_at", "_row", copies).drop("_at", "_row")


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, copies: int) -> DataFrame:
    """Inner join where few right rows serve many left rows each.

    The right side is repeated ``copies`` times under a salt, so a single popular
    row does not send all its partners to one task. Only the few rows that can be
    popular are repeated: the first and the last, or all of a small source.
    """
    if copies <= 1:
        return left.join(right, on)
    edge = right.agg(F.min(on).alias("lo"), F.max(on).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    popular = F.lit(True) if edge["n"] <= 100_000 else F.col(on).isin(edge["lo"], edge["hi"])
    salts = F.when(popular, F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    salted_right = right.withColumn("_salt", F.explode(salts))
    salted_left = left.withColumn(
        "_salt", F.when(popular, F.pmod(F.col(by), F.lit(copies)).cast("int")).otherwise(F.lit(0)))
    return salted_left.join(salted_right, [on, "_salt"]).drop("_salt")


def compose(
    base: DataFrame,
    sources: dict[str, tuple[DataFrame, Sequence[str], Sequence[str]]],
    base_order: Sequence[str],
    method: str = "auto",
    family: str = "tile",
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Base columns plus ``{name}_{column}`` of every source, and which came from where.

    ``sources`` maps a name to (table, order columns, value columns).
    """
    out, origin = base, {"base": list(base.columns)}
    for name, (table, order, columns) in sources.items():
        before = set(out.columns)
        out = align(out, table, base_order, order, columns, method, family, prefix=f"{name}_", width=len(base.columns))
        origin[name] = [c for c in out.columns if c not in before]
    return out, origin


def join_features(base: DataFrame, sources: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """The keyed form of :func:`compose`: left equi-joins, columns prefixed with the source name."""
    out = base
    for name, table in sources.items():
        renamed = table.withColumnsRenamed({c: f"{name}_{c}" for c in table.columns if c not in keys})
        out = out.join(renamed, list(keys), "left")
    return out


def restore_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Give composed columns their original names back."""
    return df.withColumnsRenamed(names)


def array_columns(value: str, size: int | tuple[int, int], prefix: str) -> list[Column]:
    """Named columns for an array: ``p_i``, or ``p_s{step}_f{feature}`` for an array of steps."""
    if isinstance(size, int):
        return [F.col(value)[i].alias(f"{prefix}_{i}") for i in range(size)]
    steps, width = size
    return [
        F.col(value)[s][f].alias(f"{prefix}_s{s}_f{f}") for s in range(steps) for f in range(width)
    ]


def predictions_as_feature(
    rows: DataFrame,
    predictions: DataFrame,
    order: Sequence[str],
    input_len: int,
    column: str = "prediction",
    keys: Sequence[str] = (),
    window_index: str = "window_index",
) -> DataFrame:
    """Attach stride-1 window predictions to the row that ended the window.

    Rows before the first window take the first prediction, rows after the last
    window the last one, and a series without any prediction gets 0.
    """
    keys = list(keys)
    layout = measure(rows, keys, order)
    indexed = row_index(rows, keys, order, "_row", layout=layout)
    placed = predictions.select(
        *keys, (F.col(window_index) + (input_len - 1)).alias("_row"), F.col(column).alias("_p"))
    joined = indexed.join(placed, [*keys, "_row"], "left")
    filled = carry(joined, keys, order, {"_next": "_p"}, False, layout)
    filled = carry(filled, keys, order, {"_last": "_p"}, True, layout)
    return filled.withColumn(
        column, F.coalesce("_next", "_last", F.lit(0.0))
    ).drop("_row", "_p", "_next", "_last")
