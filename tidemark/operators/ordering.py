"""Order-sensitive building blocks that do not depend on how long a series is.

A Spark window needs all rows of its partition in one task. That is fine for
ordinary series and fatal for a series holding a third of the table. Every
operator here therefore takes a :class:`SeriesLayout`: the list of long series
and the cut points that divide their time axis into chunks of bounded size.
Ordinary series take the plain window; long series run chunk by chunk, and what
one chunk needs from the others (an offset, the last known value, a few
neighbouring rows) travels as a small summary.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

# A series with more rows than this is processed in chunks.
MAX_ROWS_PER_TASK = 4_000_000
# Rows of a series of that length which the length estimate looks at.
ROWS_IN_ESTIMATE = 40_000
# Upper bound for what reaches the driver: series ids and cut points. More long
# series are kept in a table, and an axis that needs more cuts is cut by position.
MAX_LONG_SERIES = 10_000
MAX_CHUNKS = 10_000
# Tables of located ranks up to this many rows are broadcast; counted first.
MAX_BROADCAST_RANKS = 500_000

SERIES = "_series"
CHUNK = "_chunk"


@dataclass(frozen=True)
class SeriesLayout:
    """Which series are long, and where their order axis is cut.

    ``by_position`` stands for long series whose axis has no usable cut points:
    text, or one value that alone fills several chunks. They are cut every
    ``rows`` rows after a distributed sort.
    """

    keys: tuple[str, ...]
    long_series: tuple[tuple, ...] = ()
    cuts: tuple[float, ...] = ()
    rows: int = MAX_ROWS_PER_TASK
    by_position: bool = False
    table: DataFrame | None = None  # keys and number of the long series, if they are many

    @property
    def has_long_series(self) -> bool:
        return bool(self.long_series) or self.table is not None


NUMBER_LIKE = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)


def order_number(df: DataFrame, column: str) -> Column:
    """A double that never decreases along ``column``; used only to form chunks."""
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    raise TypeError(f"cannot cut an order axis of type {kind.simpleString()}: {column}")


def quantiles(df: DataFrame, column: str, parts: int) -> list[float]:
    """Order-axis values that divide ``df`` into about ``parts`` equal parts, repeats included."""
    if parts <= 1:
        return []
    numbers = df.select(order_number(df, column).alias("n")).where("n is not null and not isnan(n)")
    return numbers.approxQuantile("n", [i / parts for i in range(1, parts)], 1 / (4 * parts))


def cut_points(df: DataFrame, column: str, parts: int) -> tuple[float, ...]:
    return tuple(sorted(set(quantiles(df, column, parts))))


def with_chunk(df: DataFrame, column: str, cuts: Sequence[float], out: str = CHUNK) -> DataFrame:
    """Add the chunk number of each row; nulls form chunk -1, as they sort first."""
    if not cuts:
        return df.withColumn(out, F.when(F.col(column).isNull(), -1).otherwise(0).cast("long"))
    numbered = df.withColumn("_order_number", order_number(df, column))
    bucketed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_order_number", outputCol="_bucket", handleInvalid="keep",
    ).transform(numbered)
    chunk = F.when(F.col("_order_number").isNull(), F.lit(-1)).otherwise(F.col("_bucket"))
    return bucketed.withColumn(out, chunk.cast("long")).drop("_order_number", "_bucket")


def measure(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None
) -> SeriesLayout:
    """Find the long series of ``df`` with one partially aggregated count of its keys.

    The count looks at a fraction of the rows that still sees tens of thousands
    of rows of every long series. An estimate is enough: the layout decides how
    the work is divided, never what comes out. Only the key column is read; cut
    points need a second job, and only when a long series exists. Measure once
    per table and pass the layout on.
    """
    max_rows = max_rows or MAX_ROWS_PER_TASK
    share = min(1.0, ROWS_IN_ESTIMATE / max_rows)
    seen = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=7)
    counts = seen.groupBy(*keys).count().where(F.col("count") > max_rows * share)
    long_rows = counts.limit(MAX_LONG_SERIES + 1).collect()
    if not long_rows:
        return SeriesLayout(tuple(keys))
    if len(long_rows) > MAX_LONG_SERIES:
        table = cut_lineage(counts.withColumn(SERIES, F.monotonically_increasing_id()))
        seen_rows = table.agg(F.sum("count")).first()[0]
        layout = SeriesLayout(tuple(keys), (), (), max_rows, table=table.drop("count"))
    else:
        seen_rows = sum(row["count"] for row in long_rows)
        layout = SeriesLayout(tuple(keys), tuple(tuple(row[k] for k in keys) for row in long_rows), (), max_rows)
    parts = int(-(-seen_rows / share // max_rows)) * 2
    if parts > MAX_CHUNKS or not isinstance(df.schema[order[0]].dataType, NUMBER_LIKE):
        return replace(layout, by_position=True)
    _, long_part = split_long(df, layout)
    found = quantiles(long_part, order[0], parts)
    # A value met at four neighbouring cuts fills more than a task by itself.
    if any(a == b for a, b in zip(found, found[3:])):
        return replace(layout, by_position=True)
    return replace(layout, cuts=tuple(sorted(set(found))))


def split_long(df: DataFrame, layout: SeriesLayout) -> tuple[DataFrame, DataFrame]:
    """Ordinary rows, and rows of long series tagged with a series number."""
    if not layout.keys:
        return df.where(F.lit(False)), df.withColumn(SERIES, F.lit(0).cast("long"))
    if layout.table is not None:
        ids = layout.table.withColumnsRenamed({k: f"_k_{k}" for k in layout.keys})
    else:
        schema = T.StructType(
            [T.StructField(f"_k_{k}", df.schema[k].dataType) for k in layout.keys]
            + [T.StructField(SERIES, T.LongType())]
        )
        # At most MAX_LONG_SERIES rows.
        ids = F.broadcast(df.sparkSession.createDataFrame(
            [(*key, i) for i, key in enumerate(layout.long_series)], schema))
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in layout.keys]
    )
    tagged = df.join(ids, same, "left").drop(*[f"_k_{k}" for k in layout.keys])
    return (
        tagged.where(F.col(SERIES).isNull()).drop(SERIES),
        tagged.where(F.col(SERIES).isNotNull()),
    )


def _chunked(long_part: DataFrame, order: Sequence[str], layout: SeriesLayout) -> DataFrame:
    """Number the chunks of the long series, in order."""
    if not layout.by_position:
        return with_chunk(long_part, order[0], layout.cuts)
    placed = sorted_index(long_part, [SERIES, *order], "_position")
    return placed.withColumn(CHUNK, F.floor(F.col("_position") / layout.rows)).drop("_position")


def _layout(df, keys, order, layout):
    return layout if layout is not None else measure(df, keys, order)


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


# --------------------------------------------------------------------------
# row index


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "row_index",
    total: str | None = None,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """Position of each row in its series, from 0; ``total`` adds the series length."""
    keys, order = list(keys), list(order)
    layout = _layout(df, keys, order, layout)

    def plain(part: DataFrame) -> DataFrame:
        part = part.withColumn(out, F.row_number().over(_ordered(keys, order)).cast("long") - 1)
        if total:
            part = part.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return part

    if not layout.has_long_series:
        return plain(df)
    ordinary, long_part = split_long(df, layout)
    long_part = _long_index(long_part, order, layout, out, total).drop(SERIES, CHUNK)
    return long_part if not keys else plain(ordinary).unionByName(long_part)


def _long_index(long_part, order, layout, out, total):
    chunked = _chunked(long_part, order, layout)
    counts = chunked.groupBy(SERIES, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(SERIES).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        SERIES, CHUNK,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy(SERIES)).alias("_total"),
    )
    within = F.row_number().over(_ordered([SERIES, CHUNK], order))
    indexed = chunked.withColumn("_within", within).join(offsets, [SERIES, CHUNK])
    indexed = indexed.withColumn(out, F.col("_offset") + F.col("_within") - 1)
    if total:
        indexed = indexed.withColumn(total, F.col("_total"))
    return indexed.drop("_within", "_offset", "_total")


def sorted_index(df: DataFrame, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Row index over the whole table, for an order of any type.

    A range sort spreads the rows, a reliable checkpoint fixes which row sits in
    which partition, and one count per partition gives the offsets, so no second
    shuffle is needed.
    """
    fixed = cut_lineage(df.orderBy(*order))
    part = F.shiftright(F.col("_spot"), 33)
    fixed = fixed.withColumn("_spot", F.monotonically_increasing_id())
    counts = fixed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_spot", "_offset")
    )


def prefix_sum(df: DataFrame, order: Sequence[str], column: str, out: str) -> DataFrame:
    """Add the sum of ``column`` over all rows that come before in ``order``, for a table of any size.

    A range sort spreads the rows and a reliable checkpoint fixes them; each partition sums by itself and
    starts from the total of the partitions before it. Those totals, one per partition, pass through the driver.
    """
    part = F.shiftright(F.col("_spot"), 33)
    fixed = cut_lineage(df.orderBy(*order)).withColumn("_spot", F.monotonically_increasing_id()).withColumn("_part", part)
    totals = sorted(fixed.groupBy("_part").agg(F.sum(column)).collect())
    starts, at = [], 0
    for number, total in totals:
        starts.append((number, at))
        at += total or 0
    whole = all(isinstance(start, int) for _, start in starts) and isinstance(at, int)
    if not whole:
        starts = [(number, float(start)) for number, start in starts]
    offsets = df.sparkSession.createDataFrame(starts, f"_part long, _start {'long' if whole else 'double'}")
    before = Window.partitionBy("_part").orderBy("_spot").rowsBetween(Window.unboundedPreceding, -1)
    return (fixed.withColumn(out, F.coalesce(F.sum(column).over(before), F.lit(0)))
            .join(F.broadcast(offsets), "_part").withColumn(out, F.col(out) + F.col("_start"))
            .drop("_part", "_spot", "_start"))


# --------------------------------------------------------------------------
# carried values: last known value before, first known value after


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    forward: bool = True,
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """For each ``out: source`` add the nearest non-null source value.

    ``forward`` looks at the row itself and earlier rows, otherwise at the row
    itself and later rows. ``order`` must be total within a series.
    """
    keys, order = list(keys), list(order)
    layout = _layout(df, keys, order, layout)
    # Looking ahead means walking the reversed order: a frame that reaches to the
    # end of the partition would be evaluated anew for every row.
    along = [F.col(c).asc() if forward else F.col(c).desc() for c in order]

    def within(part: DataFrame, by: list[str]) -> DataFrame:
        window = Window.partitionBy(*by).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
        return part.select(
            "*", *[F.last(src, ignorenulls=True).over(window).alias(out) for out, src in columns.items()]
        )

    if not layout.has_long_series:
        return within(df, keys)
    ordinary, long_part = split_long(df, layout)
    chunked = _chunked(long_part, order, layout)
    position = F.struct(*order)
    edge = F.max_by if forward else F.min_by
    edges = chunked.groupBy(SERIES, CHUNK).agg(
        *[edge(F.col(src), F.when(F.col(src).isNotNull(), position)).alias(f"_e{i}")
          for i, src in enumerate(columns.values())]
    )
    chunk_order = F.col(CHUNK).asc() if forward else F.col(CHUNK).desc()
    others = Window.partitionBy(SERIES).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        SERIES, CHUNK,
        *[F.last(f"_e{i}", ignorenulls=True).over(others).alias(f"_c{i}") for i in range(len(columns))],
    )
    done = within(chunked, [SERIES, CHUNK]).join(carried, [SERIES, CHUNK])
    done = done.withColumns(
        {out: F.coalesce(F.col(out), F.col(f"_c{i}")) for i, out in enumerate(columns)}
    ).drop(SERIES, CHUNK, *[f"_c{i}" for i in range(len(columns))])
    return done if not keys else within(ordinary, keys).unionByName(done)


# --------------------------------------------------------------------------
# bounded row frames: lag, rolling statistics, sliding windows


def row_frame(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    build: Callable[[Window], list[Column]],
    layout: SeriesLayout | None = None,
    index: str | None = None,
    total: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frame reaches at most ``before``/``after`` rows.

    ``build`` gets the ordered window and returns aliased columns. Long series
    are cut into blocks of consecutive rows; each block also receives the
    neighbouring rows its frames reach into, and those copies are dropped again.
    ``index`` and ``total`` name optional columns with the row number (from 0)
    and the series length.
    """
    keys, order = list(keys), list(order)
    layout = _layout(df, keys, order, layout)

    def plain(part: DataFrame) -> DataFrame:
        window = _ordered(keys, order)
        extra = [(F.row_number().over(window).cast("long") - 1).alias(index)] if index else []
        if total:
            extra.append(F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(total))
        return part.select("*", *extra, *build(window))

    if not layout.has_long_series:
        return plain(df)
    ordinary, long_part = split_long(df, layout)
    rows = max(block_rows or MAX_ROWS_PER_TASK, before + after + 1)
    idx, size = index or "_index", total or "_size"
    indexed = _long_index(long_part, order, layout, idx, size).drop(CHUNK)
    home = F.floor(F.col(idx) / rows).cast("long")
    place = F.pmod(F.col(idx), F.lit(rows))
    copies = F.filter(
        F.array(
            home,
            F.when((place >= rows - before) & (home < F.floor((F.col(size) - 1) / rows)), home + 1),
            F.when((place < after) & (home > 0), home - 1),
        ),
        lambda block: block.isNotNull(),
    )
    blocks = indexed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    window = Window.partitionBy(SERIES, "_block").orderBy(idx)
    done = blocks.select("*", *build(window)).where(F.col("_home") == F.col("_block"))
    drop = [SERIES, "_home", "_block"] + ([] if index else [idx]) + ([] if total else [size])
    done = done.drop(*drop)
    return done if not keys else plain(ordinary).unionByName(done)


# --------------------------------------------------------------------------
# running totals and order statistics


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str],
    layout: SeriesLayout | None = None,
) -> DataFrame:
    """For each ``out: source`` add the sum of the source over strictly earlier rows."""
    keys, order = list(keys), list(order)
    layout = _layout(df, keys, order, layout)

    def within(part: DataFrame, by: list[str]) -> DataFrame:
        earlier = _ordered(by, order).rowsBetween(Window.unboundedPreceding, -1)
        return part.select(
            "*", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(o) for o, s in sums.items()]
        )

    if not layout.has_long_series:
        return within(df, keys)
    ordinary, long_part = split_long(df, layout)
    chunked = _chunked(long_part, order, layout)
    totals = chunked.groupBy(SERIES, CHUNK).agg(*[F.sum(s).alias(f"_t_{o}") for o, s in sums.items()])
    before = Window.partitionBy(SERIES).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        SERIES, CHUNK,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
    )
    done = within(chunked, [SERIES, CHUNK]).join(offsets, [SERIES, CHUNK])
    done = done.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums})
    done = done.drop(SERIES, CHUNK, *[f"_o_{o}" for o in sums])
    return done if not keys else within(ordinary, keys).unionByName(done)


def select_ranks(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    chunk: str,
    ranks: Callable[[Column], Column] | DataFrame,
    groups: int | None = None,
) -> DataFrame:
    """The rows at given ranks (from 0) of each group, without sorting the group.

    ``chunk`` is a column that never decreases along ``order``. A histogram over
    the chunks locates each rank; only the chunks that hold one are sorted, and
    only their rows are shuffled. ``ranks`` maps the group size to an array of
    ranks, or is a table of group columns and an array ``ranks``. ``groups``, the
    counted number of groups, bounds the table of located ranks, which is then
    broadcast. Result: group columns, ``rank``, order columns, ``equal``, the
    number of rows that are equal in the order columns, and ``offset``, the place
    among those.
    """
    by, order = list(by), list(order)
    counts = df.groupBy(*by, chunk).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    located = counts.select(
        *by, chunk,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.col("_rows"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("_n"),
    )
    if isinstance(ranks, DataFrame):
        asked = ranks.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("ranks").alias("_asked"))
        group = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
        located = located.join(asked, group)
    else:
        located = located.withColumn("_asked", ranks(F.col("_n")))
    wanted = located.select(
        *[F.col(c).alias(f"_h_{c}") for c in [*by, chunk]], "_start",
        F.filter(
            F.array_distinct("_asked"),
            lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_rows")),
        ).alias("_ranks"),
    ).where(F.size("_ranks") > 0)
    same = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in [*by, chunk]]
    )
    if not by or (groups is not None and groups <= MAX_BROADCAST_RANKS):
        wanted = F.broadcast(wanted)
    held = df.join(wanted, same).drop(*[f"_h_{c}" for c in [*by, chunk]])
    # Equal rows are merged before the sort.
    merged = held.groupBy(*by, chunk, *order).agg(
        F.count(F.lit(1)).alias("_weight"), F.first("_start").alias("_start"), F.first("_ranks").alias("_ranks"))
    earlier = _ordered([*by, chunk], order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    return _inside(merged.withColumn("_first", first), by, order)


def _inside(placed: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose span of ranks, ``_first`` and ``_weight`` long, holds one of ``_ranks``."""
    held = F.filter(
        "_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_weight"))
    )
    return placed.select(
        *by, F.explode(held).alias("rank"), *order, "_first", F.col("_weight").alias("equal")
    ).withColumn("offset", F.col("rank") - F.col("_first")).drop("_first")


def merged_values(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """One row per group and value, as numbers, in order: group columns, ``_v``, ``_rows`` and ``_before``.

    ``_rows`` counts the rows of that value, ``_before`` those of all smaller groups and values. Nulls are a row
    of their own that nothing counts as a value. Equal values are merged before they are shuffled, and the
    running count is spread over range partitions, so neither a frequent value nor a large group ends up in
    one task. Counts, moments, extremes and quantiles all follow from this table, that is from one scan.
    """
    by = list(by)
    counts = df.groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_rows"))
    held = counts.withColumn("_held", F.when(F.col("_v").isNull(), F.lit(0)).otherwise(F.col("_rows")))
    return prefix_sum(held, [*by, "_v"], "_held", "_before").drop("_held")


def value_groups(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of :func:`merged_values` one row per group: its columns, ``_all`` rows, ``_n`` values, ``_first`` (the rows
    before them), ``_mean``, ``_low`` and ``_high``."""
    weight = F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(F.lit(0))
    return values.groupBy(*by).agg(
        F.sum("_rows").alias("_all"), F.sum(weight).alias("_n"), F.min("_before").alias("_first"),
        (F.sum(F.col("_v") * F.col("_rows")) / F.nullif(F.sum(weight), F.lit(0))).alias("_mean"),
        F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def beside_groups(values: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every merged value with the facts of its group."""
    if not by:
        facts = [c for c in groups.columns]
        return values.withColumn("_g", groups.select(F.struct(*facts)).scalar()).select(
            "*", *[F.col("_g")[c].alias(c) for c in facts]).drop("_g")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by])
    return values.join(groups.withColumnsRenamed({c: f"_s_{c}" for c in by}), same).drop(*[f"_s_{c}" for c in by])


def quantile_of(probability: float) -> Column:
    """Aggregate over the merged values of a group: the interpolated percentile, null without values."""
    place = (F.first("_n") - 1) * F.lit(probability)
    rank = (F.col("_n") - 1) * F.lit(probability)
    begin = F.col("_before") - F.col("_first")

    def at(r: Column) -> Column:
        return F.max(F.when(F.col("_v").isNotNull() & (begin <= r) & (r < begin + F.col("_rows")), F.col("_v")))

    low, high = at(F.floor(rank)), at(F.ceil(rank))
    return low + (high - low) * (place - F.floor(place))


def percentiles(df: DataFrame, by: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles per group that has values: group columns, ``probability``, ``value``."""
    by, spots = list(by), [float(p) for p in probabilities]
    values = merged_values(df.where(F.col(column).isNotNull()), by, column)
    wide = beside_groups(values, value_groups(values, by), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), *[quantile_of(p).alias(f"_q{i}") for i, p in enumerate(spots)])
    cells = F.array(*[F.struct(F.lit(p).alias("probability"), F.col(f"_q{i}").alias("value")) for i, p in enumerate(spots)])
    return wide.where("_n > 0").select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*")
