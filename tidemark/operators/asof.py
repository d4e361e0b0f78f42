"""Point-in-time joins, time grids and latest-value tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import SeriesLayout, carry, measure

# Key sets up to this size are broadcast to thin the feature side; checked first.
MAX_BROADCAST_KEYS = 500_000
# Day folder of an offline feature table; filtered on when a table has it.
DATE = "event_date"


def seconds(duration: timedelta | float | int) -> float:
    return duration.total_seconds() if isinstance(duration, timedelta) else float(duration)


def interval(duration: timedelta | float | int) -> Column:
    return F.make_dt_interval(secs=F.lit(seconds(duration)).cast("decimal(18,6)"))


def time_literal(value: datetime | str, kind: T.DataType) -> Column:
    """A timestamp literal of the column's own type, so the comparison reaches the scan."""
    return F.lit(str(value)).cast(kind)


@dataclass(frozen=True)
class FeatureSide:
    """The right side of a point-in-time join: a table and what to take from it."""

    table: DataFrame
    time: str
    columns: Mapping[str, str]  # result name: source name
    ttl: timedelta | float | None = None
    tie: tuple[str, ...] = ()
    matched_time: str | None = None
    day: str | None = None  # column of the UTC day of ``time``, if the table is laid out in day folders
    buckets: int | None = None  # number of buckets of the keys, if the table is stored in such


def prune_sides(
    sides: Sequence[FeatureSide], entities: DataFrame, keys: Sequence[str], entity_time: str
) -> list[FeatureSide]:
    """Drop feature rows that cannot match any entity row.

    One small job over the entity frame gives its time range, which becomes a
    literal filter that the feature scan can push down, and its number of keys.
    A key set below :data:`MAX_BROADCAST_KEYS` also thins the features by a
    broadcast semi join before they are shuffled.
    """
    facts = entities.agg(
        F.min(entity_time).cast("string").alias("lo"),
        F.max(entity_time).cast("string").alias("hi"),
        F.approx_count_distinct(F.struct(*keys)).alias("n"),
    ).first()
    pruned = []
    for side in sides:
        rows, kind = side.table, side.table.schema[side.time].dataType
        if facts["hi"] is None:
            pruned.append(replace(side, table=rows.where(F.lit(False))))
            continue
        high = time_literal(facts["hi"], kind)
        rows = rows.where(F.col(side.time) <= high)
        if side.ttl is not None:
            low = time_literal(facts["lo"], kind) - interval(side.ttl)
            rows = rows.where(F.col(side.time) >= low)
        if side.day:
            # One day more on both sides, for folders cut in another time zone.
            rows = rows.where(F.col(side.day) <= F.date_add(high.cast("date"), 1))
            if side.ttl is not None:
                rows = rows.where(F.col(side.day) >= F.date_sub(low.cast("date"), 1))
        if facts["n"] <= MAX_BROADCAST_KEYS:
            wanted = entities.select(*keys).distinct()
            rows = rows.join(F.broadcast(wanted), list(keys), "left_semi")
        pruned.append(replace(side, table=rows))
    return pruned


def pit_join_all(
    entities: DataFrame,
    sides: Sequence[FeatureSide],
    keys: Sequence[str],
    entity_time: str,
    prune: bool = True,
    layout: SeriesLayout | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """For each entity row the latest feature row of every side, not newer and not older than its ``ttl``.

    Both bounds are inclusive. Every entity row is kept; without a match the
    feature columns are null. A matched row gives its values as they are, nulls
    included. Among feature rows of one key and time the largest ``tie`` wins.

    Entities and all sides are stacked and sorted once per key: one shuffle for
    any number of feature tables, and no range join. If all sides are stored in the same number of
    buckets of the keys, only the entities are shuffled, into the same buckets.
    """
    keys = list(keys)
    buckets = {side.buckets for side in sides}
    if prune:
        sides = prune_sides(sides, entities, keys, entity_time)
    kind = entities.schema[entity_time].dataType
    stacked = entities.select(
        *keys, F.col(entity_time).alias("_time"), F.lit(1).alias("_side"),
        F.struct(*[c for c in entities.columns if c not in keys]).alias("_entity"),
    )
    if len(buckets) == 1 and None not in buckets:
        stacked = stacked.repartition(buckets.pop(), *keys)
    order = ["_time", "_side"]
    for n, side in enumerate(sides):
        usable = side.table.where(F.col(side.time).isNotNull())
        for key in keys:
            usable = usable.where(F.col(key).isNotNull())
        moment = F.col(side.time).cast(kind)
        ties = [F.col(c).alias(f"_tie{n}_{i}") for i, c in enumerate(side.tie)]
        order += [f"_tie{n}_{i}" for i in range(len(side.tie))]
        values = [F.col(source).alias(f"v{i}") for i, source in enumerate(side.columns.values())]
        rows = usable.select(
            *keys, moment.alias("_time"), F.lit(0).alias("_side"), *ties,
            F.struct(moment.alias("at"), *values).alias(f"_feature{n}"),
        )
        stacked = stacked.unionByName(rows, allowMissingColumns=True)
    if layout is None:
        layout = measure(stacked, keys, order, max_rows)
    matches = {f"_match{n}": f"_feature{n}" for n in range(len(sides))}
    joined = carry(stacked, keys, order, matches, layout=layout).where("_side = 1")
    found = []
    for n, side in enumerate(sides):
        match = F.col(f"_match{n}")
        alive = match.isNotNull()
        if side.ttl is not None:
            alive &= match["at"] >= F.col("_time") - interval(side.ttl)
        found += [F.when(alive, match[f"v{i}"]).alias(out) for i, out in enumerate(side.columns)]
        if side.matched_time:
            found.append(F.when(alive, match["at"]).alias(side.matched_time))
    own = [c if c in keys else F.col(f"_entity.{c}").alias(c) for c in entities.columns]
    return joined.select(*own, *found)


def pit_join(
    entities: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    entity_time: str,
    feature_time: str,
    columns: Sequence[str] | Mapping[str, str],
    ttl: timedelta | float | None = None,
    tie: Sequence[str] = (),
    matched_time: str | None = None,
    **options,
) -> DataFrame:
    """:func:`pit_join_all` with a single feature table."""
    names = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    side = FeatureSide(features, feature_time, names, ttl, tuple(tie), matched_time)
    return pit_join_all(entities, [side], keys, entity_time, **options)


def time_grid(
    entities: DataFrame,
    start: datetime | str,
    end: datetime | str,
    step: timedelta | float,
    out: str = "event_timestamp",
    kind: str = "timestamp_ntz",
) -> DataFrame:
    """Every entity at every step of the inclusive range ``start`` .. ``end``."""
    steps = F.sequence(
        F.lit(str(start)).cast(kind), F.lit(str(end)).cast(kind), interval(step)
    )
    return entities.withColumn(out, F.explode(steps))


def latest_grid(
    entities: DataFrame,
    time_point: datetime | str,
    points: int,
    step_hours: int = 1,
    out: str = "event_timestamp",
    kind: str = "timestamp_ntz",
) -> DataFrame:
    """Every entity at ``points`` steps going back from ``time_point``, which is included."""
    at = resolve_time_point(time_point)
    return time_grid(
        entities, at - timedelta(hours=step_hours * (points - 1)), at, timedelta(hours=step_hours), out, kind
    )


def resolve_time_point(time_point: datetime | str, now: datetime | None = None) -> datetime:
    """UTC wall time of ``time_point``; the word ``now`` means the current full hour."""
    if time_point == "now":
        now = now or datetime.now(timezone.utc)
        return now.replace(minute=0, second=0, microsecond=0, tzinfo=None)
    moment = datetime.fromisoformat(time_point) if isinstance(time_point, str) else time_point
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def parse_range(start: str, end: str) -> tuple[datetime, datetime]:
    """UTC bounds of an ISO date range; the start must not be after the end."""
    low, high = resolve_time_point(start), resolve_time_point(end)
    if low > high:
        raise ValueError(f"start {start} is after end {end}")
    return low, high


def time_range(df: DataFrame, column: str = "event_timestamp") -> tuple[datetime, datetime]:
    """First and last time of a table; an error when the column is missing or all null."""
    if column not in df.columns:
        raise ValueError(f"column not found: {column}")
    row = df.agg(F.min(column), F.max(column)).first()
    if row[0] is None:
        raise ValueError(f"column has no values: {column}")
    return row[0], row[1]


def latest_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """The newest row per key within the inclusive range.

    An aggregate, not a window: each task keeps one row per key before the
    shuffle, so a key with very many rows costs no more than any other.
    """
    kind = df.schema[time].dataType
    if start is not None:
        df = df.where(F.col(time) >= time_literal(start, kind))
    if end is not None:
        df = df.where(F.col(time) <= time_literal(end, kind))
    df = df.where(F.col(time).isNotNull())
    newest = F.max_by(F.struct(time, *tie, *[c for c in columns if c not in (time, *tie)]),
                      F.struct(time, *tie))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(
        *keys, f"_row.{time}", *[f"_row.{c}" for c in columns if c != time]
    )


def lookup(
    wanted: DataFrame,
    latest: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    time: str,
    as_of: datetime | str | None = None,
    ttl: timedelta | float | None = None,
) -> DataFrame:
    """Latest stored values for the wanted keys; unknown or expired keys give nulls."""
    keys = list(keys)
    held = latest.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(time).alias("_at"),
                         *[F.col(c).alias(f"_v_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys])
    alive = F.col("_at").isNotNull()
    if ttl is not None:
        if as_of is None:
            raise ValueError("a lookup with a time to live needs as_of")
        alive &= F.col("_at") >= time_literal(as_of, latest.schema[time].dataType) - interval(ttl)
    return wanted.join(held, same, "left").select(
        *wanted.columns, *[F.when(alive, F.col(f"_v_{c}")).alias(c) for c in columns]
    )
