"""A feature store on plain tables.

A feature view is a table with keys, a time column and typed features. Training
sets come from point-in-time joins against it, serving reads from a latest-value
table that :meth:`FeatureStore.materialize` keeps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources.readers import read_entities
from tidemark.streaming.materialize import compact, latest_table, materialize_stream, read_latest

EVENT_TIME = "event_timestamp"
# Feature type names and what they are stored as.
FEATURE_TYPES = {"float": "float", "int": "bigint", "string": "string"}
DEFAULT_FEATURE_TYPE = "float"
# The entity used when none is configured.
DEFAULT_KEY = "location_id"
DEFAULT_IDS = (1, 2, 3, 4)


@dataclass(frozen=True)
class Entity:
    name: str
    key: str
    value_type: str = "string"

    @property
    def column_type(self) -> str:
        return "bigint" if self.value_type == "int" else "string"


@dataclass(frozen=True)
class FeatureView:
    name: str
    entities: tuple[str, ...]
    schema: dict[str, str] = field(hash=False)
    source: str = ""
    ttl_days: float | None = None
    time: str = EVENT_TIME
    tie: tuple[str, ...] = ()
    day: str | None = None  # column of day folders, as write_features makes them
    buckets: int | None = None  # buckets of the keys, as write_bucketed makes them

    @property
    def ttl(self) -> timedelta | None:
        return None if self.ttl_days is None else timedelta(days=self.ttl_days)


class FeatureStore:
    """Views by name, their offline tables, and the latest-value tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path
        self.entities: dict[str, Entity] = {}
        self.views: dict[str, FeatureView] = {}
        self._tables: dict[str, DataFrame] = {}
        self._latest: dict[str, DataFrame] = {}

    # registration -----------------------------------------------------

    def register_entity(self, name: str, key: str, value_type: str = "string") -> Entity:
        self.entities[name] = Entity(name, key, value_type)
        return self.entities[name]

    def register_view(self, view: FeatureView, table: DataFrame | None = None) -> FeatureView:
        """Declare a view over a parquet or catalog source, or over a given table."""
        for name in view.entities:
            if name not in self.entities:
                raise ValueError(f"unknown entity: {name}")
        self.views[view.name] = view
        if table is not None:
            self._tables[view.name] = table
        return view

    def keys(self, view: FeatureView) -> list[str]:
        return [self.entities[name].key for name in view.entities]

    def view(self, name: str) -> FeatureView:
        if name not in self.views:
            raise ValueError(f"unknown feature view: {name}")
        return self.views[name]

    def table(self, name: str) -> DataFrame:
        """The offline rows of a view with declared types; only used columns are read."""
        view = self.view(name)
        raw = self._tables.get(name)
        if raw is None:
            raw = (self.spark.table(view.source.removeprefix("table://"))
                   if view.source.startswith("table://") else self.spark.read.parquet(view.source))
        columns = [
            F.col(c).cast(FEATURE_TYPES.get(kind, FEATURE_TYPES[DEFAULT_FEATURE_TYPE])).alias(c)
            for c, kind in view.schema.items()
        ]
        keys = [F.col(self.entities[e].key).cast(self.entities[e].column_type).alias(self.entities[e].key)
                for e in view.entities]
        extra = [c for c in (*view.tie, *([view.day] if view.day else [])) if c not in view.schema and c in raw.columns]
        return raw.select(*keys, view.time, *extra, *columns)

    def resolve(self, references: Sequence[str]) -> dict[str, list[str]]:
        """Group ``view:feature`` references by view."""
        grouped: dict[str, list[str]] = {}
        for reference in references:
            name, separator, feature = reference.partition(":")
            if not separator:
                raise ValueError(f"expected view:feature, got {reference}")
            if feature not in self.view(name).schema:
                raise ValueError(f"view {name} has no feature {feature}")
            grouped.setdefault(name, []).append(feature)
        return grouped

    # offline ----------------------------------------------------------

    def historical(
        self, entity_rows: DataFrame, references: Sequence[str], time: str = EVENT_TIME
    ) -> DataFrame:
        """Entity rows with the features known at their time; one shuffle for all views of a key."""
        by_key: dict[tuple[str, ...], list[asof.FeatureSide]] = {}
        for name, features in self.resolve(references).items():
            view = self.view(name)
            side = asof.FeatureSide(self.table(name), view.time, {f: f for f in features}, view.ttl, view.tie, day=view.day,
                                    buckets=view.buckets)
            by_key.setdefault(tuple(self.keys(view)), []).append(side)
        out = entity_rows
        for keys, sides in by_key.items():
            out = asof.pit_join_all(out, sides, keys, time)
        return out

    def sequence_by_range(
        self, references, start, end, step=timedelta(hours=1), ids=None, key: str = DEFAULT_KEY,
        kind: str = "timestamp_ntz", ordered: bool = True,
    ) -> DataFrame:
        """Features of every entity on the inclusive time grid, ordered by entity and time.

        Jobs that order the rows themselves pass ``ordered=False`` and save a global sort.
        """
        asof.parse_range(str(start), str(end))
        grid = asof.time_grid(self._ids(ids, key), start, end, step, EVENT_TIME, kind)
        found = self.historical(grid, references)
        return found.orderBy(key, EVENT_TIME) if ordered else found

    def latest_sequence(
        self, references, points, step_hours=1, ids=None, key: str = DEFAULT_KEY,
        time_point: datetime | str = "now", kind: str = "timestamp_ntz", ordered: bool = True,
    ) -> DataFrame:
        """The last ``points`` grid steps of every entity, ordered by entity and time."""
        grid = asof.latest_grid(self._ids(ids, key), time_point, points, step_hours, EVENT_TIME, kind)
        found = self.historical(grid, references)
        return found.orderBy(key, EVENT_TIME) if ordered else found

    def latest_sequence_of(self, references, points, entity_id=None, key: str = DEFAULT_KEY, **kw) -> DataFrame:
        """One entity's latest sequence; the first default id when none is given."""
        return self.latest_sequence(references, points, ids=[DEFAULT_IDS[0] if entity_id is None else entity_id],
                                    key=key, **kw)

    def historical_table(self, path, references, key, time=EVENT_TIME, targets=()) -> DataFrame:
        """Labelled entity rows from a file, with their features."""
        return self.historical(read_entities(self.spark, path, key, time, targets), references, time)

    # online -----------------------------------------------------------

    def materialize(self, name: str, start: datetime | str, end: datetime | str) -> DataFrame:
        """Latest row per key within the inclusive range, merged into the view's latest table.

        Keys that earlier ranges or streams wrote stay. The rows are added as a run of their own, so a
        range may be written again (its rows win over equally old ones), and readers always find a whole table.
        """
        view = self.view(name)
        asof.parse_range(str(start), str(end))
        keys, stored = self.keys(view), self._stored(view)
        latest = asof.latest_rows(self.table(name), keys, view.time, stored, view.tie, start, end)
        if self.path:
            latest_table(self.spark, self._latest_path(name), keys, view.time, stored, view.tie).append(latest)
            return self.latest(name)
        if name in self._latest:
            both = self._latest[name].unionByName(latest)
            latest = asof.latest_rows(both, keys, view.time, stored, view.tie)
        self._latest[name] = latest
        return latest

    def compact(self, name: str) -> None:
        """Merge all runs of the view's latest table into one; readers and running streams go on."""
        view = self.view(name)
        compact(self.spark, self._latest_path(name), self.keys(view), view.time, self._stored(view), view.tie)

    def materialize_stream(self, name: str, rows: DataFrame, checkpoint: str, available_now: bool = True):
        """Keep the view's latest table current from a stream of its feature rows."""
        view = self.view(name)
        return materialize_stream(
            rows, self._latest_path(name), checkpoint, self.keys(view), view.time, self._stored(view), view.tie,
            available_now)

    def latest(self, name: str, wanted: DataFrame | None = None) -> DataFrame:
        """The newest stored row per key, whichever batch or stream wrote it.

        With a table of ``wanted`` keys only the files of their buckets are read.
        """
        if name in self._latest:
            return self._latest[name]
        view = self.view(name)
        return read_latest(
            self.spark, self._latest_path(name), self.keys(view), view.time, self._stored(view), view.tie, wanted)

    def _latest_path(self, name: str) -> str:
        if not self.path:
            raise ValueError(f"view {name} is not materialized and the store has no path")
        return f"{self.path}/latest/{name}"

    @staticmethod
    def _stored(view: FeatureView) -> list[str]:
        return list(dict.fromkeys([*view.tie, *view.schema]))

    def online(
        self, wanted: DataFrame, references: Sequence[str], as_of: datetime | str | None = None
    ) -> DataFrame:
        """Latest materialized values for a table of keys; unknown or expired keys give nulls.

        Without ``as_of`` a view's time to live counts back from the current full hour.
        """
        out = wanted
        moment = asof.resolve_time_point("now" if as_of is None else str(as_of))
        for name, features in self.resolve(references).items():
            view = self.view(name)
            out = asof.lookup(out, self.latest(name, out), self.keys(view), features, view.time, moment, view.ttl)
        return out

    def online_rows(self, ids, references, key: str = DEFAULT_KEY, as_of=None) -> DataFrame:
        wanted = self._ids(ids, key)
        if wanted.isEmpty():
            raise ValueError(f"no online data for {key}={ids}")
        return self.online(wanted, references, as_of)

    def online_sequence(
        self, references, input_len=24, step_hours=1, ids=None, key: str = DEFAULT_KEY,
        time_point: datetime | str = "now", end_date: datetime | str | None = None, ordered: bool = True,
    ) -> DataFrame:
        """Input window plus one day of history per entity.

        When nothing is known at ``time_point`` the sequence ends at ``end_date``.
        """
        points = input_len + 24 // step_hours
        request = dict(points=points, step_hours=step_hours, ids=ids, key=key, ordered=ordered)
        found = self.latest_sequence(references, time_point=time_point, **request)
        names = [r.split(":")[1] for r in references]
        if end_date and found.where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()).isEmpty():
            found = self.latest_sequence(references, time_point=end_date, **request)
        return found

    # facade -----------------------------------------------------------

    def load(
        self,
        view: str,
        features: Sequence[str],
        kind: str = "timeseries",
        mode: str = "historical",
        key: str = DEFAULT_KEY,
        ids=DEFAULT_IDS,
        time_point: datetime | str | None = None,
        start=None,
        end=None,
        step=timedelta(hours=1),
        step_hours: int = 1,
        input_len: int = 24,
        entity_path: str | None = None,
        targets: Sequence[str] = (),
        time: str = EVENT_TIME,
    ) -> DataFrame:
        """One entry point: historical or online, series or rows."""
        if not view:
            raise ValueError("a feature view is required")
        if not features:
            raise ValueError("at least one feature is required")
        references = [f"{view}:{f}" for f in features]
        if mode == "historical" and kind == "timeseries":
            if not (start and end):
                raise ValueError("a historical series needs start and end")
            first = list(ids)[:1] if not isinstance(ids, DataFrame) else ids
            return self.sequence_by_range(references, start, end, step, first, key)
        if mode == "historical":
            if not entity_path:
                raise ValueError("historical rows need an entity table")
            return self.historical_table(entity_path, references, key, time, targets)
        if mode != "online":
            raise ValueError(f"unknown mode: {mode}")
        if kind == "timeseries":
            return self.online_sequence(references, input_len, step_hours, ids, key, time_point or "now", end)
        return self.online_rows(ids, references, key, time_point)

    def _ids(self, ids, key: str) -> DataFrame:
        """Entity ids as a table: given as one, or as a short list."""
        if isinstance(ids, DataFrame):
            return ids.select(key).distinct()
        ids = list(DEFAULT_IDS if ids is None else ids)
        kind = next((e.column_type for e in self.entities.values() if e.key == key), "bigint")
        return self.spark.createDataFrame([(i,) for i in ids], f"`{key}` {kind}").distinct()


def with_source(view: FeatureView, source: str) -> FeatureView:
    return replace(view, source=source)
