"""Feature store: point-in-time joins, grids, materialization and lookups."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import asof
from tidemark.session import scratch_path
from tidemark.sources.store import FeatureStore, FeatureView

VIEWED = FeatureView("viewed", ("user",), {"value": "float", "event_id": "int"}, ttl_days=2, time="ts",
                     tie=("event_id",))
BOUGHT = FeatureView("bought", ("user",), {"amount": "float"}, ttl_days=None, time="ts", tie=("event_id",))


def shop(spark, folder) -> FeatureStore:
    """Two views over the events: what a user looked at, and what they bought."""
    store = FeatureStore(spark)
    store.register_entity("user", "user_id", "int")
    events = table(spark, folder, "events")
    store.register_view(VIEWED, events.where("event_type = 'view'"))
    store.register_view(BOUGHT, events.where("event_type = 'purchase'").withColumnRenamed("value", "amount"))
    return store


def every_user(spark, folder):
    return table(spark, folder, "events").select("user_id").distinct()


@query("""
WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
     m AS (SELECT e.event_id, e.ts, f.ts AS view_ts, f.value AS view_value
           FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT event_id, CASE WHEN view_ts >= ts - INTERVAL 2 DAY THEN view_value END AS view_value,
       CASE WHEN view_ts >= ts - INTERVAL 2 DAY THEN view_ts END AS view_time
FROM m
""")
def pit_last_view(spark, folder):
    events = table(spark, folder, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), "event_id", "value")
    return asof.pit_join(
        events.select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view_ts",
        {"view_value": "value"}, ttl=timedelta(days=2), tie=["event_id"], matched_time="view_time",
    ).select("event_id", "view_value", "view_time")


@query("""
WITH f AS (SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM (
             SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS r
             FROM orders WHERE o_orderstatus = 'F') WHERE r = 1),
     m AS (SELECT o.o_orderkey, o.o_orderdate, f.o_orderdate AS done, f.o_totalprice AS p, f.o_orderkey AS k
           FROM orders o ASOF LEFT JOIN f ON o.o_custkey = f.o_custkey AND o.o_orderdate >= f.o_orderdate)
SELECT o_orderkey, CASE WHEN done >= o_orderdate - INTERVAL 365 DAY THEN p END AS finished_price,
       CASE WHEN done >= o_orderdate - INTERVAL 365 DAY THEN k::DOUBLE END AS finished_key
FROM m
""")
def pit_last_finished_order(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    finished = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderdate", "finished_at")
    return asof.pit_join(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), finished, ["o_custkey"], "o_orderdate",
        "finished_at", {"finished_price": "o_totalprice", "finished_key": "o_orderkey"},
        ttl=timedelta(days=365), tie=["o_orderkey"],
    ).select("o_orderkey", "finished_price", F.col("finished_key").cast("double").alias("finished_key"))


@query("""
WITH f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
     b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),
     m AS (SELECT e.event_id, e.user_id, e.ts, CASE WHEN f.ts >= e.ts - INTERVAL 2 DAY THEN f.value END AS v
           FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT m.event_id AS row_id, round(m.v::FLOAT, 3)::DOUBLE AS value, round(b.value::FLOAT, 3)::DOUBLE AS amount
FROM m ASOF LEFT JOIN b ON m.user_id = b.user_id AND m.ts >= b.ts
""")
def historical_two_views(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("event_timestamp"))
    out = shop(spark, folder).historical(rows, ["viewed:value", "bought:amount"])
    return out.select("row_id", *[F.round(c, 3).cast("double").alias(c) for c in ("value", "amount")])


@query("""
WITH f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT e.event_id, round(CASE WHEN f.ts >= e.ts - INTERVAL 2 DAY THEN f.value END::FLOAT, 3)::DOUBLE AS value
FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts
""")
def facade_rows(spark, folder):
    """Historical rows through the single entry point, entity rows read from a parquet file."""
    out = shop(spark, folder).load(
        "viewed", ["value"], "tabular", key="user_id", entity_path=f"{folder}/events.parquet", time="ts",
        targets=["event_id"])
    return out.select("event_id", F.round("value", 3).cast("double").alias("value"))


@query("""
WITH g AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR)) AS t
           FROM (SELECT DISTINCT user_id FROM events)),
     f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT g.user_id, g.t AS event_timestamp,
       round(CASE WHEN f.ts >= g.t - INTERVAL 2 DAY THEN f.value END::FLOAT, 3)::DOUBLE AS value
FROM g ASOF LEFT JOIN f ON g.user_id = f.user_id AND g.t >= f.ts
""")
def grid_sequence(spark, folder):
    out = shop(spark, folder).sequence_by_range(
        ["viewed:value"], "2024-01-02 00:00:00", "2024-01-30 00:00:00", timedelta(hours=6),
        every_user(spark, folder), "user_id")
    return out.withColumn("value", F.round("value", 3).cast("double"))


@query("""
WITH g AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-29 01:00:00', TIMESTAMP '2024-01-30 00:00:00',
                                                  INTERVAL 1 HOUR)) AS t
           FROM (SELECT DISTINCT user_id FROM events)),
     f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT g.user_id, g.t AS event_timestamp,
       round(CASE WHEN f.ts >= g.t - INTERVAL 2 DAY THEN f.value END::FLOAT, 3)::DOUBLE AS value
FROM g ASOF LEFT JOIN f ON g.user_id = f.user_id AND g.t >= f.ts
""")
def latest_sequence(spark, folder):
    out = shop(spark, folder).latest_sequence(
        ["viewed:value"], 24, 1, every_user(spark, folder), "user_id", "2024-01-30T00:00:00")
    return out.withColumn("value", F.round("value", 3).cast("double"))


@query("""
WITH g AS (SELECT user_id, unnest(generate_series(TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 35 HOUR,
                                                  TIMESTAMP '2024-01-20 00:00:00', INTERVAL 1 HOUR)) AS t
           FROM (SELECT DISTINCT user_id FROM events)),
     f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT g.user_id, g.t AS event_timestamp,
       round(CASE WHEN f.ts >= g.t - INTERVAL 2 DAY THEN f.value END::FLOAT, 3)::DOUBLE AS value
FROM g ASOF LEFT JOIN f ON g.user_id = f.user_id AND g.t >= f.ts
""")
def online_sequence_fallback(spark, folder):
    """Nothing is known in 2030, so the sequence ends at the configured date."""
    out = shop(spark, folder).online_sequence(
        ["viewed:value"], 12, 1, every_user(spark, folder), "user_id", "2030-01-01T00:00:00", "2024-01-20T00:00:00")
    return out.withColumn("value", F.round("value", 3).cast("double"))


@query("""
SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id,
       round(arg_max(value, ts)::FLOAT, 3)::DOUBLE AS value
FROM events WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
GROUP BY user_id
""")
def materialize_latest(spark, folder):
    out = shop(spark, folder).materialize("viewed", "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return out.select("user_id", "ts", "event_id", F.round("value", 3).cast("double").alias("value"))


@query("""
WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events
           WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
           GROUP BY user_id)
SELECT c.c_custkey AS user_id,
       round(CASE WHEN l.ts >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN l.value END::FLOAT, 3)::DOUBLE AS value
FROM customer c LEFT JOIN l ON c.c_custkey = l.user_id
""")
def online_lookup(spark, folder):
    """Every customer is asked for; customers without events are unknown keys."""
    store = shop(spark, folder)
    store.materialize("viewed", "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    wanted = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))
    out = store.online(wanted, ["viewed:value"], as_of="2024-01-31 00:00:00")
    return out.withColumn("value", F.round("value", 3).cast("double"))


@query("""
SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id,
       round(arg_max(value, ts)::FLOAT, 3)::DOUBLE AS value
FROM events WHERE event_type = 'view' AND (ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-10'
  OR ts BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-20') GROUP BY user_id
""")
def materialize_two_ranges(spark, folder):
    """A later range keeps the users that only the earlier one has seen."""
    store = shop(spark, folder)
    store.path = scratch_path(spark, "store")
    store.materialize("viewed", "2024-01-01 00:00:00", "2024-01-10 00:00:00")
    store.materialize("viewed", "2024-01-11 00:00:00", "2024-01-20 00:00:00")
    store.compact("viewed")
    out = store.latest("viewed")
    return out.select("user_id", "ts", "event_id", F.round("value", 3).cast("double").alias("value"))


@query("""
WITH l AS (SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value FROM events
           WHERE event_type = 'view' AND ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'
           GROUP BY user_id)
SELECT u.user_id, round(CASE WHEN l.ts >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY THEN l.value END::FLOAT, 3)::DOUBLE AS value
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN l USING (user_id)
""")
def load_online(spark, folder):
    """The facade's online rows, with the view's time to live."""
    store = shop(spark, folder)
    store.materialize("viewed", "2024-01-01 00:00:00", "2024-01-31 00:00:00")
    out = store.load("viewed", ["value"], kind="tabular", mode="online", key="user_id",
                     ids=every_user(spark, folder), time_point="2024-01-31T00:00:00")
    return out.withColumn("value", F.round("value", 3).cast("double"))


@query("""
WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT e.event_id, f.value AS view_value, strftime(f.ts::DATE + 40, '%Y-%m-%d') AS event_date
FROM events e ASOF LEFT JOIN f ON e.user_id = f.user_id AND e.ts >= f.ts
""")
def pit_business_date(spark, folder):
    """A feature called event_date is a feature, not the layout of the table."""
    events = table(spark, folder, "events")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), "event_id", "value", F.date_add(F.to_date("ts"), 40).alias("event_date"))
    return asof.pit_join(
        events.select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "view_ts",
        {"view_value": "value", "event_date": "event_date"}, tie=["event_id"],
    ).select("event_id", "view_value", F.col("event_date").cast("string").alias("event_date"))


@query("""
SELECT user_id, count(*) AS events FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 22:00:00' AND TIMESTAMP '2024-01-20 12:30:00' GROUP BY user_id
""")
def events_in_date_range(spark, folder):
    """An ISO range with offsets becomes UTC bounds, both inclusive."""
    low, high = asof.parse_range("2024-01-06T00:00:00+02:00", "2024-01-20T12:30:00Z")
    events = table(spark, folder, "events")
    kind = events.schema["ts"].dataType
    inside = F.col("ts").between(asof.time_literal(low, kind), asof.time_literal(high, kind))
    return events.where(inside).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
