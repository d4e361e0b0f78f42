"""Lag, rolling, calendar and domain features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, rounded, table
from tidemark.operators import asof, features
from tidemark.operators.features import Lag, Rolling

ORDER = ["ts", "event_id"]


@query("""
SELECT event_id, user_id,
       lag(value, 1) OVER w AS value_lag1, lag(value, 24) OVER w AS value_lag24
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lag_per_user(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return features.lag_features(events, ["value"], [1, 24], ORDER, ["user_id"]).drop("ts", "value")


@query("""
SELECT event_id,
       CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 6) + 0.0 END AS value_roll12_mean,
       CASE WHEN count(value) OVER w = 12 THEN round(stddev_samp(value) OVER w, 6) + 0.0 END AS value_roll12_std,
       CASE WHEN count(value) OVER w = 12 THEN min(value) OVER w END AS value_roll12_min,
       CASE WHEN count(value) OVER w = 12 THEN max(value) OVER w END AS value_roll12_max
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def rolling_per_user(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    hows = ("mean", "std", "min", "max")
    out = features.rolling_features(events, ["value"], 12, ORDER, ["user_id"], hows)
    return rounded(out.drop("user_id", "ts", "value"), "value_roll12_mean", "value_roll12_std")


@query("""
WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_id,
       CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) + 0.0 END AS value_roll5_mean
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""")
def rolling_with_nulls(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    out = features.rolling_features(events, ["value"], 5, ORDER, ["user_id"])
    return rounded(out.select("event_id", "value_roll5_mean"), "value_roll5_mean")


@query("""
SELECT event_id, lag(value, 24) OVER (ORDER BY ts, event_id) AS value_lag24,
       CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 6) + 0.0 END AS value_roll12_mean
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def lag_roll_whole_table(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "value")
    out = features.row_features(events, [Lag("value", 24), Rolling("value", 12)], ORDER)
    return rounded(out.drop("ts", "value"), "value_roll12_mean")


@query("""
SELECT event_id,
       round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin,
       round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_sin,
       round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_cos
FROM events
""")
def cyclic_time(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts")
    return rounded(features.time_features(events, "ts").drop("ts"), "hour_sin", "hour_cos", "dow_sin", "dow_cos")


@query("""
SELECT event_id, lag(value, 24) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS temperature_lag24,
       CASE WHEN count(value) OVER w = 12 THEN round(avg(value * 2) OVER w, 6) + 0.0 END AS demand_roll12_mean
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def sensor_bundle(spark, folder):
    readings = table(spark, folder, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("temperature"), (F.col("value") * 2).alias("demand"))
    out = features.sensor_features(readings, ORDER, ["user_id"])
    return rounded(out.select("event_id", "temperature_lag24", "demand_roll12_mean"), "demand_roll12_mean")


@query("""
SELECT event_id, lag(value, 24) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag24,
       CASE WHEN count(value) OVER w = 12 THEN round(avg(value) OVER w, 6) + 0.0 END AS value_roll12_mean,
       round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0 AS hour_cos,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) + 0.0 AS dow_cos
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
def hourly_load_bundle(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    out = features.hourly_load_features(events, ["value"], "ts", ["user_id"], ["event_id"])
    names = ["value_roll12_mean", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    return rounded(out.select("event_id", "value_lag24", *names), *names)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 50 AS amount, l_discount * 8 AS device_risk,
                  l_quantity / 10 AS tx_count_30m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN amount > 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high_amount_flag,
       round(greatest(0, least(1, 0.6::DOUBLE * device_risk + 0.4::DOUBLE * (tx_count_30m / 10)
             + 0.2::DOUBLE * CASE WHEN amount > 1000 THEN 1 ELSE 0 END)), 6) + 0.0 AS risk_score
FROM s
""")
def risk_score(spark, folder):
    payments = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 50).alias("amount"),
        (F.col("l_discount") * 8).alias("device_risk"), (F.col("l_quantity") / 10).alias("tx_count_30m"))
    out = features.fraud_features(payments)
    return rounded(out.select("l_orderkey", "l_linenumber", "high_amount_flag", "risk_score"), "risk_score")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL
       ELSE round(greatest(0, least(1, l_discount * 12 - 0.1::DOUBLE)), 6) + 0.0 END AS like_ratio
FROM lineitem
""")
def ratio_sanitize(spark, folder):
    ratio = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 12 - 0.1)
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("like_ratio"))
    return rounded(features.sanitize_ratio(items), "like_ratio")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::FLOAT::DOUBLE AS production FROM lineitem")
def downcast(spark, folder):
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("production"))
    return features.downcast(items).withColumn("production", F.col("production").cast("double"))


@query("SELECT event_id, value, 1 AS location_id, ts AS event_timestamp FROM events")
def ingest_series(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value", F.col("ts").alias("date"))
    return features.normalise_series(events)


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS o_orderstatus,
       o_orderkey AS passenger_id, TIMESTAMP '2024-02-01 00:00:00' AS event_timestamp
FROM orders
""")
def ingest_rows(spark, folder):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    orders = table(spark, folder, "orders").select("o_orderkey", status.alias("o_orderstatus"))
    out = features.normalise_rows(orders, ["o_orderstatus"], "o_orderkey", "2024-02-01 00:00:00")
    return out.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))


@query("""
WITH s AS (SELECT event_id, ts, user_id, CASE WHEN event_type = 'view' THEN value END AS production FROM events)
SELECT event_id, last_value(production IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS production
FROM s
""")
def station_clean(spark, folder):
    production = F.when(F.col("event_type") == "view", F.col("value"))
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", production.alias("production"))
    return features.clean_station(rows, "ts", ["user_id"], ["event_id"]).select("event_id", "production")


@query("SELECT min(ts) AS first_time, max(ts) AS last_time FROM events")
def event_time_range(spark, folder):
    events = table(spark, folder, "events")
    kind = events.schema["ts"].dataType.simpleString()
    return spark.createDataFrame([asof.time_range(events, "ts")], f"first_time {kind}, last_time {kind}")
