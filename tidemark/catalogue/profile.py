"""Profiles of tables, clusters and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.prep import GAPPY, gappy_events
from tidemark.catalogue.registry import query, rounded, table
from tidemark.operators import metrics, profile


@query(GAPPY + """, n AS (SELECT count(*) AS n, count(*) - count(value) AS v, count(*) - count(event_type) AS t FROM e)
SELECT 'event_id' AS "column", 'bigint' AS "type", 0::BIGINT AS nulls, n AS row_count, 5 AS column_count, v + t AS total_nulls FROM n
UNION ALL SELECT 'user_id', 'bigint', 0, n, 5, v + t FROM n
UNION ALL SELECT 'ts', 'timestamp_ntz', 0, n, 5, v + t FROM n
UNION ALL SELECT 'value', 'double', v, n, 5, v + t FROM n
UNION ALL SELECT 'event_type', 'string', t, n, 5, v + t FROM n""")
def data_quality(spark, folder):
    return profile.data_quality(gappy_events(spark, folder))


@query("""
WITH c AS (SELECT label::BIGINT AS cluster, count(*) AS rows FROM embeddings GROUP BY 1)
SELECT cluster, rows, round(rows / sum(rows) OVER () * 100, 2) AS percentage, count(*) OVER () AS n_clusters,
       (sum(rows) OVER ())::BIGINT AS n_samples, min(rows) OVER () AS min_cluster_size, max(rows) OVER () AS max_cluster_size,
       round(stddev_pop(rows) OVER (), 2) AS std_cluster_size,
       round(min(rows) OVER () / max(rows) OVER (), 4) AS balance_ratio
FROM c
""")
def cluster_distribution(spark, folder):
    return profile.cluster_distribution(table(spark, folder, "embeddings"), "label")


STATS = """count(*) AS n_samples, round(avg(v)::DECIMAL(30, 12), 6)::DOUBLE + 0.0 AS mean, round(stddev_pop(v), 6) + 0.0 AS std,
 round(min(v), 6) + 0.0 AS min, round(max(v), 6) + 0.0 AS max, round(quantile_cont(v, 0.5), 6) + 0.0 AS median,
 round(quantile_cont(v, 0.25), 6) + 0.0 AS q25, round(quantile_cont(v, 0.75), 6) + 0.0 AS q75"""
NAMES = ["mean", "std", "min", "max", "median", "q25", "q75"]


@query(GAPPY + f"SELECT event_type, {STATS.replace('(v', '(value')} FROM e GROUP BY event_type")
def value_stats(spark, folder):
    rows = gappy_events(spark, folder)
    return rounded(profile.value_stats(rows, "value", ["event_type"]), *NAMES)


@query(f"SELECT {STATS.replace('(v', '(l_extendedprice')} FROM lineitem")
def value_stats_whole_table(spark, folder):
    return rounded(profile.value_stats(table(spark, folder, "lineitem"), "l_extendedprice"), *NAMES)


@query(f"""
WITH p AS (SELECT unnest([l_quantity, l_tax, l_discount, l_extendedprice]) AS v, unnest([0, 0, 1, 1]) AS step,
                  unnest([0, 1, 0, 1]) AS target FROM lineitem)
SELECT target, step, {STATS} FROM p GROUP BY ALL
""")
def prediction_stats(spark, folder):
    """Arrays of two steps with two targets each."""
    steps = F.array(F.array("l_quantity", "l_tax"), F.array("l_discount", "l_extendedprice"))
    scored = table(spark, folder, "lineitem").select(steps.alias("prediction"))
    return rounded(profile.prediction_stats(scored, "prediction"), *NAMES)


@query("""
WITH m AS (SELECT avg(abs(l_discount - l_tax)) AS mae, avg((l_discount - l_tax) ** 2) AS mse,
                  sqrt(avg((l_discount - l_tax) ** 2)) AS rmse FROM lineitem),
     u AS (UNPIVOT m ON mae, mse, rmse INTO NAME metric VALUE value)
SELECT metric, round(value, 6) + 0.0 AS value, (SELECT arg_min(metric, value) FROM u) AS best,
       (SELECT arg_max(metric, value) FROM u) AS worst FROM u
""")
def metric_summary(spark, folder):
    items = table(spark, folder, "lineitem")
    errors = metrics.forecast_metrics(items, [("l_discount", "l_tax")], names=("mae", "mse", "rmse"))
    return rounded(profile.metric_summary(errors), "value")


@query(GAPPY + """SELECT count(*) AS row_count, 5 AS column_count,
  2 * count(*) - count(value) - count(event_type) AS null_count, min(ts) AS min_time, max(ts) AS max_time FROM e""")
def frame_profile(spark, folder):
    return profile.frame_profile(gappy_events(spark, folder), "ts")


@query("""
SELECT count(*) AS row_count, min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size,
       sum(len(embedding))::BIGINT AS elements, 'float' AS element_type FROM embeddings
""")
def array_summary(spark, folder):
    return profile.array_summary(table(spark, folder, "embeddings"), "embedding")
