"""Fit and apply."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, rounded, table
from tidemark.operators import prep, split


def gappy_events(spark, folder):
    """Events whose value is missing for errors, and whose type is missing for clicks."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", "ts",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"))


GAPPY = """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value,
  CASE WHEN event_type <> 'click' THEN event_type END AS event_type FROM events)
"""


@query(GAPPY + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) + 0.0 AS value FROM e")
def fill_mean(spark, folder):
    rows, steps = gappy_events(spark, folder), [{"name": "fill_missing", "method": "mean", "columns": ["value"]}]
    return rounded(prep.apply(rows, prep.fit(rows, steps), steps).select("event_id", "value"), "value")


@query(GAPPY + """SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 6) + 0.0 AS value
FROM e""")
def fill_median(spark, folder):
    rows, steps = gappy_events(spark, folder), [{"name": "fill_missing", "method": "median", "columns": ["value"]}]
    return rounded(prep.apply(rows, prep.fit(rows, steps), steps).select("event_id", "value"), "value")


@query(GAPPY + """SELECT event_id,
  coalesce(value, (SELECT value FROM e WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value,
  coalesce(event_type, (SELECT event_type FROM e WHERE event_type IS NOT NULL
                        GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type
FROM e""")
def fill_mode(spark, folder):
    rows = gappy_events(spark, folder)
    steps = [{"name": "fill_missing", "method": "mode", "columns": ["value", "event_type"]}]
    return prep.apply(rows, prep.fit(rows, steps), steps).select("event_id", "value", "event_type")


@query(GAPPY + """SELECT event_id,
  coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM e""")
def fill_both_ways(spark, folder):
    rows, steps = gappy_events(spark, folder), [{"name": "fill_missing", "method": "ffill", "columns": ["value"]}]
    out = prep.apply(rows, prep.FittedState(), steps, ["ts", "event_id"], ["user_id"])
    return out.select("event_id", "value")


@query(GAPPY + """SELECT event_id,
  coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
FROM e""")
def fill_whole_table(spark, folder):
    rows, steps = gappy_events(spark, folder), [{"name": "fill_missing", "method": "ffill", "columns": ["value"]}]
    return prep.apply(rows, prep.FittedState(), steps, ["ts", "event_id"]).select("event_id", "value")


@query(GAPPY + """, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
  FROM (SELECT DISTINCT event_type FROM e WHERE event_type IS NOT NULL))
SELECT e.event_id, c.code::DOUBLE AS event_type FROM e LEFT JOIN c ON e.event_type = c.event_type""")
def label_encode(spark, folder):
    rows, steps = gappy_events(spark, folder), [{"name": "label_encoding", "columns": ["event_type"]}]
    out = prep.apply(rows, prep.fit(rows, steps), steps)
    return out.select("event_id", F.col("event_type").cast("double").alias("event_type"))


@query(GAPPY + """, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
  FROM (SELECT DISTINCT event_type FROM e WHERE event_type IS NOT NULL AND event_type <> 'view'))
SELECT e.event_id, CASE WHEN e.event_type IS NOT NULL THEN coalesce(c.code, 0)::DOUBLE END AS event_type
FROM e LEFT JOIN c ON e.event_type = c.event_type""")
def label_encode_unseen(spark, folder):
    """Fitted without views: the unseen class takes code 0, null stays null."""
    rows, steps = gappy_events(spark, folder), [{"name": "label_encoding", "columns": ["event_type"]}]
    state = prep.fit(rows.where("event_type <> 'view' OR event_type IS NULL"), steps)
    out = prep.apply(rows, state, steps)
    return out.select("event_id", F.col("event_type").cast("double").alias("event_type"))


@query("""
SELECT l_orderkey, l_linenumber,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) + 0.0 AS l_quantity,
       round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) + 0.0
         AS l_extendedprice
FROM lineitem
""")
def scale_zscore(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    steps = [{"name": "normalize", "method": "zscore", "columns": ["l_quantity", "l_extendedprice"]}]
    return rounded(prep.apply(items, prep.fit(items, steps), steps), "l_quantity", "l_extendedprice")


@query("""
SELECT l_orderkey, l_linenumber,
       round((l_extendedprice - min(l_extendedprice) OVER ())
             / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) + 0.0 AS l_extendedprice,
       0.0::DOUBLE AS constant
FROM lineitem
""")
def scale_minmax(spark, folder):
    """A constant column has no width and is divided by 1."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.lit(7.0).alias("constant"))
    steps = [{"name": "normalize", "method": "minmax", "columns": ["l_extendedprice", "constant"]}]
    return rounded(prep.apply(items, prep.fit(items, steps), steps), "l_extendedprice", "constant")


@query("""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linestatus = 'O' THEN greatest(10, least(40, l_quantity)) END AS clipped,
       round(ln(l_extendedprice + 1), 6) + 0.0 AS logged,
       round(abs(l_quantity - 25), 6) + 0.0 AS absolute,
       round_even(l_quantity / 2, 0) AS halved,
       CASE WHEN l_linestatus = 'O' AND l_quantity > 30 THEN 1 ELSE 0 END AS flagged,
       round(exp(-2 * l_discount), 6) + 0.0 AS decayed,
       round(l_tax * 3 + 1, 6) + 0.0 AS applied
FROM lineitem
""")
def stateless_chain(spark, folder):
    quantity = F.col("l_quantity")
    open_quantity = F.when(F.col("l_linestatus") == "O", quantity)
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", open_quantity.alias("clipped"), F.col("l_extendedprice").alias("logged"),
        (quantity - 25).alias("absolute"), (quantity / 2).alias("halved"), open_quantity.alias("flagged"),
        F.col("l_discount").alias("decayed"), F.col("l_tax").alias("applied"))
    steps = [
        {"name": "clip", "columns": ["clipped"], "min": 10, "max": 40},
        {"name": "log", "columns": ["logged"], "offset": 1.0},
        {"name": "abs", "columns": ["absolute"]},
        {"name": "round", "columns": ["halved"], "decimals": 0},
        {"name": "binary", "columns": ["flagged"], "threshold": 30.0},
        {"name": "exponential", "columns": ["decayed"], "scale": -2.0},
        {"name": "udf", "columns": ["applied"], "func": lambda c: c * 3 + 1},
    ]
    out = prep.apply(items, prep.FittedState(), steps)
    return rounded(out, "logged", "absolute", "decayed", "applied")


RANDOM_TAG = """WITH n AS (SELECT count(*) AS n FROM orders),
t AS (SELECT *, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train'
              WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS dataset
      FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) AS r FROM orders), n)
"""


@query(RANDOM_TAG + """, s AS (SELECT avg(ln(o_totalprice)) AS m, stddev_pop(ln(o_totalprice)) AS d FROM t WHERE dataset = 'train'),
c AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
      FROM (SELECT DISTINCT o_orderpriority FROM t WHERE dataset = 'train'))
SELECT o_orderkey, dataset, round((ln(o_totalprice) - s.m) / s.d, 6) + 0.0 AS o_totalprice,
       CASE WHEN p IS NULL THEN 0 ELSE code END AS o_orderpriority
FROM t CROSS JOIN s LEFT JOIN c ON t.o_orderpriority = c.p""")
def fit_train_apply_all(spark, folder):
    """Statistics come from the training rows after the log step; all rows are transformed."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    steps = [
        {"name": "log", "columns": ["o_totalprice"]},
        {"name": "label_encoding", "columns": ["o_orderpriority"]},
        {"name": "normalize", "columns": ["o_totalprice"]},
    ]
    out, _ = prep.fit_apply(split.random_split(orders, ["o_orderkey"]), steps)
    return rounded(out, "o_totalprice")


@query("""
SELECT o_orderkey, o_totalprice AS target,
       round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0 AS scaled
FROM orders
""")
def keep_raw_targets(spark, folder):
    price = F.col("o_totalprice")
    orders = table(spark, folder, "orders").select("o_orderkey", price.alias("target"), price.alias("scaled"))
    steps = [{"name": "normalize", "columns": ["target", "scaled"]}]
    return rounded(prep.apply(orders, prep.fit(orders, steps), steps, keep_raw=["target"]), "scaled")


@query(GAPPY + """, c AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code
  FROM (SELECT DISTINCT event_type FROM e WHERE event_type IS NOT NULL))
SELECT 'class' AS kind, 'event_type' AS "column", code::VARCHAR AS detail, event_type AS value FROM c WHERE code < 5
UNION ALL SELECT 'classes', 'event_type', 'count', count(*)::VARCHAR FROM c
UNION ALL (SELECT 'fill', 'event_type', 'mode', event_type FROM e WHERE event_type IS NOT NULL
           GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)""")
def fitted_report(spark, folder):
    steps = [{"name": "fill_missing", "method": "mode", "columns": ["event_type"]},
             {"name": "label_encoding", "columns": ["event_type"]}]
    return prep.report(prep.fit(gappy_events(spark, folder), steps), spark)


@query(GAPPY + "SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 6) + 0.0 AS value FROM e")
def imputer_mean(spark, folder):
    return rounded(prep.impute(gappy_events(spark, folder).select("event_id", "value"), ["value"]), "value")


@query(GAPPY + """SELECT event_id, coalesce(value,
  (SELECT value FROM e WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)) AS value FROM e""")
def imputer_most_frequent(spark, folder):
    return prep.impute(gappy_events(spark, folder).select("event_id", "value"), ["value"], "most_frequent")


@query(GAPPY + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) + 0.0 AS value FROM e")
def imputer_median(spark, folder):
    return rounded(prep.impute(gappy_events(spark, folder).select("event_id", "value"), ["value"], "median"), "value")


@query("SELECT l_discount, l_orderkey, l_quantity FROM lineitem")
def select_sorted(spark, folder):
    return prep.select_columns(
        table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "absent"], ["l_orderkey", "l_quantity"])
