"""Aligning and composing feature sources by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import compose, windows


def customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey")


def suppliers(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")


def nations(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", "n_name")


BOTH = """WITH b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),
a AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS m FROM supplier)
"""


def aligned(spark, folder, method, family="tile"):
    return compose.align(
        customers(spark, folder), suppliers(spark, folder), ["c_custkey"], ["s_suppkey"],
        ["s_suppkey", "s_acctbal"], method, family)


@query(BOTH + "SELECT c_custkey, s_suppkey, s_acctbal FROM b JOIN a ON a.r = b.r % a.m")
def align_tile(spark, folder):
    return aligned(spark, folder, "auto")


@query(BOTH + "SELECT c_custkey, s_suppkey, s_acctbal FROM b JOIN a ON a.r = b.r // (b.n // a.m)")
def align_spread(spark, folder):
    return aligned(spark, folder, "auto", "spread")


@query(BOTH + "SELECT c_custkey, s_suppkey, s_acctbal FROM b JOIN a ON a.r = greatest(b.r - (b.n - a.m), 0)")
def align_pad_start(spark, folder):
    return aligned(spark, folder, "pad_start")


@query(BOTH + "SELECT c_custkey, s_suppkey, s_acctbal FROM b JOIN a ON a.r = least(b.r, a.m - 1)")
def align_pad_end(spark, folder):
    return aligned(spark, folder, "pad_end", "spread")


@query("""
WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier),
     a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT s_suppkey, c_custkey FROM b JOIN a USING (r)
""")
def align_pad_start_longer(spark, folder):
    """A source that is longer than the base gives its first rows."""
    return compose.align(
        suppliers(spark, folder).select("s_suppkey"), customers(spark, folder), ["s_suppkey"], ["c_custkey"],
        ["c_custkey"], "pad_start")


@query("""
SELECT c_custkey, c_nationkey, r_name AS p_r_name_0, r_name AS p_r_name_1, n_name AS q_n_name_0, n_name AS q_n_name_1
FROM customer, (SELECT min(r_name) AS r_name FROM region), (SELECT max(n_name) AS n_name FROM nation)
""")
def compose_spread_wide(spark, folder):
    """Single columns and rows stretched to the width and length of the base."""
    base = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    low = table(spark, folder, "region").agg(F.min("r_name").alias("r_name"))
    high = table(spark, folder, "nation").agg(F.max("n_name").alias("n_name"))
    return compose.compose(base, {"p": (low, ["r_name"], ["r_name"]), "q": (high, ["n_name"], ["n_name"])},
                           ["c_custkey"], family="spread")[0]


@query("""
WITH b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier),
     a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT s_suppkey, c_custkey FROM b JOIN a USING (r)
""")
def align_truncate(spark, folder):
    return compose.align(
        suppliers(spark, folder).select("s_suppkey"), customers(spark, folder), ["s_suppkey"], ["c_custkey"],
        ["c_custkey"])


@query("SELECT c_custkey, (SELECT avg(s_acctbal) FROM supplier)::FLOAT::DOUBLE AS mean_balance FROM customer")
def align_broadcast(spark, folder):
    one = suppliers(spark, folder).agg(F.avg("s_acctbal").cast("float").cast("double").alias("mean_balance"))
    one = one.withColumn("at", F.lit(0))
    return compose.align(customers(spark, folder), one, ["c_custkey"], ["at"], ["mean_balance"])


@query("""
WITH b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer),
     a AS (SELECT s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS m FROM supplier),
     k AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r, count(*) OVER () AS m FROM nation)
SELECT b.c_custkey, a.s_acctbal AS supplier_s_acctbal, k.n_name AS nation_n_name
FROM b JOIN a ON a.r = CASE WHEN b.n % a.m = 0 THEN b.r % a.m ELSE greatest(b.r - (b.n - a.m), 0) END
       JOIN k ON k.r = CASE WHEN b.n % k.m = 0 THEN b.r % k.m ELSE greatest(b.r - (b.n - k.m), 0) END
""")
def compose_sources(spark, folder):
    out, _ = compose.compose(customers(spark, folder), {
        "supplier": (suppliers(spark, folder), ["s_suppkey"], ["s_acctbal"]),
        "nation": (nations(spark, folder), ["n_nationkey"], ["n_name"]),
    }, ["c_custkey"])
    return out


@query("""
SELECT s_suppkey, s_nationkey, n_name AS nation_n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def compose_by_key(spark, folder):
    base = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    nation = nations(spark, folder).withColumnRenamed("n_nationkey", "s_nationkey")
    return compose.join_features(base, {"nation": nation}, ["s_nationkey"])


@query("""
SELECT vec_id, """ + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e_{i}" for i in range(64)) + """ FROM embeddings
""")
def array_to_columns(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return vectors.select("vec_id", *compose.array_columns("e", 64, "e"))


@query("""
WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(value) FILTER (r = 3) AS w_s0_f0, max(value) FILTER (r = 2) AS w_s1_f0,
       max(value) FILTER (r = 1) AS w_s2_f0
FROM e WHERE n >= 3 GROUP BY user_id
""")
def window_to_columns(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    frame = windows.edge_window(events, ["value"], ["ts", "event_id"], 3, ["user_id"])
    return frame.select("user_id", *compose.array_columns("x", (3, 1), "w"))


@query("""
WITH e AS (SELECT event_id, user_id, value, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     p AS (SELECT a.user_id, a.r, max(b.value) AS p FROM e a JOIN e b
             ON a.user_id = b.user_id AND b.r > a.r - 4 AND b.r <= a.r
           WHERE a.r >= 3 AND a.r + 2 < a.n GROUP BY a.user_id, a.r, a.n)
SELECT e.event_id, coalesce(first_value(p.p IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.r
                              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                            last_value(p.p IGNORE NULLS) OVER (PARTITION BY e.user_id ORDER BY e.r
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS prediction
FROM e LEFT JOIN p ON e.user_id = p.user_id AND e.r = p.r
""")
def prediction_as_feature(spark, folder):
    """The window maximum stands in for a model; it is put back on the rows it belongs to."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    frame = windows.supervised_windows(events, ["value"], ["value"], ["ts", "event_id"], 4, 2, ["user_id"])
    scored = frame.select("user_id", "window_index", F.array_max(windows.flat("x")).alias("prediction"))
    out = compose.predictions_as_feature(events, scored, ["ts", "event_id"], 4, keys=["user_id"])
    return out.select("event_id", "prediction")
