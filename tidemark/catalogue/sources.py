"""Sources and sinks, exercised on copies that Spark writes below the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, rounded, table
from tidemark.operators import features, metrics, prep
from tidemark.session import scratch_path
from tidemark.sources import readers, views, writers
from tidemark.sources.store import FeatureStore, FeatureView


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_rows(spark, folder):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return readers.read_source(spark, path, schema="c_custkey long, c_name string, c_acctbal double")


@query("SELECT ts AS date, event_id, value FROM events")
def csv_series(spark, folder):
    """The time column comes as text and is parsed."""
    path = scratch_path(spark, "series") + ".csv"
    table(spark, folder, "events").select(
        F.col("ts").cast("string").alias("date"), "event_id", "value").write.option("header", True).csv(path)
    out = readers.read_source(spark, path, "timeseries", schema="date string, event_id long, value double")
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query("""
SELECT 'whole' AS file, count(*) AS rows FROM customer UNION ALL SELECT 'without rows', 0 UNION ALL SELECT 'absent', -1 UNION ALL SELECT 'no time', -2
""")
def csv_edges(spark, folder):
    """A file, one without rows, an absent one, and a series whose time column is missing."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    path = scratch_path(spark, "edges")
    customers.write.option("header", True).csv(f"{path}/whole.csv")
    customers.where("c_custkey is null").write.option("header", True).csv(f"{path}/none.csv")

    def rows(name, kind="tabular"):
        try:
            return readers.read_source(spark, f"{path}/{name}.csv", kind, schema="c_custkey long, c_name string").count()
        except FileNotFoundError:
            return -1
        except ValueError:
            return -2

    found = [("whole", rows("whole")), ("without rows", rows("none")), ("absent", rows("absent")), ("no time", rows("whole", "timeseries"))]
    return spark.createDataFrame(found, "file string, rows long")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def entity_table(spark, folder):
    return readers.read_entities(spark, f"{folder}/orders.parquet", "o_orderkey", "o_orderdate", ["o_totalprice"])


@query("""
SELECT s_suppkey, s_acctbal, unnest(['train', 'val', 'test']) AS dataset FROM supplier
""")
def separate_splits(spark, folder):
    """Without a validation table the test table serves as one."""
    path = f"{folder}/supplier.parquet"
    return readers.read_splits(spark, train_path=path, test_path=path).select("s_suppkey", "s_acctbal", "dataset")


@query("""
SELECT event_id, user_id, ts AS event_timestamp, lag(value, 24) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag24,
       strftime(ts, '%Y-%m-%d') AS event_date
FROM events
""")
def offline_features(spark, folder):
    """Engineered features written by day and read back."""
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").alias("event_timestamp"), "value")
    made = features.lag_features(events, ["value"], [24], ["event_timestamp", "event_id"], ["user_id"])
    path = scratch_path(spark, "features")
    writers.write_features(made.drop("value"), path)
    return spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("string"))


@query("""
WITH f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
     m AS (SELECT e.event_id AS row_id, e.ts, f.ts AS seen, f.value FROM events e ASOF LEFT JOIN f
           ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT row_id, round(CASE WHEN seen >= ts - INTERVAL 1 DAY THEN value END::FLOAT, 3)::DOUBLE AS value FROM m
""")
def stored_view(spark, folder):
    """A view over a written table with day folders; the join reads only the days it needs."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "view")
    writers.write_features(
        events.where("event_type = 'view'").select("user_id", F.col("ts").alias("event_timestamp"), "value"), path)
    store = FeatureStore(spark)
    store.register_entity("user", "user_id", "int")
    store.register_view(FeatureView("stored", ("user",), {"value": "float"}, path, ttl_days=1))
    rows = events.select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("event_timestamp"))
    out = store.historical(rows, ["stored:value"])
    return out.select("row_id", F.round("value", 3).cast("double").alias("value"))


@query("""
WITH f AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'),
     m AS (SELECT e.event_id AS row_id, e.ts, f.ts AS seen, f.value FROM events e ASOF LEFT JOIN f
           ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT row_id, round(CASE WHEN seen >= ts - INTERVAL 30 DAY THEN value END::FLOAT, 3)::DOUBLE AS amount,
       round(CASE WHEN seen >= ts - INTERVAL 30 DAY THEN value / 100 END::FLOAT, 4)::DOUBLE AS risk_score FROM m
""")
def shipped_view(spark, folder):
    """The shipped payments view over a stored table, with the view's own time to live."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "payments")
    writers.write_features(events.where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("event_timestamp"), F.col("value").alias("amount"), (F.col("value") / 10).alias("tx_count_30m"),
        (F.col("value") / 100).alias("risk_score")), path)
    store = FeatureStore(spark)
    views.register(store, views.FRAUD, "user_id", path)
    rows = events.select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("event_timestamp"))
    out = store.historical(rows, ["fraud_view:amount", "fraud_view:risk_score"])
    return out.select("row_id", F.round("amount", 3).cast("double").alias("amount"),
                      F.round("risk_score", 4).cast("double").alias("risk_score"))


@query("""
WITH f AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view'),
     m AS (SELECT e.event_id AS row_id, e.ts, f.ts AS seen, f.value FROM events e ASOF LEFT JOIN f
           ON e.user_id = f.user_id AND e.ts >= f.ts)
SELECT row_id, round(CASE WHEN seen >= ts - INTERVAL 2 DAY THEN value END::FLOAT, 3)::DOUBLE AS value FROM m
""")
def bucketed_view(spark, folder):
    """A view over a table in buckets of the user: the join shuffles the entity rows only."""
    events = table(spark, folder, "events")
    path = scratch_path(spark, "bucketed")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("event_timestamp"), "event_id", "value")
    writers.write_bucketed(views, name, ["user_id"], buckets=16, path=path)
    store = FeatureStore(spark)
    store.register_entity("user", "user_id", "int")
    store.register_view(FeatureView("bucketed", ("user",), {"value": "float"}, f"table://{name}", ttl_days=2,
                                    tie=("event_id",), buckets=16))
    rows = events.select(F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("event_timestamp"))
    out = store.historical(rows, ["bucketed:value"])
    return out.select("row_id", F.round("value", 3).cast("double").alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 6) + 0.0 AS prediction FROM lineitem")
def prediction_table(spark, folder):
    items = table(spark, folder, "lineitem").withColumn("prediction", F.col("l_quantity") * 2)
    path = scratch_path(spark, "predictions")
    writers.write_predictions(items, path, ["l_orderkey", "l_linenumber"])
    schema = "l_orderkey long, l_linenumber int, prediction double"
    return rounded(spark.read.schema(schema).option("header", True).csv(path), "prediction")


@query("""
WITH c AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS code
           FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) + 0.0 AS o_totalprice,
       code AS o_orderpriority
FROM orders JOIN c ON o_orderpriority = p
""")
def saved_state(spark, folder):
    """Fitted, saved, loaded and applied."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    steps = [{"name": "fill_missing", "columns": ["o_totalprice"]}, {"name": "label_encoding", "columns": ["o_orderpriority"]},
             {"name": "normalize", "columns": ["o_totalprice"]}]
    path = scratch_path(spark, "state")
    writers.save_state(prep.fit(orders, steps), spark, path)
    return rounded(prep.apply(orders, writers.load_state(spark, path), steps), "o_totalprice")


@query("""
WITH m AS (SELECT avg(abs(l_discount - l_tax)) AS mae, avg((l_discount - l_tax) ** 2) AS mse FROM lineitem)
SELECT 'first' AS run, 3::BIGINT AS step, metric, round(value, 6) + 0.0 AS value
FROM (UNPIVOT m ON mae, mse INTO NAME metric VALUE value)
""")
def metric_table(spark, folder):
    """Appended metrics; values that are not finite are left out."""
    items = table(spark, folder, "lineitem")
    errors = metrics.forecast_metrics(items, [("l_discount", "l_tax")], names=("mae", "mse"))
    broken = items.agg((F.count(F.lit(1)) * float("inf")).alias("value")).select(F.lit("broken").alias("metric"), "value")
    path = scratch_path(spark, "metrics")
    writers.write_metrics(errors.unionByName(broken), path, "first", 3)
    return rounded(spark.read.parquet(path), "value")
