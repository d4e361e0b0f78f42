from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources import views
from tidemark.sources.store import DEFAULT_IDS, FeatureStore, FeatureView

NOW = datetime(2024, 3, 10, 12)


def at(days=0, hours=0):
    return NOW - timedelta(days=days, hours=hours)


@pytest.fixture()
def stats(spark):
    rows = [(101, at(5), 600.0, 1), (101, at(1), 750.0, 1), (102, at(2), 800.0, 0)]
    return spark.createDataFrame(rows, "user_id long, event_timestamp timestamp_ntz, credit_score double, is_active long")


@pytest.fixture()
def store(spark, stats):
    store = FeatureStore(spark)
    store.register_entity("user", "user_id", "int")
    store.register_view(FeatureView("user_stats", ("user",), {"credit_score": "float", "is_active": "int"}, ttl_days=30), stats)
    return store


def people(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_timestamp timestamp_ntz")


def test_known_at_the_time(spark, store):
    out = store.historical(people(spark, [(101, at(4)), (999, at(4)), (None, at(4)), (101, None)]), ["user_stats:credit_score"])
    assert {(r["user_id"], r["event_timestamp"]): r["credit_score"] for r in out.collect()} == {
        (101, at(4)): 600.0, (999, at(4)): None, (None, at(4)): None, (101, None): None}


def test_bounds_are_inclusive(spark, stats):
    rows = people(spark, [(101, at(5)), (101, at(5) - timedelta(microseconds=1)), (102, at(2) + timedelta(days=3)),
                          (102, at(2) + timedelta(days=3, microseconds=1))])
    out = asof.pit_join(rows, stats.withColumnRenamed("event_timestamp", "f"), ["user_id"], "event_timestamp", "f",
                        ["credit_score"], ttl=timedelta(days=3), matched_time="seen")
    got = {(r["user_id"], r["event_timestamp"]): (r["credit_score"], r["seen"]) for r in out.collect()}
    assert got[(101, at(5))] == (600.0, at(5))
    assert got[(101, at(5) - timedelta(microseconds=1))] == (None, None)
    assert got[(102, at(2) + timedelta(days=3))] == (800.0, at(2))
    assert got[(102, at(2) + timedelta(days=3, microseconds=1))] == (None, None)


def test_matched_null_is_null_and_larger_tie_wins(spark):
    features = spark.createDataFrame(
        [(1, at(2), 1, 5.0), (1, at(1), 1, 7.0), (1, at(1), 2, None)], "k long, f timestamp_ntz, n int, v double")
    rows = spark.createDataFrame([(1, at(0)), (1, at(1, 1))], "k long, t timestamp_ntz")
    out = asof.pit_join(rows, features, ["k"], "t", "f", ["v", "n"], tie=["n"])
    assert {r["t"]: (r["v"], r["n"]) for r in out.collect()} == {at(0): (None, 2), at(1, 1): (5.0, 1)}


@pytest.mark.parametrize("max_rows", [None, 30, 4])
def test_against_all_pairs(spark, max_rows):
    """Skewed keys and heavy equal times; brute force in SQL over all pairs."""
    make = lambda n, salt: spark.range(n).select(
        F.when(F.hash("id", F.lit(salt)) % 3 == 0, 0).otherwise(F.pmod(F.hash("id", F.lit(salt + 1)), F.lit(5))).alias("k"),
        F.when(F.hash("id", F.lit(salt + 2)) % 4 == 0, 500).otherwise(F.pmod(F.hash("id", F.lit(salt + 3)), F.lit(1000))).alias("t"),
        F.col("id").alias(f"i{salt}"))
    entities, features = make(400, 10), make(300, 20).withColumnRenamed("t", "f").withColumnRenamed("i20", "v")
    out = asof.pit_join(entities, features, ["k"], "t", "f", ["v"], tie=["v"], prune=False, max_rows=max_rows)
    entities.createOrReplaceTempView("pit_e")
    features.createOrReplaceTempView("pit_f")
    want = spark.sql("""SELECT e.k, e.t, e.i10, max_by(f.v, struct(f.f, f.v)) AS v
                        FROM pit_e e LEFT JOIN pit_f f ON e.k = f.k AND f.f <= e.t GROUP BY e.k, e.t, e.i10""")
    shape = lambda df: sorted(map(str, df.select("k", "t", "i10", "v").collect()))
    assert shape(out) == shape(want)


def test_materialize_and_lookup(spark, store):
    store.materialize("user_stats", "2024-01-01", "2024-12-31")
    wanted = spark.createDataFrame([(101,), (102,), (999,)], "user_id long")
    references = ["user_stats:credit_score", "user_stats:is_active"]
    out = store.online(wanted, references, as_of=at())
    assert {r["user_id"]: (r["credit_score"], r["is_active"]) for r in out.collect()} == {
        101: (750.0, 1), 102: (800.0, 0), 999: (None, None)}
    # Without a time the view's time to live counts from now, so old rows are expired.
    assert {r["credit_score"] for r in store.online(wanted, references).collect()} == {None}
    late = store.online(spark.createDataFrame([(101,)], "user_id long"), ["user_stats:credit_score"], as_of=at(-30))
    assert late.first()["credit_score"] is None


def test_materialized_table_on_disk(spark, store, tmp_path):
    store.path = str(tmp_path)
    store.materialize("user_stats", str(at(6)), str(at(1, 12)))
    again = FeatureStore(spark, str(tmp_path))
    again.entities, again.views = store.entities, store.views
    got = {r["user_id"]: r["credit_score"] for r in again.online_rows([101, 102], ["user_stats:credit_score"], "user_id", at()).collect()}
    assert got == {101: 600.0, 102: 800.0}
    # A stream of feature rows continues the same table; its older rows replace nothing.
    newer = spark.createDataFrame([(101, at(0), 640.0, 0), (102, at(9), 1.0, 1)], store.table("user_stats").schema.names[:2] + ["credit_score", "is_active"])
    newer = newer.select("user_id", F.col("event_timestamp").cast("timestamp_ntz").alias("event_timestamp"),
                         F.col("credit_score").cast("float").alias("credit_score"), "is_active")
    newer.write.parquet(str(tmp_path / "new"))
    rows = spark.readStream.schema(newer.schema).parquet(str(tmp_path / "new"))
    store.materialize_stream("user_stats", rows, str(tmp_path / "c")).awaitTermination()
    got = {r["user_id"]: r["credit_score"] for r in again.online_rows([101, 102], ["user_stats:credit_score"], "user_id", at()).collect()}
    assert got == {101: 640.0, 102: 800.0}


def test_ranges_add_up(spark, store, tmp_path):
    """A later range keeps the keys that only an earlier one has seen, in memory and on disk."""
    for path in (None, str(tmp_path)):
        store.path, store._latest = path, {}
        store.materialize("user_stats", str(at(3)), str(at(2)))
        store.materialize("user_stats", str(at(1)), str(at(0)))
        got = {r["user_id"]: r["credit_score"] for r in store.latest("user_stats").collect()}
        assert got == {101: 750.0, 102: 800.0}
        store.materialize("user_stats", str(at(6)), str(at(4)))  # older rows replace nothing
        assert {r["user_id"]: r["credit_score"] for r in store.latest("user_stats").collect()} == got
    store.compact("user_stats")
    assert {r["user_id"]: r["credit_score"] for r in store.latest("user_stats").collect()} == got
    online = dict(view="user_stats", features=["credit_score"], kind="tabular", mode="online", key="user_id", ids=[101])
    assert store.load(**online, time_point=str(at())).first()["credit_score"] == 750.0
    assert store.load(**online).first()["credit_score"] is None


def test_a_business_date_is_no_filter(spark):
    entities = spark.createDataFrame([(1, at(2))], "k int, t timestamp_ntz")
    features = spark.createDataFrame([(1, at(3), 5, at(0).date())], "k int, f timestamp_ntz, v int, event_date date")
    assert asof.pit_join(entities, features, ["k"], "t", "f", ["v"]).first()["v"] == 5


def test_range_checks(spark, store, stats):
    with pytest.raises(ValueError):
        store.materialize("user_stats", "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        asof.time_range(stats, "absent")
    with pytest.raises(ValueError):
        asof.time_range(stats.where("false"))
    assert asof.time_range(stats) == (at(5), at(1))


def test_grids(spark, store):
    grid = store.sequence_by_range(["user_stats:credit_score"], at(1, 2), at(1), ids=[101, 102], key="user_id")
    assert [(r["user_id"], r["event_timestamp"]) for r in grid.collect()] == [
        (u, at(1, h)) for u in (101, 102) for h in (2, 1, 0)]
    last = store.latest_sequence(["user_stats:credit_score"], 3, 2, [101], "user_id", "2024-03-10T14:00:00+02:00")
    assert [r["event_timestamp"] for r in last.collect()] == [at(0, 4), at(0, 2), at(0)]
    one = store.latest_sequence_of(["user_stats:credit_score"], 2, 102, "user_id", time_point=at())
    assert [r["credit_score"] for r in one.collect()] == [800.0, 800.0]
    assert asof.resolve_time_point("now", datetime(2024, 5, 5, 7, 59, 3)) == datetime(2024, 5, 5, 7)


def test_online_sequence_falls_back(store):
    found = store.online_sequence(["user_stats:credit_score"], 2, 12, [101], "user_id", "2030-01-01", "2024-03-09T12:00:00")
    rows = found.collect()
    assert len(rows) == 4
    assert rows[-1]["event_timestamp"] == at(1) and rows[-1]["credit_score"] == 750.0


def test_facade(spark, store, tmp_path):
    series = store.load("user_stats", ["credit_score"], key="user_id", ids=[101, 102], start=str(at(0, 1)), end=str(at()))
    assert {r["user_id"] for r in series.collect()} == {101}  # a series request uses the first id
    labelled = people(spark, [(102, at(1))]).withColumn("label", F.lit(1))
    labelled.write.parquet(str(tmp_path / "e.parquet"))
    rows = store.load("user_stats", ["credit_score"], "tabular", key="user_id", entity_path=str(tmp_path / "e.parquet"), targets=["label"])
    assert [tuple(r) for r in rows.collect()] == [(102, at(1), 1, 800.0)]
    for bad in (dict(view="", features=["x"]), dict(view="user_stats", features=[]), dict(view="other", features=["x"], start="2024-01-01", end="2024-01-02"),
                dict(view="user_stats", features=["credit_score"], mode="other"), dict(view="user_stats", features=["credit_score"])):
        with pytest.raises(ValueError):
            store.load(**bad)
    assert DEFAULT_IDS == (1, 2, 3, 4)


def test_shipped_views(spark):
    store = FeatureStore(spark)
    for view in views.VIEWS:
        views.register(store, view, "k", "somewhere")
    assert [v.ttl_days for v in views.VIEWS] == [365, 7, 30, 2, 1, None]
    assert store.view("etth1_features").schema["hour_sin"] == "float" and len(store.view("etth1_features").schema) == 11
    with pytest.raises(ValueError):
        views.register(store, views.FRAUD, "", "somewhere")


def test_a_bucketed_view_stays_where_it_is(spark, tmp_path):
    import uuid
    from contextlib import redirect_stdout
    from io import StringIO

    from tidemark.sources.writers import write_bucketed

    name = f"bucketed_{uuid.uuid4().hex}"
    rows = spark.range(600).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 100).alias("t"))
    write_bucketed(rows, name, ["k"], "t", 4, str(tmp_path / "b"))
    entities = rows.select("k", F.col("t").alias("at"), F.col("n").alias("row")).where("n % 5 = 0")
    side = lambda buckets: asof.FeatureSide(spark.table(name), "t", {"v": "n"}, 3000.0, ("n",), buckets=buckets)
    with_buckets = asof.pit_join_all(entities, [side(4), side(4)], ["k"], "at", prune=False)
    plan = StringIO()
    with redirect_stdout(plan):
        with_buckets.explain()
    scan = plan.getvalue().split("Union")[1]
    assert "SelectedBucketsCount" in scan and "Exchange" not in scan.split("\n", 3)[3].split("FileScan")[1]
    assert plan.getvalue().count("Exchange hashpartitioning(k") == 1
    plain = asof.pit_join_all(entities, [side(None), side(None)], ["k"], "at")
    assert sorted(map(tuple, with_buckets.collect())) == sorted(map(tuple, plain.collect()))
    # A long series is still cut into chunks.
    chunked = asof.pit_join_all(entities, [side(4)], ["k"], "at", max_rows=50)
    assert sorted(map(tuple, chunked.collect())) == sorted(
        tuple(r) for r in asof.pit_join_all(entities, [side(None)], ["k"], "at").collect())
