import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, windows
from tidemark.plans import training
from tidemark.streaming import materialize, scoring


@pytest.fixture()
def rows(spark):
    return spark.range(90).select(
        (F.col("id") % 4).alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60)").alias("t"),
        F.col("id").alias("n"), (F.col("id") * 1.5).alias("v"))


def feed(spark, rows, path, parts):
    """Write the rows as files that the stream takes one per batch."""
    for i, condition in enumerate(parts):
        rows.where(condition).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def shape(df):
    return sorted(map(tuple, df.collect()))


def test_latest_table_matches_the_batch_twin(spark, rows, tmp_path):
    # The newest rows come first: older rows that follow must not replace them.
    stream = feed(spark, rows, str(tmp_path / "in"), ["n >= 60", "n < 30", "n >= 30 and n < 60"])
    out = str(tmp_path / "out")
    job = materialize.materialize_stream(stream, out, str(tmp_path / "c"), ["k"], "t", ["n", "v"], ["n"])
    job.awaitTermination()
    want = shape(asof.latest_rows(rows, ["k"], "t", ["n", "v"], ["n"]))
    latest = lambda: shape(materialize.read_latest(spark, out, ["k"], "t", ["n", "v"], ["n"]))
    assert latest() == want
    # A stream with a new checkpoint has folders of its own, also when it sees only other keys.
    few = feed(spark, rows.where("k = 1").withColumn("k", F.lit(77).cast("long")), str(tmp_path / "more"), ["n >= 0"])
    materialize.materialize_stream(few, out, str(tmp_path / "c3"), ["k"], "t", ["n", "v"], ["n"]).awaitTermination()
    assert {r[0] for r in latest()} == {0, 1, 2, 3, 77}
    want = latest()
    again = materialize.materialize_stream(stream, out, str(tmp_path / "c2"), ["k"], "t", ["n", "v"], ["n"])
    again.awaitTermination()
    assert latest() == want
    materialize.compact(spark, out, ["k"], "t", ["n", "v"], ["n"])
    assert latest() == want
    assert len(materialize.latest_table(spark, out, ["k"], "t", ["n", "v"], ["n"]).manifest()["runs"]) == 1
    materialize.compact(spark, out, ["k"], "t", ["n", "v"], ["n"])
    assert latest() == want


def test_windows_of_several_batches_and_their_scores(spark, rows, tmp_path):
    # Batches out of order, one busy entity, and ties that differ only beyond 2**53.
    busy = rows.unionByName(rows.select(F.lit(0).cast("long").alias("k"), "t", (F.col("n") + 2**53).alias("n"), (-F.col("v")).alias("v")))
    parts = ["n >= 40 and n < 2e9", "n < 20", "n >= 20 and n < 40", "n >= 2e9 and n % 2 = 0", "n >= 2e9 and n % 2 = 1"]
    stream = feed(spark, busy, str(tmp_path / "in"), parts)
    frame = windows.supervised_windows(busy, ["v"], ["v"], ["t", "n"], 5, 1, ["k"])
    model = training.fit_forecaster(frame, 1, 1, "linear")
    path, out = str(tmp_path / "rows"), str(tmp_path / "out")
    scoring.score_stream(stream, model, path, out, str(tmp_path / "c"), "k", ["t", "n"], ["v"], 5).awaitTermination()
    want = windows.edge_window(busy, ["v"], ["t", "n"], 5, ["k"])
    assert shape(scoring.last_windows(spark, path, "k", ["t", "n"], ["v"], 5)) == shape(want)
    scored = {r["k"]: r["prediction"][0] for r in model.transform(training.window_features(want)).collect()}
    assert {r["k"]: r["predictions"][0] for r in scoring.newest_scores(spark, out, "k").collect()} == pytest.approx(scored, rel=1e-5)
    again = feed(spark, rows.where("k = 1").withColumn("k", F.lit(50).cast("long")), str(tmp_path / "in2"), ["n >= 0"])
    scoring.keep_newest(again, path, str(tmp_path / "c2"), "k", ["t", "n"], ["v"], 5).awaitTermination()
    assert {r["k"] for r in scoring.last_windows(spark, path, "k", ["t", "n"], ["v"], 5).collect()} == {0, 1, 2, 3, 50}


def batches(rows, count):
    return [rows.where((F.col("n") * 7) % count == i) for i in range(count)]


def test_runs_are_merged_level_by_level(spark, rows, tmp_path):
    table = materialize.latest_table(spark, str(tmp_path / "t"), ["k"], "t", ["n", "v"], ["n"], buckets=3, fanout=3)
    with pytest.raises(ValueError):
        table.read()
    most = 0
    for i, batch in enumerate(batches(rows, 11)):
        assert table.append(batch, "feed", i)
        assert not table.append(batch, "feed", i)  # a repeated batch
        most = max(most, len(table.manifest()["runs"]))
    levels = [r["level"] for r in table.manifest()["runs"]]
    assert most <= 5 and max(levels) == 2 and all(levels.count(x) < 3 for x in levels)
    want = shape(asof.latest_rows(rows, ["k"], "t", ["n", "v"], ["n"]))
    columns = ["k", "t", "n", "v"]
    assert shape(table.read().select(columns)) == want
    # Another number of buckets in the code does not change the table's.
    again = materialize.latest_table(spark, str(tmp_path / "t"), ["k"], "t", ["n", "v"], ["n"], buckets=50)
    again.append(rows.limit(0), "feed", 11)
    assert again.manifest()["buckets"] == 3 and shape(again.read().select(columns)) == want


def test_readers_and_writers_do_not_disturb_each_other(spark, rows, tmp_path):
    make = lambda **options: materialize.latest_table(spark, str(tmp_path / "t"), ["k"], "t", ["n", "v"], ["n"], **options)
    table = make(fanout=100)
    for batch in batches(rows, 4):
        table.append(batch)
    planned, want = table.read(), shape(table.read())
    table.compact()
    # The files of the merged runs are still there for the reader that was planned before.
    assert shape(planned) == want == shape(table.read())
    folders = lambda: {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert len(folders()) == 5
    make(grace=0.0).append(rows.limit(0))
    assert {f"data/{f}" for f in folders()} == {r["folder"] for r in table.manifest()["runs"]} | {
        f"data/{f}" for f in folders() if not any((tmp_path / "t" / "data" / f).glob("tidemark_bucket=*"))}
    # A write that fails leaves the table as it was.
    broken = rows.withColumn("v", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        table.append(broken)
    assert shape(table.read()) == want
    # A writer that was overtaken puts its run on top of the other's.
    first, create, others = make(), table.files.create, [rows.limit(1).withColumn("k", F.lit(-5).cast("long"))]

    def overtaken(name, text):
        if others:
            first.append(others.pop())
        return create(name, text)

    table.files.create = overtaken
    assert table.append(rows.limit(1).withColumn("k", F.lit(-6).cast("long")))
    assert {r["k"] for r in table.read().collect()} == {0, 1, 2, 3, -5, -6}


def test_equal_rows_of_later_runs_win(spark, rows, tmp_path):
    table = materialize.latest_table(spark, str(tmp_path / "t"), ["k"], "t", ["n", "v"], ["n"], fanout=2)
    for factor in (1, 2, 3):
        table.append(rows.withColumn("v", F.col("v") * factor))
        want = asof.latest_rows(rows.withColumn("v", F.col("v") * factor), ["k"], "t", ["n", "v"], ["n"])
        assert shape(table.read().select("k", "t", "n", "v")) == shape(want)


def test_only_touched_buckets_are_read(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 200).alias("k"), F.col("id").alias("n"), (F.col("id") * 0.5).alias("v"))
    table = scoring.newest_table(spark, str(tmp_path / "t"), "k", ["n"], 3, buckets=20, fanout=100)
    for i in range(4):
        table.append(rows.where(F.col("n") % 4 == i))
    one = table.read(spark.createDataFrame([(17,)], "k long"))
    assert len(one.inputFiles()) <= 4 < 60 < len(table.read().inputFiles())
    assert shape(one) == [(17, n, n * 0.5) for n in (3417, 3617, 3817)]
    assert table.read(spark.createDataFrame([(999,)], "k long")).count() == 0
    # Rows that another stream brings once more are no new rows.
    table.append(rows)
    assert shape(table.read(spark.createDataFrame([(17,)], "k long"))) == shape(one)
