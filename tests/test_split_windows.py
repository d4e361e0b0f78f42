import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compose, split, windows


@pytest.fixture(scope="module")
def hourly(spark):
    start = dt.datetime(2020, 1, 1)
    rows = [(start + dt.timedelta(hours=i), float(i), float(i * 2)) for i in range(200)]
    return spark.createDataFrame(rows, "date timestamp_ntz, a double, b double").repartition(4)


def tags(df):
    return {r["dataset"]: r["count"] for r in df.groupBy("dataset").count().collect()}


def test_windows_of_a_series(hourly):
    frame = windows.supervised_windows(hourly, ["a", "b"], ["b"], ["date"], 5, 2)
    rows = frame.orderBy("window_index").collect()
    assert len(rows) == 194 and rows[0]["window_count"] == 194
    assert rows[0]["x"] == [[float(i), float(2 * i)] for i in range(5)]
    assert rows[0]["y"] == [[10.0], [12.0]] and rows[-1]["y"] == [[396.0], [398.0]]
    parts = split.chronological_split(frame.select("window_end"), ["window_end"])
    assert tags(parts) == {"train": 116, "val": 38, "test": 40}


def test_short_series_and_strides(spark, hourly):
    short = hourly.where("a < 4")
    assert windows.supervised_windows(short, ["a"], ["a"], ["date"], 5, 2).count() == 0
    with pytest.raises(ValueError):
        windows.require_windows(windows.inference_windows(short, ["a"], ["date"], 5, 2))
    assert windows.inference_windows(hourly, ["a"], ["date"], 24, 6).count() == len(range(0, 200 - 24 + 1, 6))
    assert windows.evaluation_windows(hourly, ["a"], ["date"], 24, 6).count() == len(range(0, 200 - 30 + 1, 6))
    with pytest.raises(ValueError):
        windows.edge_window(hourly, ["a"], ["date"], 3, anchor="middle")


def test_windows_keep_null_steps(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i)) for i in range(5)], "t int, v double")
    assert windows.edge_window(df, ["v"], ["t"], 4).first()["x"] == [[1.0], [None], [3.0], [4.0]]
    assert windows.inference_windows(df, ["v"], ["t"], 4, 1).orderBy("window_index").first()["x"] == [[0.0], [1.0], [None], [3.0]]


def test_split_checks(hourly):
    with pytest.raises(ValueError):
        split.chronological_split(hourly, ["date"], {"train": 0.9, "val": 0.1, "test": 0.0})
    with pytest.raises(ValueError):
        split.chronological_split(hourly, ["date"], {"train": 0.9, "val": 0.1, "test": 0.1})
    with pytest.raises(ValueError):
        split.train_subset(hourly, 1.0, ["date"])
    with pytest.raises(ValueError):
        split.train_subset(hourly.where("false"), 0.5, ["date"])
    assert split.train_subset(hourly, 0.7, ["date"]).agg(F.max("a")).first()[0] == 139.0


@pytest.mark.parametrize("max_rows", [None, 7])
def test_split_among_many_equal_times(spark, max_rows):
    df = spark.range(100).select(F.when(F.col("id") < 90, 5).otherwise(F.col("id")).alias("t"), (-F.col("id")).alias("tie"), "id")
    out = split.chronological_split(df, ["t", "tie"], max_rows=max_rows).collect()
    order = sorted(out, key=lambda r: (r["t"], r["tie"]))
    assert [r["dataset"] for r in order] == ["train"] * 60 + ["val"] * 20 + ["test"] * 20


def test_tagged_parts(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, dataset string")
    parts = split.tagged_parts(df)
    assert [r["id"] for r in parts["val"].collect()] == [2]


@pytest.mark.parametrize("rows", [300, 37])
def test_chunked_random_orders_agree_with_sorting(spark, rows):
    """The histogram way, forced by a small limit, gives the very same parts."""
    df = spark.range(rows).withColumn("y", F.col("id") % 3).withColumn("name", F.format_string("n%05d", "id"))
    shape = lambda out: sorted(map(tuple, out.collect()))
    pairs = [
        [split.random_split(df, ["id"], max_rows=m) for m in (None, 5)],
        [split.kfold(df, 4, ["id"], max_rows=m) for m in (None, 5)],
        [split.kfold(df, 4, ["name"], shuffle=False, max_rows=m) for m in (None, 5)],
        [split.stratified_kfold(df, 5, "y", ["id"], max_rows=m) for m in (None, 5)],
    ]
    for plain, chunked in pairs:
        assert shape(plain) == shape(chunked)


def test_folds(spark):
    df = spark.range(23).withColumn("y", F.when(F.col("id") < 4, "rare").otherwise("common"))
    folds = split.kfold(df, 5, ["id"])
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]
    long = split.fold_table(folds, 5)
    assert long.count() == 115 and tags(long) == {"train": 92, "test": 23}
    assert sorted(map(tuple, split.kfold(df, 5, ["id"]).collect())) == sorted(map(tuple, folds.collect()))
    even = split.stratified_kfold(df, 3, "y", ["id"])
    per = {(r["y"], r["fold"]): r["count"] for r in even.groupBy("y", "fold").count().collect()}
    assert sorted(v for (y, _), v in per.items() if y == "rare") == [1, 1, 2]
    assert sorted(r["count"] for r in even.groupBy("fold").count().collect()) == [7, 8, 8]
    few = split.stratified_kfold(df, 5, "y", ["id"])  # fewer rows of a class than folds
    assert sorted(r["count"] for r in few.groupBy("fold").count().collect()) == [4, 4, 5, 5, 5]
    with pytest.raises(ValueError):
        split.stratified_kfold(df, 3, ["y", "id"], ["id"])
    with pytest.raises(ValueError):
        split.kfold(df, 24, ["id"])
    blocks = split.kfold(df.withColumn("name", F.format_string("n%03d", "id")), 4, ["name"], shuffle=False)
    assert [r["fold"] for r in blocks.orderBy("id").collect()] == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 5


def test_expanding_folds(hourly):
    assert split.expanding_ends(200, 3, 24, 6) == [80, 136, 192]
    assert split.expanding_ends(12, 5, 5, 2) == [6, 7, 8, 9, 10]
    assert split.expanding_ends(4, 5, 2, 1) == [3, 4]  # stops at the end of the table
    with pytest.raises(ValueError):
        split.expanding_ends(7, 3, 5, 2)
    folds = split.expanding_folds(hourly, ["date"], 3, 24, 6)
    assert [(r["fold"], r["n"], r["m"]) for r in folds.groupBy("fold").agg(
        F.count("a").alias("n"), F.max("a").alias("m")).orderBy("fold").collect()] == [(0, 80, 79.0), (1, 136, 135.0), (2, 192, 191.0)]


def test_alignment_rules():
    assert compose.infer_method(1, 6) == "broadcast"
    assert compose.infer_method(3, 6) == "tile" and compose.infer_method(3, 6, "spread") == "spread"
    assert compose.infer_method(9, 6) == "truncate" and compose.infer_method(9, 6, "spread") == "truncate"
    assert compose.infer_method(4, 6) == "pad_start" and compose.infer_method(4, 6, "spread") == "pad_end"
    assert compose.infer_method(6, 6) == "none"


@pytest.mark.parametrize("method, family, have, want", [
    ("auto", "tile", 3, [0, 1, 2, 0, 1, 2]), ("auto", "spread", 3, [0, 0, 1, 1, 2, 2]),
    ("auto", "tile", 4, [0, 0, 0, 1, 2, 3]), ("auto", "spread", 4, [0, 1, 2, 3, 3, 3]),
    ("spread", "spread", 4, [0, 1, 2, 3, 0, 1]), ("auto", "tile", 9, [0, 1, 2, 3, 4, 5]),
    ("auto", "tile", 1, [0] * 6), ("auto", "tile", 6, [0, 1, 2, 3, 4, 5]), ("pad_start", "tile", 8, [0, 1, 2, 3, 4, 5]),
])
@pytest.mark.parametrize("max_rows", [None, 2])
def test_alignment(spark, monkeypatch, method, family, have, want, max_rows):
    if max_rows:
        monkeypatch.setattr(compose, "MAX_BROADCAST_ROWS", 0)
    base = spark.range(6).select((F.col("id") * 10).alias("b"))
    source = spark.range(have).select(F.col("id").alias("s"))
    out = compose.align(base, source, ["b"], ["s"], ["s"], method, family, width=1, max_rows=max_rows)
    assert [r["s"] for r in out.orderBy("b").collect()] == want


def test_alignment_checks(spark):
    base, source = spark.range(6), spark.range(4).select(F.col("id").alias("s"))
    with pytest.raises(ValueError):
        compose.align(base, source, ["id"], ["s"], ["s"], "other")
    with pytest.raises(ValueError):
        compose.align(base, source, ["id"], ["s"], ["s"], "tile")
    with pytest.raises(ValueError):
        compose.align(base, source, ["id"], ["s"], ["s"], "truncate")
    one = source.where("s = 0").withColumn("z", F.lit(7))
    wide = compose.align(base.withColumn("c", F.lit(1)), one, ["id"], ["s"], ["z"], family="spread")
    assert wide.columns == ["id", "c", "z_0", "z_1"] and wide.count() == 6
    with pytest.raises(ValueError):
        compose.align(base, one, ["id"], ["s"], ["s", "z"], family="spread", width=3)


def test_composition(spark):
    base = spark.range(4).select(F.col("id").alias("k"))
    out, origin = compose.compose(base, {"m": (spark.range(2).select(F.col("id").alias("v")), ["v"], ["v"])}, ["k"])
    assert origin == {"base": ["k"], "m": ["m_v"]}
    assert [r["m_v"] for r in out.orderBy("k").collect()] == [0, 1, 0, 1]
    single = spark.range(1).select(F.col("id").alias("z"))
    pair = spark.range(4).select(F.col("id").alias("a"), F.lit(1).alias("b"))
    wide, origin = compose.compose(pair, {"p": (single, ["z"], ["z"]), "q": (single, ["z"], ["z"])}, ["a"], family="spread")
    assert origin["p"] == ["p_z_0", "p_z_1"] and origin["q"] == ["q_z_0", "q_z_1"]
    assert wide.columns == ["a", "b", *origin["p"], *origin["q"]]
    assert compose.restore_names(out, {"m_v": "v"}).columns == ["k", "v"]


def test_predictions_on_their_rows(spark):
    rows = spark.createDataFrame([(k, t) for k in "ab" for t in range(6)], "k string, t int")
    predictions = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "k string, window_index int, prediction double")
    out = compose.predictions_as_feature(rows, predictions, ["t"], 3, keys=["k"])
    got = [r["prediction"] for r in out.orderBy("k", "t").collect()]
    assert got == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0] + [0.0] * 6


def test_repeated_keys_stay_together_at_any_size(spark):
    rows = spark.range(60).select((F.col("id") % 12).alias("id"), (F.col("id") % 3).alias("y"))
    got = [{(r["id"], r["fold"]) for r in split.stratified_kfold(rows, 3, "y", ["id"], max_rows=m).collect()} for m in (None, 5)]
    assert got[0] == got[1] and len(got[0]) == 12


def test_windows_are_split_in_time(spark):
    frame = spark.range(10).select(F.col("id").alias("window_index"), F.lit(10).alias("window_count"))
    tags = [r["dataset"] for r in split.tag_windows(frame).orderBy("window_index").collect()]
    assert tags == ["train"] * 6 + ["val"] * 2 + ["test"] * 2
    with pytest.raises(ValueError):
        split.tag_windows(frame, {"train": 1.0, "val": 0.0, "test": 0.0})


@pytest.mark.parametrize("accuracy", [10, 100])
@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_cuts_equal_a_sort_however_coarse_the_summary(spark, monkeypatch, accuracy, kind):
    monkeypatch.setattr(split, "ACCURACY", accuracy)
    at = {"spread": F.col("id") * 7 % 1009, "ties": F.col("id") % 5, "skewed": F.when(F.col("id") % 3 > 0, 50).otherwise(F.col("id"))}[kind]
    df = spark.range(700).select(at.cast("double").alias("t"), (F.col("id") * 31 % 701).alias("u"), "id").repartition(5)
    order = [r["id"] for r in sorted(df.collect(), key=lambda r: (r["t"], r["u"]))]
    for wrong in (False, True):
        ranks, cuts = split._cuts_of(df, ["t", "u"], lambda n: [0, 99, 350, 351, 699, 700], [0.9 if wrong else 0.5] * 2, max_rows=40)
        assert ranks == [0, 99, 350, 351, 699, 700] and set(cuts) == {0, 99, 350, 351, 699}
        for rank, values in cuts.items():
            before = {r["id"] for r in df.where(split._before(["t", "u"], values)).collect()}
            assert before == set(order[:rank]), rank


def test_two_jobs_are_enough(spark, hourly):
    tracker, group = spark.sparkContext.statusTracker(), "cuts"
    spark.sparkContext.setJobGroup(group, group)
    try:
        split._cuts_of(hourly, ["date"], lambda n: [n // 2], [0.5])
        # Two queries; adaptive execution runs every shuffle stage of them as a job of its own.
        assert len(tracker.getJobIdsForGroup(group)) <= 8
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("per", [None, 1, 3, 16])
@pytest.mark.parametrize("stride, input_len, output_len", [(1, 4, 2), (3, 4, 2), (2, 1, 1), (9, 4, 2), (6, 4, 2)])
def test_windows_are_slices_of_blocks(spark, per, stride, input_len, output_len):
    rows = [(k, t, float(100 * k + t)) for k, n in ((1, 40), (2, 5), (3, 6), (4, 13)) for t in range(n)] + [(None, t, float(t)) for t in range(9)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(3)
    frame = windows.sliding_windows(df, ["v"], ["t"], input_len, output_len, ["v", "t"], ["k"], stride, block_rows=per)
    got = {(r["k"], r["window_index"]): (r["window_count"], r["window_end"], r["x"], r["y"]) for r in frame.collect()}
    want, span = {}, input_len + output_len
    for k in (1, 2, 3, 4, None):
        mine = sorted((t, v) for key, t, v in rows if key == k)
        starts = list(range(0, len(mine) - span + 1, stride))
        for i, s in enumerate(starts):
            x, y = mine[s: s + input_len], mine[s + input_len: s + span]
            want[k, i] = (len(starts), x[-1][0], [[v] for _, v in x], [[v, float(t)] for t, v in y])
    assert got == want
    alone = windows.sliding_windows(df.where("k = 1"), ["v"], ["t"], input_len, stride=stride, block_rows=per)
    assert alone.count() == len(range(0, 40 - input_len + 1, stride)) and "y" not in alone.columns
    for count in (1, 3):
        first = windows.first_windows(df, ["v"], ["t"], input_len, count, stride, ["k"])
        assert {(r["k"], r["window_index"]): r["x"] for r in first.collect()} == {
            (r["k"], r["window_index"]): r["x"] for r in windows.sliding_windows(
                df, ["v"], ["t"], input_len, keys=["k"], stride=stride).where(F.col("window_index") < count).collect()}
