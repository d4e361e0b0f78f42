import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.plans import scoring, training


@pytest.fixture(scope="module")
def waves(spark):
    """Two series that follow a simple rule, and one that is too short."""
    rows = [(k, t, float((t * (2 + k)) % 7), float(t % 5)) for k in (0, 1) for t in range(120)]
    rows += [(9, t, 1.0, 1.0) for t in range(3)]
    return spark.createDataFrame(rows, "k int, t int, v double, w double").persist()


@pytest.fixture(scope="module")
def frame(waves):
    built = windows.supervised_windows(waves, ["v", "w"], ["v"], ["t"], 6, 2, ["k"])
    at, n = F.col("window_index"), F.col("window_count")
    return built.withColumn("dataset", F.when(at < n * 0.6, "train").when(at < n * 0.8, "val").otherwise("test")).persist()


@pytest.fixture(scope="module")
def model(frame):
    return training.fit_forecaster(frame, 2, 1, "gbt", "dataset", maxIter=10, maxDepth=4, seed=1)


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_forecast_beats_the_mean(frame, model):
    got = values(scoring.evaluate(frame, model, 2, 1))
    assert got["r2"] > 0.5 and set(got) == {"mae", "mse", "rmse", "r2", "mape", "smape"}
    ready = model.transform(training.window_features(frame))
    assert values(scoring.evaluate(ready, model, 2, 1)) == pytest.approx(got)
    again = training.fit_forecaster(frame, 2, 1, "gbt", "dataset", maxIter=10, maxDepth=4, seed=1)
    assert values(scoring.evaluate(frame, again, 2, 1)) == pytest.approx(got)


def test_linear_recovers_a_line(spark):
    df = training.assemble(spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 1).alias("y")), ["x"])
    model = training.fit_outputs(df, [F.col("y"), -F.col("y")], "linear")
    row = model.transform(df).where("x = 10").first()
    assert row["prediction"] == pytest.approx([31, -31], abs=1e-6)
    with pytest.raises(ValueError):
        training.learner("other")


def test_entities(waves, model):
    out = scoring.score_entities(waves, model, ["v", "w"], ["t"], 6, "k").collect()
    assert sorted(r["k"] for r in out) == [0, 1] and all(len(r["predictions"]) == 2 for r in out)
    first = scoring.score_first_entity(waves, model, ["v", "w"], ["t"], 6, "k", [1, 0]).collect()
    assert [r["k"] for r in first] == [1]
    assert first[0]["predictions"] == [r["predictions"] for r in out if r["k"] == 1][0]
    with pytest.raises(ValueError):
        scoring.score_entities(waves.where("k = 9"), model, ["v", "w"], ["t"], 6, "k", strict=True)
    holes = waves.withColumn("v", F.when(F.col("k") == 0, F.col("v")))
    kept = {r["k"]: r["predictions"] for r in scoring.score_entities(holes, model, ["v", "w"], ["t"], 6, "k").collect()}
    assert kept[1] is None and kept[0] == [r["predictions"] for r in out if r["k"] == 0][0]


def test_no_scored_row_vanishes_or_moves(spark, waves, model):
    gaps = waves.withColumn("v", F.when(F.col("t") != 7, F.col("v")))
    whole = {(r["k"], r["window_index"]): r["prediction"] for r in scoring.score_windows(waves, model, ["v", "w"], ["t"], 6, 2, ["k"]).collect()}
    holed = {(r["k"], r["window_index"]): r["prediction"] for r in scoring.score_windows(gaps, model, ["v", "w"], ["t"], 6, 2, ["k"]).collect()}
    assert holed.keys() == whole.keys()
    # Windows 1 to 3 start at rows 2, 4 and 6 and read row 7.
    assert all(holed[key] == (None if key[1] in (1, 2, 3) else whole[key]) for key in whole)
    ahead = scoring.score_steps_ahead(gaps, model, ["v", "w"], ["t"], 6, 2, 10, ["k"], shift=2).collect()
    for row in ahead:
        assert row["blocks"] == 5
        assert row["predictions"] == [*whole[row["k"], 0], *[None] * 6, *whole[row["k"], 4]]
    line = training.fit_outputs(training.assemble(spark.range(20).select(F.col("id").cast("double").alias("x")), ["x"]), [F.col("x") * 2], "linear")
    rows = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    scored = scoring.score_rows(rows, line, ["x"]).select("prediction").collect()
    assert [r[0] and round(r[0][0], 6) for r in scored] == [2.0, None, None]


def test_windows_and_steps_ahead(waves, model):
    out = scoring.score_windows(waves, model, ["v", "w"], ["t"], 6, 2, ["k"])
    assert out.groupBy("k").count().where("count = 58").count() == 2
    ahead = scoring.score_steps_ahead(waves, model, ["v", "w"], ["t"], 6, 2, 5, ["k"]).collect()
    assert {r["blocks"] for r in ahead} == {3} and {len(r["predictions"]) for r in ahead} == {6}
    short = scoring.score_steps_ahead(waves.where("t < 7"), model, ["v", "w"], ["t"], 6, 2, 5, ["k"]).collect()
    assert {r["blocks"] for r in short} == {2}
    by_two = {(r["k"], r["window_index"]): r["prediction"] for r in out.collect()}
    apart = scoring.score_steps_ahead(waves, model, ["v", "w"], ["t"], 6, 2, 4, ["k"], shift=2).collect()
    for row in apart:
        assert row["predictions"] == by_two[(row["k"], 0)] + by_two[(row["k"], 1)]


@pytest.mark.parametrize("stride", [1, 2])
def test_predictions_bear_filters_and_explodes(waves, model, stride):
    """Spark may push what follows below the model, which must then not meet windows that are cut off."""
    out = scoring.score_windows(waves, model, ["v", "w"], ["t"], 6, 2, ["k"], stride)
    plain = {(r["k"], r["window_index"]): r["prediction"] for r in out.collect()}
    cells = out.select("k", "window_index", F.posexplode("prediction").alias("step", "p")).collect()
    assert {(r["k"], r["window_index"], r["step"]): r["p"] for r in cells} == {
        (*key, i): p for key, values in plain.items() for i, p in enumerate(values)}
    big = out.where(F.size("prediction") > 0).where(F.col("prediction")[0] > 3).collect()
    assert {(r["k"], r["window_index"]) for r in big} == {key for key, p in plain.items() if p[0] > 3} and 0 < len(big) < len(plain)
    odd = waves.withColumn("_flat", F.when(F.col("t") % 2 == 0, F.array_repeat(F.col("v"), 12)).when(F.col("t") % 3 == 0, F.array("v")))
    kept = training.predict_all(model, odd).collect()
    assert len(kept) == waves.count() and all((r["prediction"] is None) == (r["t"] % 2 == 1) for r in kept)


def test_boosting_of_several_classes(spark):
    rows = spark.range(400).select("id", (F.col("id") % 4).alias("y"), ((F.col("id") % 4) * 10 + F.col("id") % 3).cast("double").alias("x"))
    rows = rows.withColumn("y", F.element_at(F.array(*[F.lit(v) for v in (7.0, -2.0, 3.5, 9.0)]), (F.col("y") + 1).cast("int")))
    ready = training.assemble(rows, ["x"])
    model = training.fit_outputs(ready, [F.col("y"), (F.col("y") > 4).cast("int")], "gbt_classifier", maxIter=3, maxDepth=3, seed=1)
    assert model.class_counts() == [4, 2] and model.width == 1
    scored = model.transform(model.transform(ready), "chances", probabilities=True).collect()
    for r in scored:
        assert r["prediction"][0] == r["y"] and r["prediction"][1] == float(r["y"] > 4)
        assert len(r["chances"][0]) == 4 and sum(r["chances"][0]) == pytest.approx(1) and sum(r["chances"][1]) == pytest.approx(1)
    # Rows flagged for validation and row weights reach every model.
    flagged = ready.withColumn("val", F.col("id") % 5 == 0).withColumn("w", F.lit(2.0))
    again = training.fit_outputs(flagged, [F.col("y")], "gbt_classifier", validation="val", weight="w", maxIter=3, maxDepth=3, seed=1)
    assert all(r["prediction"][0] == r["y"] for r in again.transform(ready).collect())
    one = training.fit_outputs(ready, [(F.col("y") > 4).cast("int")], "gbt_classifier", maxIter=2, seed=1)
    assert 0 <= one.transform(ready, probabilities=True).first()["prediction"][0] <= 1
    mixed = training.OutputModels([one.models[0], training.fit_outputs(ready, [F.col("y")], "linear").models[0]])
    with pytest.raises(ValueError):
        mixed.transform(ready, probabilities=True)


def test_lines_of_all_folds_equal_fits_fold_by_fold(spark, waves, monkeypatch):
    data = waves.where("k < 9").withColumn("y", F.col("v") * 2 - F.col("w") + F.col("t") % 3)
    data = data.withColumns({"v": F.when(F.col("t") % 11 > 0, F.col("v")), "c": F.lit(4.0), "v2": F.col("v") * 3,
                             "y": F.when(F.col("t") % 13 > 0, F.col("y"))})
    steps = [{"name": "normalize", "columns": ["v", "w"]}]
    runs = [lambda: training.cross_validate(data, 3, ["k", "t"], ["v", "w", "c", "v2"], "y", steps, "linear"),
            lambda: training.cross_validate(data, 2, ["k", "t"], ["v", "w"], "y", (), "linear", fitIntercept=False),
            lambda: training.cross_validate_series(waves, 3, ["v", "w"], ["v"], ["t", "k"], 4, 1, ["k"]),
            lambda: training.cross_validate_series(waves.where("k = 0"), 2, ["v"], ["v"], ["t"], 5, 1)]
    fast = [values(run()) for run in runs]
    monkeypatch.setattr(training, "MAX_GRAM_COLUMNS", 0)
    for got, run in zip(fast, runs, strict=True):
        assert got == pytest.approx(values(run()), rel=1e-6, abs=1e-9)


def test_window_choice(model):
    assert scoring.needs_windows(model, ["v", "w"], 6)
    assert not scoring.needs_windows(model, list("abcdefghijkl"), 6)
    with pytest.raises(ValueError):
        scoring.needs_windows(model, ["v"], 6)


def test_sanitize(spark):
    df = spark.createDataFrame([([1.5, float("nan"), float("inf"), float("-inf"), None],)], "p array<double>")
    assert df.select(scoring.sanitize("p").alias("p")).first()["p"] == [1.5, 0.0, 0.0, 0.0, 0.0]


def test_stages(waves):
    data = waves.withColumn("y", F.col("v") * 2 + F.col("w"))
    fitted = training.staged_model(["v", "w"], "y", clusters=2, maxIter=5, maxDepth=4).fit(data)
    out = scoring.score_stages(data, fitted)
    assert out.count() == data.count() and out.select("cluster").distinct().count() == 2
    assert out.select(F.corr("y", "prediction")).first()[0] > 0.9
    pca = training.fit_pca(data, ["v", "w", "y"]).transform(data)
    means = pca.select(training.vector_to_array("pca").alias("p")).agg(F.avg(F.col("p")[0]), F.avg(F.col("p")[1])).first()
    assert means[0] == pytest.approx(0, abs=1e-9) and means[1] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("count", [1, 2, 7, 4000])
def test_exact_medians_without_a_sketch_of_all_values(spark, monkeypatch, count):
    """The same fills as Spark's imputer without error, though no column is summarised by one that keeps every value."""
    rng = random.Random(count)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0]
    rows = [(rng.gauss(0, 1), rng.choice([*odd, 1.0, 2.0]), rng.randrange(3)) for _ in range(count)] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows + [(1.0, 2.0, 1)], "a double, b float, c int").repartition(3)
    options = {"strategy": "median", "relativeError": 0.0}
    names = {"inputCols": ["a", "b", "c"], "outputCols": ["x", "y", "z"]}
    plain = training.Imputer(**names, **options).fit(df)
    from pyspark.sql import DataFrameStatFunctions
    from pyspark.ml.wrapper import JavaEstimator
    fitted, given = JavaEstimator._fit, []
    monkeypatch.setattr(JavaEstimator, "_fit", lambda self, data: given.append(data.count()) or fitted(self, data))
    monkeypatch.setattr(DataFrameStatFunctions, "approxQuantile", None)
    mine = training.stage("imputer", names["inputCols"], names["outputCols"], **options).fit(df).stages[0]
    assert given == [1] and training.staged_model(["a"], "b").getStages()[0].plain.getRelativeError() == 0
    assert mine.surrogateDF.first().asDict() == plain.surrogateDF.first().asDict()
    read = lambda m: sorted(str(tuple(r)) for r in m.transform(df).collect())
    assert read(mine) == read(plain) and mine.transform(df).dtypes == plain.transform(df).dtypes
    gaps = df.withColumn("a", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="surrogate cannot be computed"):
        training.stage("imputer", ["a"], ["x"], **options).fit(gaps)


def test_failures_in_threads_are_raised(spark):
    with pytest.raises(ZeroDivisionError):
        training.in_threads(spark, [lambda: 1, lambda: 1 / 0])


def test_cross_validation(waves):
    data = waves.where("k < 9").withColumn("y", F.col("v") * 2 + F.col("w"))
    got = values(training.cross_validate(data, 3, ["k", "t"], ["v", "w"], "y", [{"name": "normalize", "columns": ["v"]}], "linear"))
    assert got["mae_mean"] == pytest.approx(0, abs=1e-6) and got["r2_mean"] == pytest.approx(1) and len(got) == 12
    labelled = data.withColumn("y", (F.col("v") > 3).cast("int"))
    kinds = values(training.cross_validate(labelled, 2, ["k", "t"], ["v"], "y", (), "gbt_classifier", stratify=True, maxIter=2))
    assert kinds["accuracy_mean"] == pytest.approx(1.0)
    series = values(training.cross_validate_series(waves.where("k = 0"), 2, ["v"], ["v"], ["t"], 7, 1))
    assert series["mae_mean"] < 2 and "rmse_std" in series


def test_search(spark):
    space = {"a": {"type": "int", "range": [0, 10], "step": 5}, "b": {"type": "float", "range": [0.1, 10.0], "log": True},
             "c": {"type": "categorical", "range": ["x"]}, "d": {"type": "float", "range": [0, 1]}}
    seen = []

    def run(setting):
        seen.append(setting)
        return spark.createDataFrame([("mae_mean", float(setting["a"]))], "metric string, value double")

    best, value, tried = training.search(space, run, "mae_mean", 6, fixed={"d": 0.5})
    assert value == min(s["a"] for s in seen) and len(tried) == 6
    assert all(s["a"] in (0, 5, 10) and 0.1 <= s["b"] <= 10 and s["d"] == 0.5 for s in seen)
    assert training.search(space, run, "mae_mean", 6, direction="maximize")[1] == max(s["a"] for s in seen)
    assert [t[0] for t in training.search(space, run, "mae_mean", 6, fixed={"d": 0.5})[2]] == [t[0] for t in tried]
    for bad in (dict(space={}), dict(metric="other"), dict(space={"a": {"type": "odd", "range": []}})):
        with pytest.raises(ValueError):
            training.search(**{**dict(space=space, evaluate=run, metric="mae_mean", trials=1), **bad})
    assert training.draw(space, random.Random(1)) == training.draw(space, random.Random(1))


def test_named_stages(waves):
    gaps = waves.withColumn("g", F.when(F.col("t") > 0, F.col("v")))
    assert training.stage("imputer", ["g"], ["h"]).fit(gaps).transform(gaps).where("h IS NULL").isEmpty()
    for kind, params in (("scaler", {}), ("pca", {"k": 1}), ("kmeans", {"k": 2})):
        assert "out" in training.stage(kind, ["v", "w"], "out", **params).fit(waves).transform(waves).columns
    with pytest.raises(ValueError):
        training.stage("other", ["v"], "out")
