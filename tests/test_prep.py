import pytest
from pyspark.errors import PySparkException

from tidemark.operators import features, prep
from tidemark.sources import writers

STEPS = [
    {"name": "fill_missing", "method": "mean", "columns": ["num"]},
    {"name": "label_encoding", "columns": ["cat"]},
    {"name": "normalize", "method": "zscore", "columns": ["num"]},
]


@pytest.fixture()
def small(spark):
    return spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "a"), (2, None, "b"), (3, 4.0, None)], "id int, num double, cat string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_fit_uses_unfilled_values(small):
    state = prep.fit(small, STEPS)
    assert state.fills["num"] == ("mean", pytest.approx(7 / 3))
    centre, width = state.scales["num"]
    assert centre == pytest.approx(7 / 3) and width == pytest.approx((14 / 9) ** 0.5)
    out = prep.apply(small, state, STEPS)
    assert column(out, "cat") == [0, 0, 1, None]
    assert column(out, "num")[2] == pytest.approx(0.0)


def test_unseen_class_takes_the_first_code(spark, small):
    state = prep.fit(small, STEPS[1:2])
    other = spark.createDataFrame([(0, "a"), (1, "c"), (2, None), (3, "b")], "id int, cat string")
    assert column(prep.apply(other, state, STEPS[1:2]), "cat") == [0, 0, None, 1]


def test_fit_sees_stateless_steps_before_it(small):
    steps = [{"name": "clip", "columns": ["num"], "max": 2}, {"name": "fill_missing", "columns": ["num"]}]
    assert prep.fit(small, steps).fills["num"][1] == pytest.approx(5 / 3)


def test_all_stored_fills_apply_at_any_fill_step(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, 3.0)], "id int, a double, b double")
    steps = [{"name": "fill_missing", "columns": ["a"]}, {"name": "fill_missing", "columns": ["b"], "method": "median"}]
    out = prep.apply(df, prep.fit(df, steps), steps[:1])
    assert column(out, "a") == [1.0, 1.0] and column(out, "b") == [3.0, 3.0]


def test_mode_ties_and_empty_columns(spark):
    df = spark.createDataFrame([(0, 2, "y", None), (1, 1, "x", None), (2, 2, "x", None), (3, 1, "y", None)],
                               "id int, n int, s string, e double")
    fills = prep.fit(df, [{"name": "fill_missing", "method": "mode", "columns": ["n", "s", "e"]}]).fills
    assert fills == {"n": ("mode", 1.0), "s": ("mode", "x"), "e": ("mode", 0.0)}


def test_rounding_and_flags_and_clip_keep_their_null_rules(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 1.5), (2, 2.5), (3, None)], "id int, v double")
    run = lambda *steps: column(prep.apply(df, prep.FittedState(), list(steps)), "v")
    assert run({"name": "round", "columns": ["v"]}) == [0, 2, 2, None]
    assert run({"name": "binary", "columns": ["v"], "threshold": 1.5}) == [0, 0, 1, 0]
    assert run({"name": "clip", "columns": ["v", "absent"], "min": 1, "max": 2}) == [1, 1.5, 2, None]
    assert run({"name": "clip", "columns": ["v"]}) == [0.5, 1.5, 2.5, None]
    assert run({"name": "udf", "columns": ["v", "absent"], "func": lambda c: -c}) == [-0.5, -1.5, -2.5, None]


def test_log_rejects_values_that_are_not_positive(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -1.0)], "id int, v double")
    with pytest.raises(PySparkException):
        prep.apply(df, prep.FittedState(), [{"name": "log", "columns": ["v"], "offset": 1.0}]).collect()
    assert column(prep.apply(df, prep.FittedState(), [{"name": "log", "columns": ["v"], "offset": 2.0}]), "v")[1] == 0.0


@pytest.mark.parametrize("steps, error", [
    ([{"name": "other"}], ValueError), ([{"columns": []}], ValueError), ({"name": "abs"}, TypeError),
    ([{"name": "abs", "columns": "num"}], TypeError), ([{"name": "abs", "columns": ["absent"]}], KeyError),
    ([{"name": "udf", "columns": ["num"]}], ValueError),
    ([{"name": "fill_missing", "method": "other"}], ValueError), ([{"name": "normalize", "method": "other"}], ValueError),
])
def test_bad_steps(small, steps, error):
    with pytest.raises(error):
        prep.apply(small, prep.FittedState(), steps)


def test_scaler_needs_all_its_columns(small):
    state = prep.FittedState(scale_method="zscore", scales={"num": (0.0, 1.0), "gone": (0.0, 1.0)})
    with pytest.raises(ValueError):
        prep.apply_scales(small, state)


def test_large_class_table_is_indexed_by_a_sort(small, monkeypatch):
    monkeypatch.setattr(prep, "MAX_ROWS_PER_TASK", 1)
    monkeypatch.setattr(prep, "MAX_BROADCAST_CLASSES", 0)
    state = prep.fit(small, STEPS[1:2])
    assert column(prep.apply(small, state, STEPS[1:2]), "cat") == [0, 0, 1, None]


def test_state_survives_saving(spark, small, tmp_path):
    state = prep.fit(small, [*STEPS, {"name": "fill_missing", "method": "mode", "columns": ["cat"]}])
    writers.save_state(state, spark, str(tmp_path))
    again = writers.load_state(spark, str(tmp_path))
    assert again.fills == state.fills and again.scales == state.scales and again.class_counts == state.class_counts
    assert column(prep.apply(small, again, STEPS), "cat") == [0, 0, 1, 0]
    assert writers.load_state(spark, str(tmp_path / "absent")) == prep.FittedState()


def test_directional_fill(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 2.0), (4, None)], "id int, v double")
    assert column(features.fill_both_ways(df, ["v"], ["id"]), "v") == [1, 1, 1, 2, 2]
    assert column(features.forward_fill(df, ["v"], ["id"]), "v") == [None, 1, 1, 2, 2]


def test_projection(small):
    assert prep.select_columns(small, ["num", "cat"], ["num"]).columns == ["cat", "num"]
    assert prep.select_columns(small, ["absent"]).columns == small.columns
    assert prep.select_columns(small).columns == small.columns


def test_missing_feature_columns(small):
    with pytest.raises(KeyError):
        features.lag_features(small, ["absent"], [1], ["id"])
    with pytest.raises(KeyError):
        features.fraud_features(small)
    assert features.sanitize_ratio(small).columns == small.columns


def test_equal_values_and_flags(spark):
    df = spark.createDataFrame([(0, 1000.0, 5.0, 0.5), (1, 1001.0, 50.0, 0.9), (2, None, 1.0, 0.1)],
                               "id int, amount double, tx_count_30m double, device_risk double")
    out = features.fraud_features(df)
    assert column(out, "high_amount_flag") == [0.0, 1.0, 0.0]
    assert column(out, "risk_score") == pytest.approx([0.5, 1.0, 0.1])
