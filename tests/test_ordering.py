"""Chunked processing of long series must agree with plain processing and with pandas."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordering
from tidemark.operators.features import Lag, Rolling, row_features
from tidemark.operators.ordering import SeriesLayout, measure
from tidemark.operators.windows import supervised_windows

ORDER = ["t", "id"]


def frame(df, columns):
    return df.select(*columns).orderBy("id").toPandas()


def sorted_pandas(series):
    return series.toPandas().sort_values(["t", "id"])


def layouts(df, keys):
    chunked = measure(df, keys, ORDER, 60)
    assert chunked.has_long_series
    # The heavy time 100 has no usable cut points, so the sort decides the chunks.
    assert chunked.by_position
    by_cuts = SeriesLayout(tuple(keys), chunked.long_series, (50.0, 100.0, 101.0, 400.0, 800.0), 60)
    return [SeriesLayout(tuple(keys)), chunked, by_cuts]


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("which", [0, 1, 2])
def test_row_index(series, keys, which):
    out = ordering.row_index(series, keys, ORDER, "at", "n", layouts(series, keys)[which])
    got = frame(out, ["id", "at", "n"])
    pdf = sorted_pandas(series)
    groups = pdf.groupby(pdf["key"].fillna(-1)) if keys else pdf.groupby(lambda _: 0)
    pdf["at"] = groups.cumcount()
    pdf["n"] = groups["id"].transform("size")
    want = pdf.sort_values("id")[["id", "at", "n"]]
    assert got.values.tolist() == want.values.tolist()


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("which", [0, 1, 2])
@pytest.mark.parametrize("forward", [True, False])
def test_carry(series, keys, which, forward):
    out = ordering.carry(series, keys, ORDER, {"near": "value"}, forward, layouts(series, keys)[which])
    got = frame(out, ["id", "near"])["near"]
    pdf = sorted_pandas(series)
    groups = pdf.groupby(pdf["key"].fillna(-1)) if keys else pdf.groupby(lambda _: 0)
    pdf["near"] = groups["value"].ffill() if forward else groups["value"].bfill()
    want = pdf.sort_values("id")["near"]
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("which", [0, 1, 2])
def test_lag_and_rolling(series, keys, which):
    made = row_features(
        series, [Lag("value", 7), Rolling("value", 3, "mean"), Rolling("value", 4, "std"), Rolling("value", 2, "max")],
        ORDER, keys, layouts(series, keys)[which], block_rows=20)
    names = ["value_lag7", "value_roll3_mean", "value_roll4_std", "value_roll2_max"]
    got = frame(made, ["id", *names])
    pdf = sorted_pandas(series)
    groups = pdf.groupby(pdf["key"].fillna(-1)) if keys else pdf.groupby(lambda _: 0)
    pdf["value_lag7"] = groups["value"].shift(7)
    pdf["value_roll3_mean"] = groups["value"].transform(lambda s: s.rolling(3).mean())
    pdf["value_roll4_std"] = groups["value"].transform(lambda s: s.rolling(4).std())
    pdf["value_roll2_max"] = groups["value"].transform(lambda s: s.rolling(2).max())
    want = pdf.sort_values("id").reset_index(drop=True)
    for name in names:
        pd.testing.assert_series_equal(got[name], want[name], check_names=False)


@pytest.mark.parametrize("which", [1, 2])
@pytest.mark.parametrize("keys", [["key"], []])
def test_windows_in_blocks(series, keys, which):
    options = dict(features=["value", "id"], targets=["value"], order=ORDER, input_len=9, output_len=4, keys=keys, stride=2)
    plain = supervised_windows(series, layout=SeriesLayout(tuple(keys)), **options)
    blocks = supervised_windows(series, layout=layouts(series, keys)[which], block_rows=16, **options)
    shape = lambda df: sorted(map(str, df.collect()))
    assert shape(plain) == shape(blocks)
    assert plain.count() > 100


@pytest.mark.parametrize("which", [0, 1, 2])
def test_running_total(series, which):
    out = ordering.running_total(series, ["key"], ORDER, {"below": "t"}, layouts(series, ["key"])[which])
    got = frame(out, ["id", "below"])["below"].tolist()
    pdf = sorted_pandas(series)
    groups = pdf.groupby(pdf["key"].fillna(-1))
    pdf["below"] = groups["t"].cumsum() - pdf["t"]
    assert got == pdf.sort_values("id")["below"].tolist()


def test_percentiles(series):
    spots = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ordering.percentiles(series, ["key"], "value", spots).toPandas()
    pdf = series.toPandas()
    for key, group in pdf.groupby(pdf["key"].fillna(-1)):
        mine = got[got["key"].fillna(-1) == key].sort_values("probability")["value"].tolist()
        assert mine == pytest.approx([group["value"].quantile(p) for p in spots])
    whole = ordering.percentiles(series, [], "t", spots).orderBy("probability").toPandas()
    assert whole["value"].tolist() == pytest.approx([pdf["t"].quantile(p) for p in spots])


def test_text_order(series):
    named = series.withColumn("name", F.concat(F.lit("n"), F.col("t").cast("string")))
    layout = measure(named, [], ["name", "id"], 100)
    assert layout.by_position
    plain = named.select("id", F.row_number().over(Window.orderBy("name", "id")).alias("at"))
    got = ordering.row_index(named, [], ["name", "id"], "at", layout=layout).select("id", (F.col("at") + 1).alias("at"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_measure_keeps_every_long_series(spark, monkeypatch):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    monkeypatch.setattr(ordering, "MAX_LONG_SERIES", 3)
    layout = measure(df, ["k"], ["id"], 5)
    assert layout.table.count() == 10
    out = ordering.row_index(df, ["k"], ["id"], "at", layout=layout)
    assert out.groupBy("k").agg(F.countDistinct("at").alias("n")).where("n = 10").count() == 10


def test_layout_estimate_from_a_share_of_rows(spark):
    """Above the estimate size the count looks at a share of the rows and still finds the long key."""
    df = spark.range(400_000).select(F.when(F.col("id") < 300_000, 0).otherwise(F.col("id")).alias("k"), "id")
    layout = measure(df, ["k"], ["id"], 80_000)
    assert layout.long_series == ((0,),)
    out = ordering.row_index(df, ["k"], ["id"], "at", layout=layout).where("k = 0")
    assert out.agg(F.max("at"), F.countDistinct("at")).first()[:] == (299_999, 300_000)


def test_many_long_series_are_kept_in_a_table(series, monkeypatch):
    plain = frame(ordering.row_index(series, ["key"], ORDER, "at", "n"), ["id", "at", "n"])
    monkeypatch.setattr(ordering, "MAX_LONG_SERIES", 1)
    layout = measure(series, ["key"], ORDER, 60)
    assert layout.has_long_series and layout.table is not None
    got = frame(ordering.row_index(series, ["key"], ORDER, "at", "n", layout), ["id", "at", "n"])
    assert got.values.tolist() == plain.values.tolist()
    monkeypatch.setattr(ordering, "MAX_CHUNKS", 3)
    assert measure(series.withColumn("t", F.col("id")), ["key"], ["t"], 60).by_position


def test_prefix_sums_need_no_task_with_all_rows(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("c"), (F.col("id") % 5).alias("n")).repartition(7)
    out = ordering.prefix_sum(rows, ["c"], "n", "before")
    plan = StringIO()
    with redirect_stdout(plan):
        out.explain("formatted")
    assert "SinglePartition" not in plan.getvalue()
    pdf = out.toPandas().sort_values("c")
    assert pdf["before"].tolist() == (pdf["n"].cumsum() - pdf["n"]).tolist()
    assert ordering.prefix_sum(rows.limit(0), ["c"], "n", "before").count() == 0
    assert ordering.prefix_sum(rows.limit(3).select("c", (F.col("n") * 0.5).alias("n")), ["c"], "n", "before").count() == 3
