import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, profile


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.normal(size=(50, 2)).round(2), rng.normal(size=(50, 2)).round(2)
    y[:5, 1] = 0
    p[:2, 1] = 0
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(y, p)], "y0 double, y1 double, p0 double, p1 double")
    pairs = [("y0", "p0"), ("y1", "p1")]
    got = values(metrics.forecast_metrics(df, pairs))
    mse = ((y - p) ** 2).mean(axis=0)
    denominator = (abs(y) + abs(p)) / 2
    smape = np.divide(abs(y - p), denominator, out=np.zeros_like(y), where=denominator != 0).mean(axis=0) * 100
    assert got["mae"] == pytest.approx(abs(y - p).mean())
    assert got["rmse"] == pytest.approx(np.sqrt(mse.mean()))
    assert got["r2"] == pytest.approx((1 - ((y - p) ** 2).sum(0) / ((y - y.mean(0)) ** 2).sum(0)).mean())
    assert got["mape"] == pytest.approx((abs(y - p) / np.where(abs(y) > 0, abs(y), 1)).mean() * 100)
    assert got["smape"] == pytest.approx(smape.mean())
    assert values(metrics.forecast_metrics(df, pairs, "median"))["mse"] == pytest.approx(np.median(mse))
    flat = values(metrics.flat_names(metrics.forecast_metrics(df, pairs, None)))
    assert flat["rmse_1"] == pytest.approx(np.sqrt(mse[1])) and len(flat) == 12
    with pytest.raises(ValueError):
        metrics.forecast_metrics(df, pairs, "max")


def test_constant_truth(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    assert values(metrics.regression_metrics(df, [("y", "p")]))["r2"] == -1.0


def test_classification_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0)], "y int, p int")
    got = values(metrics.classification_metrics(df, "y", "p"))
    assert got["accuracy"] == pytest.approx(0.5) and got["recall"] == pytest.approx(0.5)
    assert got["precision"] == pytest.approx((3 * 0.5 + 2 * 0.5 + 0) / 6)
    assert got["f1"] == pytest.approx((3 * (4 / 7) + 2 * 0.5) / 6)
    assert "roc_auc" not in got


def test_auc_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 60, 200) / 60
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    won = sum((a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert values(metrics.roc_auc(df, "y", "s"))["roc_auc"] == pytest.approx(won)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").count() == 0


def test_probability_check(spark):
    df = spark.createDataFrame([(0, 0.2, 0), (1, 1.5, 1)], "y int, p double, label int")
    assert not metrics.holds_probabilities(df, "p") and not metrics.holds_probabilities(df, "label")
    assert metrics.holds_probabilities(df.where("p < 1"), "p")


def test_clusters(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 1, (20, 3)) for c in (0, 4, 9)])
    labels = np.repeat([0, 1, 3], 20)
    df = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, labels)], "x array<double>, c int")
    got = values(metrics.cluster_metrics(df, "x", "c"))
    assert got["n_clusters"] == 4 and got["min_cluster_size"] == 0 and got["max_cluster_size"] == 20
    assert got["std_cluster_size"] == pytest.approx(np.std([20, 20, 0, 20]))
    centres = {k: x[labels == k].mean(0) for k in (0, 1, 3)}
    within = sum(((x[labels == k] - c) ** 2).sum() for k, c in centres.items())
    between = sum(20 * ((c - x.mean(0)) ** 2).sum() for c in centres.values())
    assert got["inertia"] == pytest.approx(within)
    assert got["calinski_harabasz"] == pytest.approx(between * 57 / (within * 2))
    assert got["silhouette_score"] == pytest.approx(metrics.spark_silhouette(df, "x", "c"))
    one = df.where("c = 0")
    assert set(values(metrics.cluster_metrics(one, "x", "c"))) == {
        "inertia", "n_clusters", "min_cluster_size", "max_cluster_size", "std_cluster_size"}
    texts = {r["metric"]: r["explanation"] for r in metrics.explain(
        spark.createDataFrame([("inertia", 1.0), ("other", 2.0)], "metric string, value double")).collect()}
    assert texts["other"] == metrics.NO_EXPLANATION and texts["inertia"] == "; ".join(metrics.EXPLANATIONS["inertia"])


def test_lengths(spark):
    metrics.check_lengths(spark.range(3), spark.range(3))
    with pytest.raises(ValueError):
        metrics.check_lengths(spark.range(3), spark.range(4))


def test_stats_ignore_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 4.0), ("b", None)], "k string, v double")
    rows = {r["k"]: r for r in profile.value_stats(df, "v", ["k"]).collect()}
    assert rows["a"]["n_samples"] == 4 and rows["a"]["median"] == 2.5 and rows["a"]["std"] == 1.5 and rows["a"]["q25"] == 1.75
    assert rows["b"]["n_samples"] == 1 and rows["b"]["mean"] is None and rows["b"]["median"] is None


@pytest.mark.parametrize("shape", ["apart", "together", "equal"])
def test_cluster_search_equals_all_against_all(spark, monkeypatch, shape):
    """Small blocks and pieces, many clusters, some of one row, some with the same centre."""
    monkeypatch.setattr(metrics, "BLOCK_CLUSTERS", 4)
    monkeypatch.setattr(metrics, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(metrics, "CENTRE_BYTES", 700)
    rng = np.random.default_rng(8)
    far = {"apart": 60.0, "together": 1.0, "equal": 0.0}[shape]
    labels = np.concatenate([np.arange(40), rng.integers(0, 37, 260)])
    x = rng.normal(size=(40, 3))[labels] * far + rng.normal(size=(300, 3)) * (shape != "equal")
    df = spark.createDataFrame([(i, [float(v) for v in a], f"c{c}") for i, (a, c) in enumerate(zip(x, labels))], "id int, x array<double>, c string")
    extra = df.unionByName(spark.createDataFrame([(999, None, "c1")], df.schema))
    names = np.unique(labels)
    centres = np.stack([x[labels == c].mean(0) for c in names])
    spread = np.array([np.sqrt(((x[labels == c] - m) ** 2).sum(1)).mean() for c, m in zip(names, centres)])
    gap = np.sqrt(((centres[:, None] - centres) ** 2).sum(-1))
    both = np.divide(spread[:, None] + spread, gap, out=np.zeros_like(gap), where=gap > 0)
    np.fill_diagonal(both, -1)
    if shape != "equal":  # there rounding decides which centres coincide
        assert values(metrics.davies_bouldin(extra, "x", "c"))["davies_bouldin"] == pytest.approx(both.max(1).mean())

    def naive(power, chosen):
        out = []
        for i in chosen:
            d = np.sqrt(((x - x[i]) ** 2).sum(1)) ** power
            own = (labels == labels[i])
            a = d[own].sum() / (own.sum() - 1) if own.sum() > 1 else None
            b = min(d[labels == c].mean() for c in names if c != labels[i])
            out.append(0.0 if a is None or max(a, b) == 0 else (b - a) / max(a, b))
        return np.mean(out)

    got = values(metrics.silhouette(extra, "x", "c"))["silhouette_score"]
    assert got == pytest.approx(naive(2, range(300)), abs=1e-9 if shape != "equal" else 2)
    monkeypatch.setattr(metrics, "QUERY_ROWS", 7)
    some = values(metrics.euclidean_silhouette(extra, "x", "c", F.col("id") % 9 == 0))["silhouette_score"]
    assert some == pytest.approx(naive(1, range(0, 300, 9)), abs=1e-9)


def test_no_other_cluster_no_silhouette(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 3) for i in range(5)], "id int, x array<double>, c int")
    assert metrics.euclidean_silhouette(df, "x", "c", F.col("id") % 2 == 0).count() == 0
    assert metrics.euclidean_silhouette(df, "x", "c", F.lit(False)).count() == 0
    assert metrics.silhouette(df.where("id < 0"), "x", "c").count() == 0
