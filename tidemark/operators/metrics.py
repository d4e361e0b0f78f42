"""Model metrics as distributed aggregates. Every function returns rows (metric, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.ordering import prefix_sum
from tidemark.session import cut_lineage

# What each clustering metric measures, the range of its values and which end is wanted.
EXPLANATIONS = {
    "calinski_harabasz": ("between / within dispersion", "[0, inf)", "high"),
    "davies_bouldin": ("mean over clusters of max (s_i + s_j) / d_ij", "[0, inf)", "low"),
    "inertia": ("sum of squared distances to own centre", "[0, inf)", "low"),
    "max_cluster_size": ("rows of the largest cluster", "[0, n]", "none"),
    "min_cluster_size": ("rows of the smallest cluster", "[0, n]", "none"),
    "n_clusters": ("largest id + 1", "[0, n]", "none"),
    "silhouette_score": ("mean of (b - a) / max(a, b), squared distances", "[-1, 1]", "high"),
    "std_cluster_size": ("population deviation of cluster sizes", "[0, n]", "low"),
}
NO_EXPLANATION = "unknown metric"

# Centres that a task holds at a time, also the largest table of centres that is broadcast to a join.
CENTRE_BYTES = 32 << 20
BLOCK_CLUSTERS, BLOCK_VECTORS, QUERY_ROWS = 256, 1024, 2048


# --------------------------------------------------------------------------
# regression and forecasting


def _errors(y: Column, p: Column) -> dict[str, Column]:
    miss = F.abs(y - p)
    y_size = F.when(F.abs(y) > 0, F.abs(y)).otherwise(F.lit(1.0))
    both = (F.abs(y) + F.abs(p)) / 2
    total = F.count(y) * F.var_pop(y)
    return {
        "mae": F.avg(miss),
        "mse": F.avg(miss * miss),
        "r2": 1 - F.sum(miss * miss) / F.when(total != 0, total).otherwise(F.lit(1.0)),
        "mape": F.avg(miss / y_size) * 100,
        "smape": F.avg(F.when(both != 0, miss / both).otherwise(F.lit(0.0))) * 100,
    }


REGRESSION = ("mae", "mse", "rmse", "r2")
FORECAST = (*REGRESSION, "mape", "smape")


def output_errors(
    df: DataFrame, outputs: Sequence[tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group, output and metric; all outputs are measured in one scan."""
    y_p = [(F.col(y).cast("double"), F.col(p).cast("double")) for y, p in outputs]
    exprs = [
        value.alias(f"{name}_{i}") for i, (y, p) in enumerate(y_p) for name, value in _errors(y, p).items()
    ]
    wide = df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
    cells = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.lit(i).alias("output"), F.col(f"{name}_{i}").alias("value"))
        for i in range(len(outputs)) for name in ("mae", "mse", "r2", "mape", "smape")
    ])).alias("cell")
    return wide.select(*by, cells).select(*by, "cell.*")


def forecast_metrics(
    df: DataFrame,
    outputs: Sequence[tuple[str, str]],
    aggregate: str | None = "mean",
    names: Sequence[str] = FORECAST,
    by: Sequence[str] = (),
) -> DataFrame:
    """Regression and forecasting errors over one or more (truth, prediction) columns.

    ``aggregate`` is ``mean`` or ``median`` over the outputs, or None for one row
    per output. RMSE is the root of the already aggregated MSE.
    """
    per = output_errors(df, outputs, by)
    rooted = per.where("metric = 'mse'")
    if aggregate is None:
        rmse = rooted.select(*by, F.lit("rmse").alias("metric"), "output", F.sqrt("value").alias("value"))
        return per.unionByName(rmse).where(F.col("metric").isin(*names))
    if aggregate not in ("mean", "median"):
        raise ValueError(f"unknown aggregate: {aggregate}")
    over = F.avg("value") if aggregate == "mean" else F.median("value")  # one value per output
    merged = per.groupBy(*by, "metric").agg(over.alias("value"))
    cells = F.explode(
        F.when(F.col("metric") == "mse", F.array(
            F.struct(F.lit("mse").alias("metric"), F.col("value")),
            F.struct(F.lit("rmse").alias("metric"), F.sqrt("value").alias("value")),
        )).otherwise(F.array(F.struct("metric", "value")))
    ).alias("cell")
    return merged.select(*by, cells).select(*by, "cell.*").where(F.col("metric").isin(*names))


def regression_metrics(df, outputs, aggregate="mean", by=()) -> DataFrame:
    return forecast_metrics(df, outputs, aggregate, REGRESSION, by)


def flat_names(metrics: DataFrame) -> DataFrame:
    """Per-output rows as (``metric_output``, value)."""
    return metrics.select(F.concat_ws("_", "metric", F.col("output").cast("string")).alias("metric"), "value")


def array_errors(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors of array-valued outputs, one row per array position and metric."""
    pairs = df.select(*by, F.posexplode(F.arrays_zip(F.col(truth).alias("y"), F.col(predicted).alias("p"))))
    pairs = pairs.select(*by, F.col("pos").alias("output"), F.col("col.y").cast("double").alias("y"),
                         F.col("col.p").cast("double").alias("p"))
    exprs = [v.alias(n) for n, v in _errors(F.col("y"), F.col("p")).items()]
    wide = pairs.groupBy(*by, "output").agg(*exprs)
    return wide.unpivot([*by, "output"], ["mae", "mse", "r2", "mape", "smape"], "metric", "value")


def check_lengths(truth: DataFrame, predicted: DataFrame) -> None:
    a, b = truth.count(), predicted.count()
    if a != b:
        raise ValueError(f"truth has {a} rows, predictions have {b}")


def fold_summary(metrics: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    per = metrics.groupBy(metric).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    long = per.unpivot([metric], ["mean", "std"], "_kind", "value")
    return long.select(F.concat_ws("_", metric, "_kind").alias("metric"), "value")


# --------------------------------------------------------------------------
# classification


def holds_probabilities(df: DataFrame, predicted: str) -> bool:
    """Whether a floating point column lies in [0, 1] throughout."""
    if not isinstance(df.schema[predicted].dataType, (T.FloatType, T.DoubleType)):
        return False
    value = F.col(predicted)
    outside = (value < 0) | (value > 1) | F.isnan(value) | value.isNull()
    return df.where(outside).isEmpty()


def confusion(df: DataFrame, truth: str, label: Column) -> DataFrame:
    return df.groupBy(F.col(truth).cast("long").alias("truth"), label.cast("long").alias("label")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def classification_metrics(
    df: DataFrame, truth: str, predicted: str, probabilities: bool | None = None
) -> DataFrame:
    """Accuracy, weighted F1, precision and recall, and ROC-AUC for probabilities.

    Probabilities become label 1 from 0.5 on. A ratio with denominator 0 is 0.
    """
    if probabilities is None:
        probabilities = holds_probabilities(df, predicted)
    label = (F.col(predicted) >= 0.5).cast("int") if probabilities else F.col(predicted).cast("int")
    table = confusion(df, truth, label)
    hit = F.when(F.col("truth") == F.col("label"), F.col("rows")).otherwise(F.lit(0))
    # From here on: one row per class.
    actual = table.groupBy(F.col("truth").alias("class")).agg(F.sum("rows").alias("support"), F.sum(hit).alias("hits"))
    chosen = table.groupBy(F.col("label").alias("class")).agg(F.sum("rows").alias("chosen"))
    per = actual.join(chosen, "class", "left").fillna(0, ["chosen"])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    precision = ratio(F.col("hits"), F.col("chosen"))
    recall = ratio(F.col("hits"), F.col("support"))
    f1 = ratio(2 * F.col("hits").cast("double"), (F.col("chosen") + F.col("support")).cast("double"))
    weight = F.col("support")
    wide = per.agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(weight * f1) / F.sum(weight)).alias("f1"),
        (F.sum(weight * precision) / F.sum(weight)).alias("precision"),
        (F.sum(weight * recall) / F.sum(weight)).alias("recall"),
    )
    out = wide.unpivot([], ["accuracy", "f1", "precision", "recall"], "metric", "value")
    return out.unionByName(roc_auc(df, truth, predicted)) if probabilities else out


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half. No row without two classes.

    The larger of the two labels is the positive one; a third label is an error. Rows without a label
    are passed over. Rows collapse to one per score before anything is ordered.
    """
    df = df.where(F.col(truth).isNotNull())
    ends = df.agg(F.min(truth).alias("low"), F.max(truth).alias("high")).first()
    if ends["high"] is None or ends["low"] == ends["high"]:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    label, low, high = F.col(truth), F.lit(ends["low"]), F.lit(ends["high"])
    third = F.raise_error(F.lit("more than two labels")).cast("long")
    positive = F.when(label == high, 1).when(label == low, 0).otherwise(third).cast("long")
    rows = df.select(F.col(score).cast("double").alias("score"), positive.alias("positive"))
    scores = rows.groupBy("score").agg(
        F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    ranked = prefix_sum(scores, ["score"], "neg", "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    area = ranked.agg(won.alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return area.where("p > 0 and n > 0").select(
        F.lit("roc_auc").alias("metric"), (F.col("won") / (F.col("p").cast("double") * F.col("n"))).alias("value"))


# --------------------------------------------------------------------------
# clustering


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Size metrics over the ids 0 .. max; an id without rows counts as an empty cluster."""
    counts = df.groupBy(F.col(label).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    size = F.col("rows").cast("double")
    wide = counts.agg(
        (F.max("id") + 1).cast("double").alias("n_clusters"),
        F.count(F.lit(1)).alias("held"),
        F.min(size).alias("low"),
        F.max(size).alias("max_cluster_size"),
        F.sum(size).alias("total"),
        F.sum(size * size).alias("squares"),
    )
    n = F.col("n_clusters")
    mean = F.col("total") / n
    done = wide.where("n_clusters is not null").select(
        n,
        F.when(n > F.col("held"), F.lit(0.0)).otherwise(F.col("low")).alias("min_cluster_size"),
        "max_cluster_size",
        F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0))).alias("std_cluster_size"),
    )
    return done.unpivot(
        [], ["n_clusters", "min_cluster_size", "max_cluster_size", "std_cluster_size"], "metric", "value")


def _vector(features: Column | str) -> Column:
    value = F.col(features) if isinstance(features, str) else features
    return array_to_vector(value.cast("array<double>"))


def _square(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def _gap(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, features: str, label: str) -> DataFrame:
    """Per cluster: rows, mean vector and within-cluster sum of squares, in one pass."""
    vector = _vector(features)
    stats = df.where(F.col(features).isNotNull()).groupBy(F.col(label).alias("cluster")).agg(
        F.count(F.lit(1)).alias("rows"),
        Summarizer.metrics("mean", "variance").summary(vector).alias("s"),
    )
    centre = vector_to_array("s.mean")
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda s, x: s + x)
    return stats.select("cluster", "rows", centre.alias("centre"), (spread * (F.col("rows") - 1)).alias("within"))


def cluster_dispersion(df: DataFrame, features: str, label: str) -> DataFrame:
    """Inertia about the cluster means and the Calinski-Harabasz ratio: one scan of the rows."""
    table = centroids(df, features, label)
    n, k = F.col("n"), F.col("k")
    mean = table.agg(vector_to_array(Summarizer.mean(array_to_vector("centre"), F.col("rows").cast("double"))))
    apart = F.col("rows") * _gap(F.col("centre"), F.col("mean"))
    facts = table.withColumn("mean", mean.scalar()).agg(
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("within"), F.sum(apart).alias("between"))
    between = F.col("between")
    ratio = F.when(F.col("within") == 0, F.lit(1.0)).otherwise(
        (between * (n - k)) / (F.col("within") * (k - 1)))
    wide = facts.select(F.col("within").alias("inertia"), F.when(k > 1, ratio).alias("calinski_harabasz"))
    return wide.unpivot([], ["inertia", "calinski_harabasz"], "metric", "value").where("value is not null")


def _numbered(clusters: DataFrame) -> DataFrame:
    """The clusters, kept in the shared folder, with a ``number`` each."""
    return cut_lineage(clusters).withColumn("number", F.monotonically_increasing_id())


def _beside(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every row with its own cluster; a hot cluster is split by Spark's skew handling if the join is shuffled."""
    size = clusters.agg(F.sum(8 * F.size("centre") + 64)).first()[0] or 0
    return rows.join(F.broadcast(clusters) if size <= CENTRE_BYTES else clusters.hint("merge"), "cluster")


def _pieces(clusters: DataFrame, columns: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """number, centre and other columns of all clusters, ordered by the length of the centre, in pieces of bounded size."""
    ordered = clusters.withColumn("_length", _square(F.col("centre"))).orderBy("_length", "number").select("number", "centre", *columns)
    held, size = [], 0
    for r in ordered.toLocalIterator():
        held.append(tuple(r))
        size += 8 * len(r[1]) + 64
        if size >= CENTRE_BYTES:
            yield [np.array(c, np.int64 if i == 0 else float) for i, c in enumerate(zip(*held))]
            held, size = [], 0
    if held:
        yield [np.array(c, np.int64 if i == 0 else float) for i, c in enumerate(zip(*held))]


def _search(frame: DataFrame, piece: list[np.ndarray], values: Callable, bound: Callable) -> DataFrame:
    """Lower ``best`` of every row (number, x, best, ...) by the piece's clusters other than its own.

    ``values(squared distances, row columns, cluster columns)`` are compared; a block of clusters is passed over
    for the rows whose ``best`` is at or below ``bound(least distance, row columns, cluster columns)``, where the
    distance is at least the difference of the lengths.
    """
    numbers, centres, *others = piece
    names = frame.columns
    length = np.sqrt((centres * centres).sum(axis=1))
    blocks = [slice(at, at + BLOCK_CLUSTERS) for at in range(0, len(numbers), BLOCK_CLUSTERS)]

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_VECTORS):
                batch = whole.slice(at, BLOCK_VECTORS)
                own = batch.column(0).to_numpy()
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                best = batch.column(2).to_numpy(zero_copy_only=False).copy()
                rest = [c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]]
                squares = (x * x).sum(axis=1)
                size = np.sqrt(squares)
                least = np.stack([np.maximum(0, np.maximum(length[b].min() - size, size - length[b].max())) for b in blocks])
                for i in np.argsort(least.sum(axis=1), kind="stable"):
                    block, theirs = blocks[i], [o[blocks[i]] for o in others]
                    # A little slack for rounding.
                    open_rows = np.flatnonzero(best > bound(least[i] * (1 - 1e-9), rest, theirs) - 1e-12)
                    if not len(open_rows):
                        continue
                    mine = [r[open_rows] for r in rest]
                    apart = squares[open_rows, None] + length[block] ** 2 - 2 * x[open_rows] @ centres[block].T
                    close = np.nonzero(apart <= 1e-9 * (squares[open_rows, None] + length[block] ** 2))
                    gap = x[open_rows[close[0]]] - centres[block][close[1]]
                    apart[close] = (gap * gap).sum(axis=1)
                    found = values(apart, mine, theirs)
                    found[own[open_rows, None] == numbers[block]] = np.inf
                    best[open_rows] = np.minimum(best[open_rows], found.min(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best), *batch.columns[3:]],
                                                 names=names)

    return frame.mapInArrow(lower, frame.schema)


def davies_bouldin(df: DataFrame, features: str, label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance.

    Clusters are compared in blocks, nearest lengths first; a block that cannot hold a worse one is passed over.
    """
    table = centroids(df, features, label).select("cluster", "centre")
    rows = df.select(F.col(label).alias("cluster"), F.col(features).cast("array<double>").alias("x"))
    spread = _numbered(_beside(rows, cut_lineage(table)).groupBy("cluster").agg(
        F.avg(F.sqrt(_gap(F.col("x"), F.col("centre")))).alias("spread"), F.first("centre").alias("centre")))
    frame = spread.select("number", F.col("centre").alias("x"), F.lit(float("inf")).alias("best"), "spread")

    def similarity(apart, mine, theirs):
        distance = np.sqrt(np.maximum(apart, 0))
        both = mine[0][:, None] + theirs[0]
        return -np.divide(both, distance, out=np.zeros_like(both), where=distance > 0)

    def most(least, mine, theirs):
        both = mine[0] + theirs[0].max()
        return -np.divide(both, least, out=np.full_like(both, np.inf), where=least > 0)

    for piece in _pieces(spread, ["spread"]):
        frame = _search(frame, piece, similarity, most)
    return frame.where(F.col("best") < float("inf")).agg(F.avg(-F.col("best")).alias("value")).where("value is not null").select(
        F.lit("davies_bouldin").alias("metric"), "value")


def silhouette(df: DataFrame, features: str, label: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, linear in the number of rows.

    The mean squared distance of a row to a cluster is its distance to the cluster's mean vector plus the
    cluster's variance, so no pair of rows is ever formed, and the nearest other cluster is found by lengths.
    """
    rows = df.select(F.col(label).alias("cluster"), F.col(features).cast("array<double>").alias("x")).where("x is not null")
    table = _numbered(rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("rows"),
        vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("centre"),
        F.avg(_square(F.col("x"))).alias("square"),
    ))
    dot = F.aggregate(F.zip_with("x", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    own = (_square(F.col("x")) + F.col("square") - 2 * dot) * F.col("rows") / (F.col("rows") - 1)
    frame = _beside(rows, table).select("number", "x", F.lit(float("inf")).alias("best"), "rows", F.when(F.col("rows") > 1, own).alias("a"))
    variance = F.greatest(F.col("square") - _square(F.col("centre")), F.lit(0.0)).alias("variance")
    for piece in _pieces(table.select("number", "centre", variance), ["variance"]):
        frame = _search(frame, piece, lambda apart, mine, theirs: apart + theirs[0],
                        lambda least, mine, theirs: least * least + theirs[0].min())
    return _mean_silhouette(frame.select("rows", "a", F.when(F.col("best") < float("inf"), F.col("best")).alias("b")))


def _mean_silhouette(rows: DataFrame) -> DataFrame:
    """From the size of a row's cluster, its mean distance ``a`` to that and ``b`` to the nearest other one."""
    ratio = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    value = F.when(F.col("rows") <= 1, F.lit(0.0)).otherwise(ratio)
    return rows.agg(F.avg(value).alias("value"), F.count("b").alias("_n")).where("_n > 0").select(
        F.lit("silhouette_score").alias("metric"), "value")


def euclidean_silhouette(df: DataFrame, features: str, label: str, chosen: Column) -> DataFrame:
    """Mean silhouette, with plain Euclidean distance, of the ``chosen`` rows against all rows.

    Plain distances have no closed form, so every chosen row meets every row: blocks of ``QUERY_ROWS`` chosen
    rows go to all tasks, which add up distances per chosen row and cluster. Choose a share of the rows that is
    worth that work, such as the ids divisible by a hundred.
    """
    rows = df.select(F.col(label).alias("cluster"), F.col(features).cast("array<double>").alias("x")).where("x is not null")
    parts, held, first = [], [], 0
    for r in df.where(chosen).select(F.col(label).alias("cluster"), F.col(features).cast("array<double>").alias("x")).where(
            "x is not null").toLocalIterator():
        held.append((r["cluster"], r["x"]))
        if len(held) == QUERY_ROWS:
            parts.append(_distance_sums(rows, held, first))
            first, held = first + QUERY_ROWS, []
    if held or not parts:
        parts.append(_distance_sums(rows, held, first))
    sums = reduce(DataFrame.unionByName, parts).groupBy("query", "cluster", "own").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    per = sums.groupBy("query").agg(
        F.max(F.when(F.col("own"), F.col("n"))).alias("rows"),
        F.max(F.when(F.col("own") & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~F.col("own"), F.col("total") / F.col("n"))).alias("b"))
    return _mean_silhouette(per)


def _distance_sums(rows: DataFrame, queries: list[tuple], first: int) -> DataFrame:
    """query, cluster, own (whether it is the query's), n and total: distances of the queries to all rows."""
    labels = [q[0] for q in queries]
    points = np.array([q[1] for q in queries], float).reshape(len(queries), -1) if queries else np.zeros((0, 1))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows if len(points) else 0, BLOCK_VECTORS):
                batch = whole.slice(at, BLOCK_VECTORS)
                code = batch.column(0).dictionary_encode("encode")
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                apart = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * x @ points.T
                distance = np.sqrt(np.maximum(apart, 0))
                # What is nearly zero is measured without the loss of digits.
                for i, j in zip(*np.nonzero(apart <= 1e-9 * (points * points).sum(axis=1))):
                    distance[i, j] = np.sqrt(((x[i] - points[j]) ** 2).sum())
                place = code.indices.to_numpy(zero_copy_only=False)
                for i, name in enumerate(code.dictionary.to_pylist()):
                    inside = place == i
                    n, total = held.get(name, (0, 0.0))
                    held[name] = n + int(inside.sum()), total + distance[inside].sum(axis=0)
        for name, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(labels))), pa.array([name] * len(labels), kind),
                 pa.array([label == name for label in labels]), pa.array(np.full(len(labels), n)), pa.array(total)],
                names=["query", "cluster", "own", "n", "total"])

    schema = T.StructType([T.StructField("query", T.LongType()), rows.schema["cluster"], T.StructField("own", T.BooleanType()),
                           T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType())])
    kind = to_arrow_type(rows.schema["cluster"].dataType)
    return rows.mapInArrow(sums, schema)


def spark_silhouette(df: DataFrame, features: str, label: str) -> float:
    """The same number from Spark ML, as a cross-check."""
    return ClusteringEvaluator(predictionCol=label, featuresCol="_v").evaluate(
        df.withColumn("_v", _vector(features)).withColumn(label, F.col(label).cast("double")))


def cluster_metrics(df: DataFrame, features: str, label: str) -> DataFrame:
    parts = [
        cluster_dispersion(df, features, label), silhouette(df, features, label),
        davies_bouldin(df, features, label), cluster_sizes(df, label),
    ]
    return reduce(DataFrame.unionByName, parts)


def explain(metrics: DataFrame) -> DataFrame:
    """Add what each metric measures, its range and the wanted end, as one text."""
    texts = F.create_map(*[F.lit(t) for name, parts in EXPLANATIONS.items() for t in (name, "; ".join(parts))])
    return metrics.withColumn(
        "explanation", F.coalesce(F.try_element_at(texts, F.col("metric")), F.lit(NO_EXPLANATION)))
