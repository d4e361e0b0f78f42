"""Training jobs on Spark ML: forecasters, classifiers, clusters, folds and search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import metrics, prep, split, windows

FEATURES = "features"
# Defaults of the clustering and of the search.
KMEANS = {"k": 8, "maxIter": 300, "tol": 1e-4, "seed": 42}
SEED = 42
THREADS = 4
MAX_CLASSES = 1000
# A closed-form fit sums the products of so many columns at most.
MAX_GRAM_COLUMNS = 40


@contextmanager
def kept(df: DataFrame):
    """Keep a table that several fits read; it spills to disk and is recomputed if lost."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Even partitions for a table that is read many times.

    A job that passes over its rows again and again waits for the largest input
    split every time; one shuffle of the few training columns removes that.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts)


def in_threads(spark: SparkSession, jobs: Sequence[Callable], threads: int = THREADS) -> list:
    """Submit Spark jobs together; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


# --------------------------------------------------------------------------
# supervised models, one per output


@dataclass
class BoostedClasses:
    """Boosting for any number of classes: a model per class tells it from all others.

    The probability of a class is its model's, divided by the sum over all classes; the prediction is the
    likeliest class, the first of equally likely ones.
    """

    models: list[Transformer]
    classes: list[float]

    @property
    def numFeatures(self) -> int:  # noqa: N802 - as Spark's models call it
        return self.models[0].numFeatures

    def add(self, df: DataFrame, name: str, chances: str) -> DataFrame:
        """Add the prediction and the array of class probabilities."""
        scored, own = df, []
        for i, model in enumerate(self.models):
            raw, probability, label = f"_raw_{name}_{i}", f"_own_{name}_{i}", f"_label_{name}_{i}"
            view = model.copy().setPredictionCol(label).setRawPredictionCol(raw).setProbabilityCol(probability)
            scored = view.transform(scored).withColumn(probability, vector_to_array(probability)[1]).drop(raw, label)
            own.append(probability)
        total = sum((F.col(c) for c in own[1:]), F.col(own[0]))
        scored = scored.withColumn(chances, F.array(*[F.col(c) / total for c in own])).drop(*own)
        best = F.array_position(chances, F.array_max(chances)).cast("int")
        return scored.withColumn(name, F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), best))


@dataclass
class OutputModels:
    """One fitted model per output; ``steps`` and ``targets`` describe their order."""

    models: list[Transformer | BoostedClasses]
    steps: int = 1
    targets: int = 1

    @property
    def width(self) -> int:
        return self.models[0].numFeatures

    def class_counts(self) -> list[int]:
        """Number of classes of each output, 0 for a number."""
        return [len(m.classes) if isinstance(m, BoostedClasses) else m.numClasses if m.hasParam("probabilityCol") else 0
                for m in self.models]

    def transform(self, df: DataFrame, out: str = "prediction", probabilities: bool = False) -> DataFrame:
        """Add the predictions as one array, step after step, targets in order.

        With ``probabilities`` a classifier's entry is the probability of its second class; if any output has
        more than two classes, every entry is the array of its class probabilities.
        """
        counts = self.class_counts()
        if probabilities and 0 in counts and max(counts) > 0:
            raise ValueError("probabilities need classifiers for all outputs")
        scored, names = df, []
        for i, model in enumerate(self.models):
            name, raw, chances = f"_p{i}", f"_raw{i}", f"_prob{i}"
            if isinstance(model, BoostedClasses):
                scored = model.add(scored, name, chances)
            else:
                view = model.copy().setPredictionCol(name)
                if counts[i]:
                    view = view.setRawPredictionCol(raw).setProbabilityCol(chances)
                scored = view.transform(scored)
                if counts[i]:
                    scored = scored.withColumn(chances, vector_to_array(chances))
            if probabilities and counts[i]:
                scored = scored.withColumn(name, F.col(chances) if max(counts) > 2 else F.get(chances, F.lit(1)))
            scored = scored.drop(raw, chances)
            names.append(name)
        return scored.withColumn(out, F.array(*names)).drop(*names)


def learner(kind: str, **params) -> Estimator:
    kinds = {"gbt": GBTRegressor, "gbt_classifier": GBTClassifier, "forest_classifier": RandomForestClassifier,
             "linear": LinearRegression}
    if kind not in kinds:
        raise ValueError(f"unknown model kind: {kind}")
    return kinds[kind](featuresCol=FEATURES, **params)


def fit_outputs(
    df: DataFrame,
    outputs: Sequence[Column],
    kind: str = "gbt",
    shape: tuple[int, int] | None = None,
    validation: str | None = None,
    threads: int = THREADS,
    weight: str | None = None,
    **params,
) -> OutputModels:
    """Fit one model per output on the ``features`` vector.

    Rows flagged in ``validation`` stop boosting early instead of training it. ``weight`` names a column
    of row weights. A boosted classifier whose labels are not 0 and 1 gets a model per class, all fitted on
    the same kept rows; more than ``MAX_CLASSES`` classes are an error.
    """
    labels = {f"_y{i}": y.cast("double") for i, y in enumerate(outputs)}
    extra = [c for c in (validation, weight) if c]
    if weight:
        params = {**params, "weightCol": weight}
    rows = df.select(FEATURES, *extra, *[v.alias(k) for k, v in labels.items()])
    # Boosting passes over the rows many times, a linear fit once or twice.
    with kept(spread(rows) if kind.startswith(("gbt", "forest")) else rows) as table:
        def job(label: str, one: float | None):
            options = dict(params, labelCol=label)
            if validation and kind.startswith("gbt"):
                options["validationIndicatorCol"] = validation
            data = table.where(F.col(label).isNotNull())
            if validation and not kind.startswith("gbt"):
                data = data.where(~F.col(validation))
            if one is not None:
                data = data.withColumn(label, (F.col(label) == one).cast("double"))
            return learner(kind, **options).fit(data)

        classes = {label: _classes(table, label) if kind == "gbt_classifier" else [] for label in labels}
        jobs = [(label, one) for label in labels for one in (classes[label] or [None])]
        fitted = iter(in_threads(df.sparkSession, [lambda j=j: job(*j) for j in jobs], threads))
        models = [BoostedClasses([next(fitted) for _ in classes[label]], classes[label]) if classes[label] else next(fitted)
                  for label in labels]
    steps, targets = shape or (1, len(models))
    return OutputModels(models, steps, targets)


def _classes(table: DataFrame, label: str) -> list[float]:
    """The classes in order, if they are not just 0 and 1."""
    found = sorted(r[0] for r in table.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return [] if set(found) <= {0.0, 1.0} else found


def complete(df: DataFrame, value: str) -> DataFrame:
    """Rows whose array has no null and no NaN."""
    return df.where(~F.exists(value, lambda v: v.isNull() | F.isnan(v)))


def gap_free(features: DataFrame, width: int) -> tuple[DataFrame, str]:
    """The rows with a flag that says whether ``_flat`` has ``width`` values and no gap, and gaps replaced by 0.

    A model can then be applied to every row, and the flag tells which predictions mean something. Filters
    may be pushed below the model, so it must bear arrays of any length.
    """
    whole = "_whole"
    fits = F.coalesce(F.size("_flat") == width, F.lit(False))
    flagged = features.withColumn(whole, fits & ~F.exists("_flat", lambda v: v.isNull() | F.isnan(v)))
    filled = F.when(fits, F.transform("_flat", lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))).otherwise(
        F.array_repeat(F.lit(0.0), width))
    return flagged.withColumn(FEATURES, array_to_vector(filled)).drop("_flat"), whole


def predict_all(model: OutputModels, features: DataFrame, out: str = "prediction", probabilities: bool = False) -> DataFrame:
    """Predictions for every row that has ``_flat``; a row with a gap in it gets null."""
    ready, whole = gap_free(features, model.width)
    scored = model.transform(ready, out, probabilities)
    return scored.withColumn(out, F.when(F.col(whole), F.col(out))).drop(whole)


def window_features(frame: DataFrame) -> DataFrame:
    """Windows without missing values, flattened to the feature vector; for training and evaluation."""
    return complete(frame.withColumn("_flat", windows.flat("x")), "_flat").withColumn(
        FEATURES, array_to_vector("_flat")).drop("_flat")


def fit_forecaster(
    frame: DataFrame, steps: int, targets: int, kind: str = "gbt", dataset: str | None = None, **params
) -> OutputModels:
    """Fit windows (``x``, ``y``); rows tagged ``val`` in ``dataset`` serve early stopping."""
    ready = window_features(frame)
    validation = None
    if dataset:
        ready = ready.where(F.col(dataset).isin("train", "val")).withColumn("_val", F.col(dataset) == "val")
        validation = "_val"
    outputs = [F.col("y")[s][t] for s in range(steps) for t in range(targets)]
    return fit_outputs(ready, outputs, kind, (steps, targets), validation, **params)


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="skip").transform(df)


# --------------------------------------------------------------------------
# unsupervised stages and pipelines of stages


def fit_kmeans(df: DataFrame, features: str = FEATURES, out: str = "cluster", **params):
    with kept(spread(df.select(features))) as table:
        return KMeans(featuresCol=features, predictionCol=out, **{**KMEANS, **params}).fit(table)


def fit_pca(df: DataFrame, columns: Sequence[str], k: int = 2, strategy: str = "mean"):
    """Impute, centre and project; the centring is explicit because the projection has none."""
    return fit_stages(df.select(*columns), Pipeline(stages=[
        Imputer(strategy=strategy, inputCols=list(columns), outputCols=[f"_i_{c}" for c in columns]),
        VectorAssembler(inputCols=[f"_i_{c}" for c in columns], outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False),
        PCA(k=k, inputCol="_c", outputCol="pca"),
    ]))


class ExactImputer(Estimator):
    """An imputer with exact medians, of two in the middle the smaller one.

    Asked for no error, Spark's own estimator keeps and merges every value of a column, in the end on the driver.
    Here the medians are found by their ranks, and its model comes from one row that holds them.
    """

    def __init__(self, plain: Imputer):
        super().__init__()
        self.plain = plain

    def _fit(self, dataset: DataFrame) -> Transformer:
        missing, found = F.lit(self.plain.getMissingValue()), []
        for c in self.plain.getInputCols():
            value = F.col(c).cast("double")
            rows = dataset.select(value.alias("_value")).where(~F.isnan("_value") & (F.col("_value") != missing))
            middle = split.lower_median(rows, "_value")
            found.append((F.lit(None).cast("double") if middle is None else middle).alias(c))
        return self.plain.copy().setStrategy("mean").fit(dataset.sparkSession.range(1).select(*found))


def imputer(columns: Sequence[str], out: Sequence[str], **params) -> Estimator:
    """Spark's imputer; a median without error is found by its rank."""
    plain = Imputer(inputCols=list(columns), outputCols=list(out), **params)
    exact = plain.getStrategy() == "median" and plain.getRelativeError() == 0
    return ExactImputer(plain) if exact else plain


def stage(kind: str, columns: Sequence[str], out: str | Sequence[str], **params) -> Pipeline:
    """A feature stage by name, wired by column names: imputer, scaler, components or clusters."""
    vector = VectorAssembler(inputCols=list(columns), outputCol=f"_{kind}_in")
    if kind == "imputer":
        return Pipeline(stages=[imputer(columns, out, **params)])
    if kind == "scaler":
        return Pipeline(stages=[vector, StandardScaler(inputCol="_scaler_in", outputCol=out, **params)])
    if kind == "pca":
        centre = StandardScaler(inputCol="_pca_in", outputCol="_pca_c", withMean=True, withStd=False)
        return Pipeline(stages=[vector, centre, PCA(inputCol="_pca_c", outputCol=out, **params)])
    if kind == "kmeans":
        return Pipeline(stages=[vector, KMeans(featuresCol="_kmeans_in", predictionCol=out, **{**KMEANS, **params})])
    raise ValueError(f"unknown stage: {kind}")


def staged_model(
    columns: Sequence[str], label: str, clusters: int = 3, components: int = 2, kind: str = "gbt", **params
) -> Pipeline:
    """Imputed columns, their components and their cluster id feed one model."""
    imputed = [f"_i_{c}" for c in columns]
    return Pipeline(stages=[
        imputer(columns, imputed, strategy="median", relativeError=0.0),
        VectorAssembler(inputCols=imputed, outputCol="_v"),
        StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=True),
        PCA(k=components, inputCol="_c", outputCol="pca"),
        KMeans(featuresCol="_c", predictionCol="cluster", **{**KMEANS, "k": clusters}),
        VectorAssembler(inputCols=[*imputed, "pca", "cluster"], outputCol=FEATURES),
        learner(kind, labelCol=label, **params),
    ])


def fit_stages(df: DataFrame, stages: Pipeline) -> PipelineModel:
    """Fit a pipeline of stages on evenly spread, kept rows."""
    with kept(spread(df)) as table:
        return stages.fit(table)


def fit_together(df: DataFrame, estimators: dict[str, Estimator], threads: int = THREADS) -> dict[str, Transformer]:
    """Fit several models on one table at the same time; any failure is raised."""
    with kept(spread(df)) as table:
        fitted = in_threads(df.sparkSession, [lambda e=e: e.fit(table) for e in estimators.values()], threads)
    return dict(zip(estimators, fitted))


# --------------------------------------------------------------------------
# folds and search


def evaluate_fold(
    fold: DataFrame, features: Sequence[str], target: str, steps: Sequence[dict], kind: str = "gbt",
    dataset: str = "dataset", **params,
) -> DataFrame:
    """Preprocessing and model from the training rows, metrics from the test rows."""
    ready, _ = prep.fit_apply(fold, steps, dataset)
    table = assemble(ready, features)
    model = fit_outputs(table.where(F.col(dataset) == "train"), [F.col(target)], kind, **params)
    scored = model.transform(table.where(F.col(dataset) == "test"))
    scored = scored.select(F.col(target).alias("y"), F.col("prediction")[0].alias("p"))
    if kind == "gbt_classifier":
        return metrics.classification_metrics(scored, "y", "p", False)
    return metrics.forecast_metrics(scored, [("y", "p")])


def _plain_line(kind: str, width: int, target: str, steps: Sequence[dict], params: dict) -> bool:
    """Whether the fit is least squares whose predictions the steps do not change.

    Scaling inputs changes nothing about a line with an intercept.
    """
    scaled = all(s["name"] == "normalize" and target not in s["columns"] for s in steps)
    return (kind == "linear" and set(params) <= {"fitIntercept"} and width < MAX_GRAM_COLUMNS
            and (not steps or scaled and params.get("fitIntercept", True)))


def moments(rows: DataFrame, width: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per ``fold`` the number of rows, the means and the covariances of the values of ``x`` and of ``y``."""
    columns = [F.col("x")[i] for i in range(width)] + [F.col("y")]
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    # One row per fold reaches the driver.
    found = rows.where("y is not null").groupBy("fold").agg(
        F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.covar_pop(columns[i], columns[j]) for i, j in pairs]).collect()
    out = {}
    for fold, n, *values in found:
        spread_of = np.zeros((width + 1, width + 1))
        for (i, j), value in zip(pairs, values[width + 1:], strict=True):
            spread_of[i, j] = spread_of[j, i] = value
        out[fold] = float(n), np.array(values[: width + 1]), spread_of
    return out


def pooled(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several sets of rows together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n


def solve_line(moment: tuple[float, np.ndarray, np.ndarray], intercept: bool = True) -> tuple[float, list[float]]:
    """Intercept and coefficients of least squares; inputs that say nothing new get the smallest coefficients."""
    _, mean, spread_of = moment
    if not intercept:
        spread_of = spread_of + np.outer(mean, mean)
    scale = np.sqrt(np.diag(spread_of)[:-1])
    scale[scale == 0] = 1
    gram = spread_of[:-1, :-1] / np.outer(scale, scale)
    weights = np.linalg.lstsq(gram, spread_of[:-1, -1] / scale, rcond=1e-12)[0] / scale
    return (float(mean[-1] - mean[:-1] @ weights) if intercept else 0.0), [float(w) for w in weights]


def line_errors(rows: DataFrame, lines: dict[int, tuple[float, list[float]]]) -> DataFrame:
    """Forecast metrics per ``fold`` of each fold's line on its rows, in one scan: metric, value."""
    table = F.create_map(*[c for fold, (start, weights) in lines.items() for c in (
        F.lit(fold), F.array(F.lit(start), *[F.lit(w) for w in weights]))])
    line = F.element_at(table, F.col("fold"))
    products = F.zip_with("x", F.slice(line, 2, F.size("x")), lambda x, w: x * w)
    scored = rows.select("fold", "y", (line[0] + F.aggregate(products, F.lit(0.0), lambda a, b: a + b)).alias("p"))
    return metrics.forecast_metrics(scored, [("y", "p")], by=["fold"]).select("metric", "value")


def cross_validate(
    df: DataFrame, k: int, key: Sequence[str], features: Sequence[str], target: str,
    steps: Sequence[dict] = (), kind: str = "gbt", seed: int = SEED, stratify: bool = False, **params,
) -> DataFrame:
    """Mean and deviation of every metric over ``k`` random folds.

    Least squares needs one scan for all fits, the moments of every fold, from which those of all other
    folds together follow, and one for all errors. Other models are fitted fold by fold.
    """
    folded = (split.stratified_kfold(df, k, target, key, seed) if stratify
              else split.kfold(df, k, key, seed))
    if _plain_line(kind, len(features), target, steps, params):
        x = F.array(*[F.col(c).cast("double") for c in features])
        rows = complete(folded.select("fold", x.alias("x"), F.col(target).cast("double").alias("y")), "x")
        held = moments(rows, len(features))
        lines = {i: solve_line(pooled([m for j, m in held.items() if j != i]), params.get("fitIntercept", True))
                 for i in range(k)}
        return metrics.fold_summary(line_errors(rows, lines))
    with kept(spread(folded)) as table:
        def job(i: int) -> list:
            tagged = table.withColumn("dataset", F.when(F.col("fold") == i, "test").otherwise("train")).drop("fold")
            return evaluate_fold(tagged, features, target, steps, kind, **params).collect()  # one row per metric

        rows = in_threads(df.sparkSession, [lambda i=i: job(i) for i in range(k)])
    per_fold = df.sparkSession.createDataFrame([r for part in rows for r in part], "metric string, value double")
    return metrics.fold_summary(per_fold)


def cross_validate_series(
    df: DataFrame, k: int, features: Sequence[str], targets: Sequence[str], order: Sequence[str],
    input_len: int, output_len: int, keys: Sequence[str] = (), ratios: dict | None = None,
    kind: str = "linear", **params,
) -> DataFrame:
    """Growing prefixes of time; each is windowed and split again by the ratios.

    The windows of a prefix are those windows of the whole table that end inside it, so they are made once:
    a series needs only the number of its rows in each prefix. Least squares with a single output takes
    one scan for all fits and one for all errors.
    """
    span = input_len + output_len
    prefixes = split.expanding_prefixes(df, order, k, input_len, output_len)
    frame = windows.supervised_windows(df, features, targets, order, input_len, output_len, keys)
    held = F.array(*[F.count(F.when(inside, F.lit(1))) for inside in prefixes])
    if keys:
        names = [F.col(c).alias(f"_k_{c}") for c in keys]
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys])
        frame = frame.join(df.groupBy(*names).agg(held.alias("_held")), same).drop(*[f"_k_{c}" for c in keys])
    else:
        frame = frame.withColumn("_held", F.array(*[F.lit(n) for n in df.agg(held).first()[0]]))
    in_fold = lambda i: F.col("window_index") <= F.get("_held", i) - span
    count = lambda i: F.get("_held", i) - span + 1
    with kept(frame) as made:
        if output_len * len(targets) == 1 and _plain_line(kind, len(features) * input_len, "", (), params):
            cells = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(prefixes) - 1)), lambda i: F.struct(
                i.alias("fold"), count(i).alias("window_count"))), lambda c: F.col("window_index") < c["window_count"])
            rows = made.select("window_index", windows.flat("x").alias("x"), F.col("y")[0][0].alias("y"), F.explode(cells).alias("c"))
            rows = split.tag_windows(complete(rows.select("c.*", "window_index", "x", "y"), "x"), ratios)
            lines = {i: solve_line(m, params.get("fitIntercept", True)) for i, m in moments(
                rows.where("dataset = 'train'"), len(features) * input_len).items()}
            # The kept windows go when this block ends, so the few errors are brought here first.
            found = line_errors(rows.where("dataset = 'test'"), lines).collect()
        else:
            def job(i: int) -> list:
                prefix = made.where(in_fold(F.lit(i))).withColumn("window_count", count(F.lit(i)))
                tagged = split.tag_windows(prefix, ratios)
                model = fit_forecaster(tagged, output_len, len(targets), kind, "dataset", **params)
                scored = model.transform(window_features(tagged.where("dataset = 'test'")))
                return forecast_errors(scored, output_len, len(targets)).collect()  # one row per metric

            found = [r for part in in_threads(df.sparkSession, [lambda i=i: job(i) for i in range(len(prefixes))]) for r in part]
    return metrics.fold_summary(df.sparkSession.createDataFrame(found, "metric string, value double"))


def forecast_errors(scored: DataFrame, steps: int, targets: int, aggregate: str | None = "mean") -> DataFrame:
    """Forecast metrics of windows with truth ``y`` and flat ``prediction``."""
    outputs = [(s, t) for s in range(steps) for t in range(targets)]
    flat = scored.select(*[
        column for i, (s, t) in enumerate(outputs)
        for column in (F.col("y")[s][t].alias(f"y{i}"), F.col("prediction")[i].alias(f"p{i}"))
    ])
    return metrics.forecast_metrics(flat, [(f"y{i}", f"p{i}") for i in range(len(outputs))], aggregate)


def draw(space: dict[str, dict], rng: random.Random) -> dict:
    """One random setting from int, float (optionally log) and categorical ranges."""
    setting = {}
    for name, spec in space.items():
        kind, bounds = spec["type"], spec["range"]
        if kind == "int":
            step = spec.get("step", 1)
            setting[name] = rng.randrange(bounds[0], bounds[1] + 1, step)
        elif kind == "float" and spec.get("log"):
            setting[name] = math.exp(rng.uniform(math.log(bounds[0]), math.log(bounds[1])))
        elif kind == "float":
            setting[name] = rng.uniform(*bounds)
        elif kind == "categorical":
            setting[name] = rng.choice(bounds)
        else:
            raise ValueError(f"unknown parameter type: {kind}")
    return setting


def search(
    space: dict[str, dict],
    evaluate: Callable[[dict], DataFrame],
    metric: str,
    trials: int,
    fixed: dict | None = None,
    direction: str = "minimize",
    seed: int = SEED,
    threads: int = 1,
) -> tuple[dict, float, list[tuple[dict, float]]]:
    """Seeded random search. ``evaluate`` gives (metric, value) rows; fixed values win.

    The settings are drawn first, so several ``threads`` try the same ones as one does.
    """
    if not space:
        raise ValueError("the search space is empty")
    rng = random.Random(seed)
    settings = [{**draw(space, rng), **(fixed or {})} for _ in range(trials)]

    def trial(setting: dict) -> tuple[dict, float]:
        values = {r["metric"]: r["value"] for r in evaluate(setting).collect()}
        if metric not in values:
            raise ValueError(f"no metric {metric}, only {sorted(values)}")
        return setting, values[metric]

    if threads > 1:
        spark = SparkSession.getActiveSession()
        tried = in_threads(spark, [lambda s=s: trial(s) for s in settings], threads)
    else:
        tried = [trial(setting) for setting in settings]
    pick = min if direction == "minimize" else max
    best = pick(tried, key=lambda t: t[1])
    return best[0], best[1], tried


def search_and_fit(
    space: dict[str, dict], evaluate: Callable[[dict], DataFrame], fit: Callable[[dict], OutputModels], metric: str,
    trials: int, **options,
) -> tuple[OutputModels, dict, float]:
    """Search, then train once more with the best setting."""
    best, value, _ = search(space, evaluate, metric, trials, **options)
    return fit(best), best, value
