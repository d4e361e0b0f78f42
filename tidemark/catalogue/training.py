"""Training and scoring jobs. Models without a closed form have no SQL twin; tests check their properties."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, r6, rounded, table
from tidemark.catalogue.store import every_user, shop
from tidemark.operators import prep, split, windows
from tidemark.plans import scoring, training

ORDER = ["ts", "event_id"]
BOOST = {"maxIter": 5, "maxDepth": 3, "seed": 42}


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "value")


def tagged_windows(spark, folder, input_len=8, output_len=2):
    """Windows per user, the earliest 60 % for training, the next 20 % to stop early."""
    frame = windows.supervised_windows(
        events(spark, folder), ["value"], ["value"], ORDER, input_len, output_len, ["user_id"])
    return split.tag_windows(frame)


def items(spark, folder):
    return table(spark, folder, "lineitem").select(
        *ITEM_KEY, "l_quantity", "l_discount", "l_tax", "l_extendedprice", F.col("l_returnflag").alias("flag"))


ITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ITEM_COLUMNS = ["l_quantity", "l_discount", "l_tax"]


@query()
def boosted_forecast(spark, folder):
    """Boosted trees on flat windows, one per step, evaluated on the last windows of each user."""
    frame = tagged_windows(spark, folder).persist()
    model = training.fit_forecaster(frame, 2, 1, "gbt", "dataset", **BOOST)
    return rounded(scoring.evaluate(frame, model, 2, 1), "value")


@query()
def linear_forecast(spark, folder):
    frame = tagged_windows(spark, folder).persist()
    model = training.fit_forecaster(frame, 2, 1, "linear", "dataset")
    return rounded(scoring.evaluate(frame, model, 2, 1), "value")


@query()
def boosted_classifier(spark, folder):
    data = training.assemble(
        items(spark, folder).withColumn("late", (F.col("l_extendedprice") > 45000).cast("int")), ITEM_COLUMNS)
    tagged = split.random_split(data, ITEM_KEY)
    model = training.fit_outputs(tagged.where("dataset = 'train'"), [F.col("late")], "gbt_classifier", **BOOST)
    scored = model.transform(tagged.where("dataset = 'test'"), probabilities=True)
    scored = scored.select("late", F.col("prediction")[0].alias("p"))
    return rounded(scoring.evaluate_rows(scored, "late", "p", "classification"), "value")


@query()
def kmeans_clusters(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", training.array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = training.fit_kmeans(vectors, k=4)
    return model.transform(vectors).groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))


@query()
def pca_feature(spark, folder):
    data = items(spark, folder)
    columns = [*ITEM_COLUMNS, "l_extendedprice"]
    scored = training.fit_pca(data, columns).transform(data)
    parts = vector_to_array("pca")
    return scored.select("l_orderkey", "l_linenumber", r6(F.abs(parts[0])).alias("size_0"), r6(F.abs(parts[1])).alias("size_1"))


@query()
def cluster_as_feature(spark, folder):
    """Imputer, components and cluster id feed one boosted model."""
    data = items(spark, folder)
    model = training.fit_stages(data, training.staged_model(ITEM_COLUMNS, "l_extendedprice", **BOOST))
    return scoring.score_stages(data, model).select(
        "l_orderkey", "l_linenumber", "cluster", F.round("prediction", 3).alias("prediction"))


@query()
def models_together(spark, folder):
    """Three models fitted on one kept table from driver threads, predictions side by side."""
    data = training.assemble(items(spark, folder), ITEM_COLUMNS)
    label = {"labelCol": "l_extendedprice", "featuresCol": "features"}
    fitted = training.fit_together(data, {
        "boosted": GBTRegressor(predictionCol="boosted", **label, **BOOST),
        "linear": LinearRegression(predictionCol="linear", **label),
        "groups": KMeans(featuresCol="features", predictionCol="groups", **{**training.KMEANS, "k": 3, "maxIter": 20}),
    })
    out = data
    for model in fitted.values():
        out = model.transform(out)
    return out.select("l_orderkey", "l_linenumber", "boosted", "linear", "groups")


@query()
def cross_validation(spark, folder):
    steps = [{"name": "normalize", "columns": ITEM_COLUMNS}]
    data = items(spark, folder).drop("flag")
    return rounded(training.cross_validate(
        data, 3, ITEM_KEY, ITEM_COLUMNS, "l_extendedprice", steps, "linear"), "value")


@query()
def cross_validation_in_time(spark, folder):
    return rounded(training.cross_validate_series(
        events(spark, folder), 3, ["value"], ["value"], ORDER, 8, 2, ["user_id"]), "value")


@query()
def parameter_search(spark, folder):
    data = items(spark, folder).drop("flag")
    space = {"regParam": {"type": "float", "range": [0.001, 1.0], "log": True},
             "maxIter": {"type": "int", "range": [5, 20], "step": 5},
             "fitIntercept": {"type": "categorical", "range": [True, False]}}
    with training.kept(data) as rows:
        _, _, tried = training.search(
            space, lambda setting: training.cross_validate(
                rows, 2, ITEM_KEY, ITEM_COLUMNS, "l_extendedprice", (), "linear", **setting),
            "mae_mean", 3, fixed={"elasticNetParam": 0.0})
    rows = [(i, str(sorted(s.items())), float(v)) for i, (s, v) in enumerate(tried)]
    return spark.createDataFrame(rows, "trial int, setting string, mae_mean double")


def naive_model(spark, folder, input_len=12, output_len=2):
    frame = windows.supervised_windows(events(spark, folder), ["value"], ["value"], ORDER, input_len, output_len, ["user_id"])
    return training.fit_forecaster(frame, output_len, 1, "linear")


@query()
def score_rows(spark, folder):
    data = items(spark, folder)
    steps = [{"name": "normalize", "columns": ["l_quantity"]}]
    state = prep.fit(data, steps)
    ready = training.assemble(prep.apply(data, state, steps), ITEM_COLUMNS)
    model = training.fit_outputs(ready, [F.col("l_extendedprice")], "linear")
    scored = scoring.score_rows(data, model, ITEM_COLUMNS, state, steps)
    return scored.select("l_orderkey", "l_linenumber", F.round(F.col("prediction")[0], 3).alias("prediction"))


@query()
def score_windows(spark, folder):
    scored = scoring.score_windows(
        events(spark, folder), naive_model(spark, folder), ["value"], ORDER, 12, 2, ["user_id"])
    return scored.select("user_id", "window_index", F.posexplode("prediction").alias("step", "prediction"))


@query()
def score_entities(spark, folder):
    """Online sequences of all users, gaps filled from history, one forecast each."""
    rows = shop(spark, folder).online_sequence(
        ["viewed:value"], 12, 1, every_user(spark, folder), "user_id", "2024-01-30T00:00:00", ordered=False)
    steps = [{"name": "fill_missing", "method": "mean", "columns": ["value"]}]
    state = prep.fit(events(spark, folder), steps)
    return scoring.score_entities(
        rows, naive_model(spark, folder), ["value"], ["event_timestamp"], 12, "user_id", state=state, steps=steps)


@query()
def score_steps_ahead(spark, folder):
    return scoring.score_steps_ahead(
        events(spark, folder), naive_model(spark, folder), ["value"], ORDER, 12, 2, 6, ["user_id"])


# --------------------------------------------------------------------------
# Linear models with one input have a closed form, so SQL can check the whole
# path: windows or folds, fit, scoring, metrics.

LINE = """WITH e AS (SELECT user_id, ts, value AS x, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n,
  lead(value, 1) OVER w AS y0, lead(value, 2) OVER w AS y1
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
{train}
m AS (SELECT regr_slope(y0, x) AS b0, regr_intercept(y0, x) AS a0, regr_slope(y1, x) AS b1, regr_intercept(y1, x) AS a1 FROM t)
"""
FITTED = LINE.format(train="t AS (SELECT * FROM e WHERE r + 2 < n),")


def next_values_model(spark, folder):
    """Predict a user's next two values from the current one."""
    frame = windows.supervised_windows(events(spark, folder), ["value"], ["value"], ORDER, 1, 2, ["user_id"])
    return training.fit_forecaster(frame, 2, 1, "linear")


@query(FITTED + """SELECT user_id, r // 2 AS window_index, s.step::INT AS step,
  round(CASE WHEN s.step = 0 THEN a0 + b0 * x ELSE a1 + b1 * x END, 3) + 0.0 AS prediction
FROM e, m, range(2) s(step) WHERE r % 2 = 0""")
def line_windows(spark, folder):
    frame = windows.inference_windows(events(spark, folder), ["value"], ORDER, 1, 2, ["user_id"])
    scored = next_values_model(spark, folder).transform(training.window_features(frame))
    cells = scored.select("user_id", "window_index", F.posexplode("prediction").alias("step", "prediction"))
    return cells.withColumn("prediction", F.round("prediction", 3) + 0.0)


@query(FITTED + """SELECT user_id, s.step::INT AS step, (CASE WHEN s.step = 0 THEN a0 + b0 * x ELSE a1 + b1 * x END)::FLOAT::DOUBLE AS prediction
FROM e, m, range(2) s(step) WHERE r = n - 1""")
def line_entities(spark, folder):
    """One forecast per user from the last row, as 32-bit floats."""
    scored = scoring.score_entities(
        events(spark, folder), next_values_model(spark, folder), ["value"], ORDER, 1, "user_id")
    return scored.select("user_id", F.posexplode("predictions").alias("step", "prediction")).withColumn(
        "prediction", F.col("prediction").cast("double"))


@query(FITTED + """SELECT user_id, (2 * r + s.step)::INT AS step,
  (CASE WHEN s.step = 0 THEN a0 + b0 * x ELSE a1 + b1 * x END)::FLOAT::DOUBLE AS prediction
FROM e, m, range(2) s(step) WHERE r < 3""")
def line_steps_ahead(spark, folder):
    """Three blocks of two steps; each block starts one row later."""
    scored = scoring.score_steps_ahead(
        events(spark, folder), next_values_model(spark, folder), ["value"], ORDER, 1, 2, 6, ["user_id"])
    return scored.select("user_id", F.posexplode("predictions").alias("step", "prediction")).withColumn(
        "prediction", F.col("prediction").cast("double"))


GAPS = FITTED.replace("FROM t)", "FROM t),\ng AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN x END AS gx FROM e)").replace(
    "SELECT user_id, ts, value AS x", "SELECT user_id, ts, event_id, value AS x")


def gapped(spark, folder):
    """The events with every fifth value missing."""
    return events(spark, folder).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))


@query(GAPS + """SELECT user_id, r // 2 AS window_index, (a0 + b0 * gx)::FLOAT::DOUBLE AS step_0, (a1 + b1 * gx)::FLOAT::DOUBLE AS step_1
FROM g, m WHERE r % 2 = 0""")
def line_windows_gaps(spark, folder):
    """A window with a missing value stays, with null predictions."""
    scored = scoring.score_windows(gapped(spark, folder), next_values_model(spark, folder), ["value"], ORDER, 1, 2, ["user_id"])
    return scored.select("user_id", "window_index", *[F.col("prediction")[i].cast("double").alias(f"step_{i}") for i in (0, 1)])


@query(GAPS + """SELECT user_id, (a0 + b0 * gx)::FLOAT::DOUBLE AS step_0, (a1 + b1 * gx)::FLOAT::DOUBLE AS step_1 FROM g, m WHERE r = n - 1""")
def line_entities_gaps(spark, folder):
    """An entity whose last value is missing stays, with a null prediction."""
    scored = scoring.score_entities(gapped(spark, folder), next_values_model(spark, folder), ["value"], ORDER, 1, "user_id")
    return scored.select("user_id", *[F.col("predictions")[i].cast("double").alias(f"step_{i}") for i in (0, 1)])


@query(GAPS + """SELECT user_id, (2 * r + s.step)::INT AS step,
  (CASE WHEN s.step = 0 THEN a0 + b0 * gx ELSE a1 + b1 * gx END)::FLOAT::DOUBLE AS prediction
FROM g, m, range(2) s(step) WHERE r < 3""")
def line_steps_ahead_gaps(spark, folder):
    """A block whose window has a missing value keeps its place."""
    scored = scoring.score_steps_ahead(
        gapped(spark, folder), next_values_model(spark, folder), ["value"], ORDER, 1, 2, 6, ["user_id"])
    return scored.select("user_id", F.posexplode("predictions").alias("step", "prediction")).withColumn(
        "prediction", F.col("prediction").cast("double"))


@query("""
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 <> 0 THEN round(a + b * l_quantity, 3) + 0.0 END AS prediction FROM lineitem, m
""")
def line_rows_gaps(spark, folder):
    """A row with a missing value stays, with a null prediction."""
    data = items(spark, folder)
    model = training.fit_outputs(training.assemble(data, ["l_quantity"]), [F.col("l_extendedprice")], "linear")
    holes = data.withColumn("l_quantity", F.when(F.col("l_partkey") % 4 != 0, F.col("l_quantity")))
    scored = scoring.score_rows(holes, model, ["l_quantity"])
    return scored.select("l_orderkey", "l_linenumber", (F.round(F.col("prediction")[0], 3) + 0.0).alias("prediction"))


@query(LINE.format(train="""p AS (SELECT *, n - 2 AS c FROM e WHERE r + 2 < n),
t AS (SELECT * FROM p WHERE r < floor(c * 0.6::DOUBLE)),""") + """, s AS (SELECT y0, a0 + b0 * x AS p0, y1, a1 + b1 * x AS p1
  FROM p, m WHERE r >= floor(c * 0.6::DOUBLE) + floor(c * 0.2::DOUBLE)),
q AS (SELECT (avg(abs(y0 - p0)) + avg(abs(y1 - p1))) / 2 AS mae,
  (avg((y0 - p0) ** 2) + avg((y1 - p1) ** 2)) / 2 AS mse,
  sqrt((avg((y0 - p0) ** 2) + avg((y1 - p1) ** 2)) / 2) AS rmse,
  1 - (avg((y0 - p0) ** 2) / var_pop(y0) + avg((y1 - p1) ** 2) / var_pop(y1)) / 2 AS r2,
  (avg(abs(y0 - p0) / CASE WHEN abs(y0) > 0 THEN abs(y0) ELSE 1 END) + avg(abs(y1 - p1) / CASE WHEN abs(y1) > 0 THEN abs(y1) ELSE 1 END)) * 50 AS mape,
  (avg(abs(y0 - p0) / ((abs(y0) + abs(p0)) / 2)) + avg(abs(y1 - p1) / ((abs(y1) + abs(p1)) / 2))) * 50 AS smape FROM s)
SELECT metric, round(value, 4) + 0.0 AS value FROM (UNPIVOT q ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)""")
def line_evaluation(spark, folder):
    """Fit on the first 60 % of each user's windows, evaluate on the last 20 %."""
    frame = tagged_windows(spark, folder, 1, 2)
    model = training.fit_forecaster(frame, 2, 1, "linear", "dataset")
    return scoring.evaluate(frame, model, 2, 1).withColumn("value", F.round("value", 4) + 0.0)


@query("""
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 3) + 0.0 AS prediction FROM lineitem, m
""")
def line_rows(spark, folder):
    """Scaled input, fitted and scored row by row."""
    data = items(spark, folder)
    steps = [{"name": "normalize", "columns": ["l_quantity"]}]
    state = prep.fit(data, steps)
    ready = training.assemble(prep.apply(data, state, steps), ["l_quantity"])
    model = training.fit_outputs(ready, [F.col("l_extendedprice")], "linear")
    scored = scoring.score_rows(data, model, ["l_quantity"], state, steps)
    return scored.select("l_orderkey", "l_linenumber", (F.round(F.col("prediction")[0], 3) + 0.0).alias("prediction"))


@query("""
WITH r AS (SELECT *, row_number() OVER (ORDER BY md5(l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|42')) - 1 AS r,
                  count(*) OVER () AS n FROM lineitem),
     f AS (SELECT r.*, CASE WHEN r < n // 3 + least(1, n % 3) THEN 0 WHEN r < 2 * (n // 3) + least(2, n % 3) THEN 1 ELSE 2 END AS fold FROM r),
     k AS (SELECT i, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a
           FROM f, range(3) t(i) WHERE f.fold <> i GROUP BY i),
     s AS (SELECT i, l_extendedprice AS y, a + b * l_quantity AS p FROM f JOIN k ON f.fold = k.i),
     q AS (SELECT i, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse,
                  1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) AS r2, avg(abs(y - p) / CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END) * 100 AS mape,
                  avg(abs(y - p) / ((abs(y) + abs(p)) / 2)) * 100 AS smape FROM s GROUP BY i),
     u AS (UNPIVOT q ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)
SELECT metric || '_mean' AS metric, round(avg(value), 2) + 0.0 AS value FROM u GROUP BY metric
UNION ALL SELECT metric || '_std', round(stddev_pop(value), 2) + 0.0 FROM u GROUP BY metric
""")
def line_cross_validation(spark, folder):
    """Three folds, each with its own scaling and line."""
    data = table(spark, folder, "lineitem").select(*ITEM_KEY, "l_quantity", "l_extendedprice")
    out = training.cross_validate(
        data, 3, ITEM_KEY, ["l_quantity"], "l_extendedprice", [{"name": "normalize", "columns": ["l_quantity"]}], "linear")
    return out.withColumn("value", F.round("value", 2) + 0.0)


@query("""
WITH e AS (SELECT user_id, event_id, ts, value, row_number() OVER (ORDER BY ts, event_id) AS at FROM events),
     f AS (SELECT i AS fold, least(1 + greatest(1, (n - 1 - 1) // 3) * (i + 1), n) AS last
           FROM range(3) t(i), (SELECT count(*) AS n FROM events)),
     p AS (SELECT fold, user_id, value AS x, lead(value) OVER w AS y, row_number() OVER w - 1 AS r,
                  count(*) OVER (PARTITION BY fold, user_id) - 1 AS c
           FROM e JOIN f ON e.at <= f.last WINDOW w AS (PARTITION BY fold, user_id ORDER BY ts, event_id)),
     m AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p WHERE r < floor(c * 0.6::DOUBLE) AND r < c GROUP BY fold),
     s AS (SELECT fold, y, a + b * x AS p FROM p JOIN m USING (fold)
           WHERE r < c AND r >= floor(c * 0.6::DOUBLE) + floor(c * 0.2::DOUBLE)),
     q AS (SELECT fold, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse, sqrt(avg((y - p) ** 2)) AS rmse,
                  1 - sum((y - p) ** 2) / (count(*) * var_pop(y)) AS r2, avg(abs(y - p) / CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END) * 100 AS mape,
                  avg(abs(y - p) / ((abs(y) + abs(p)) / 2)) * 100 AS smape FROM s GROUP BY fold),
     u AS (UNPIVOT q ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)
SELECT metric || '_mean' AS metric, round(avg(value), 3) + 0.0 AS value FROM u GROUP BY metric
UNION ALL SELECT metric || '_std', round(stddev_pop(value), 3) + 0.0 FROM u GROUP BY metric
""")
def line_cross_validation_in_time(spark, folder):
    """Growing prefixes; in each, every user's next value from the current one."""
    out = training.cross_validate_series(events(spark, folder), 3, ["value"], ["value"], ORDER, 1, 1, ["user_id"])
    return out.withColumn("value", F.round("value", 3) + 0.0)


@query("""
WITH c AS (SELECT l_tax AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
     t AS (SELECT x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM c
           WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     b AS (SELECT x, sl / nl AS low, (s - sl) / (n - nl) AS high FROM t WHERE nl < n
           ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax <= b.x THEN low ELSE high END, 3) AS prediction
FROM lineitem, b
""")
def boosted_stump(spark, folder):
    """One boosting round of one split: the best cut of the tax, and the mean price on each side."""
    data = training.assemble(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_extendedprice"), ["l_tax"])
    model = training.fit_outputs(data, [F.col("l_extendedprice")], "gbt", maxIter=1, maxDepth=1, seed=1)
    scored = model.transform(data)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("prediction")[0], 3).alias("prediction"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000 AS x, l_quantity + l_extendedprice / 1000 AS y FROM lineitem),
     m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM p),
     l AS (SELECT *, ((a + c) + sqrt((a - c) ** 2 + 4 * b * b)) / 2 AS top FROM m),
     v AS (SELECT *, b / sqrt(b * b + (top - a) ** 2) AS v0, (top - a) / sqrt(b * b + (top - a) ** 2) AS v1 FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, round(abs((x - mx) * v0 + (y - my) * v1), 4) + 0.0 AS size_0,
       round(abs((y - my) * v0 - (x - mx) * v1), 4) + 0.0 AS size_1
FROM p, v
""")
def pca_two_columns(spark, folder):
    """Two columns have a closed form; signs of the components are free, so sizes are compared."""
    price = F.col("l_extendedprice") / 1000
    data = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", price.alias("x"), (F.col("l_quantity") + price).alias("y"))
    scored = training.fit_stages(data.select("x", "y"), training.stage("pca", ["x", "y"], "parts", k=2)).transform(data)
    parts = vector_to_array("parts")
    size = lambda i: (F.round(F.abs(parts[i]), 4) + 0.0).alias(f"size_{i}")
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", size(0), size(1))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice AS y, (l_partkey % 3)::DOUBLE AS w FROM lineitem),
     m AS (SELECT sum(w) AS n, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM p),
     l AS (SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, round(a + b * x, 2) + 0.0 AS prediction FROM p, l
""")
def line_weighted(spark, folder):
    """Rows of weight 0, 1 and 2; the line has a closed form."""
    data = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", (F.col("l_partkey") % 3).cast("double").alias("w"))
    ready = training.assemble(data, ["l_quantity"])
    model = training.fit_outputs(ready, [F.col("l_extendedprice")], "linear", weight="w")
    scored = model.transform(ready)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(F.col("prediction")[0], 2) + 0.0).alias("prediction"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 4)::INT AS class FROM lineitem")
def forest_classes(spark, folder):
    """Four classes in four value ranges: one tree finds every row's class."""
    data = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 4).alias("class"),
        ((F.col("l_partkey") % 4) * 10 + F.col("l_linenumber") % 2).alias("x"))
    ready = training.assemble(data, ["x"])
    model = training.fit_outputs(ready, [F.col("class")], "forest_classifier", numTrees=1, maxDepth=3, bootstrap=False,
                                 featureSubsetStrategy="all", seed=1)
    scored = model.transform(ready)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.col("prediction")[0].cast("int").alias("class"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS base FROM lineitem),
     d AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN (base + 1) % 3 ELSE base END AS c FROM p),
     g AS (SELECT k, l_linenumber AS x, count(*) AS n, sum(CASE WHEN c = k THEN 1 ELSE -1 END) AS s FROM d, range(3) t(k) GROUP BY ALL),
     t AS (SELECT k, x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY k) AS n, sum(s) OVER (PARTITION BY k) AS s FROM g
           WINDOW w AS (PARTITION BY k ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     b AS (SELECT k, x, sl / nl AS low, (s - sl) / (n - nl) AS high FROM t WHERE nl < n
           QUALIFY row_number() OVER (PARTITION BY k ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC) = 1),
     w AS (SELECT list(struct_pack(x := x, low := low, high := high) ORDER BY k) AS b FROM b),
     q AS (SELECT l_orderkey, l_linenumber, l_partkey,
             list_transform(b, lambda s: 1 / (1 + exp(-2 * CASE WHEN l_linenumber <= s.x THEN s.low ELSE s.high END))) AS p FROM d, w)
SELECT l_orderkey, l_linenumber, l_partkey, (list_position(p, list_max(p)) - 1)::INT AS class,
       round(p[1] / list_sum(p), 6) AS p0, round(p[2] / list_sum(p), 6) AS p1, round(p[3] / list_sum(p), 6) AS p2 FROM q
""")
def boosted_classes(spark, folder):
    """Three classes by boosting: a stump per class against the others, probabilities that add up to one."""
    base = F.when(F.col("l_linenumber") <= 2, 0).when(F.col("l_linenumber") <= 4, 1).otherwise(2)
    data = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 7 == 0, (base + 1) % 3).otherwise(base).alias("class"))
    ready = training.assemble(data, ["l_linenumber"])
    model = training.fit_outputs(ready, [F.col("class")], "gbt_classifier", maxIter=1, maxDepth=1, seed=1)
    scored = model.transform(model.transform(ready, "class"), "chances", probabilities=True)
    chances = F.col("chances")[0]
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.col("class")[0].cast("int").alias("class"),
                         *[F.round(chances[k], 6).alias(f"p{k}") for k in range(3)])


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber >= 4 AS late, l_extendedprice + CASE WHEN l_linenumber >= 4 THEN 1e7 ELSE 0 END AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(avg(y) OVER (PARTITION BY late), 2) AS prediction, count(*) OVER (PARTITION BY late) AS cluster_rows FROM p
""")
def cluster_feature_means(spark, folder):
    """Rows in two groups far apart: imputed columns, component and cluster id tell the groups, so a stump gives their means."""
    late = F.col("l_linenumber") >= 4
    data = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") + F.when(late, 1000.0).otherwise(0.0)).alias("a"),
        (F.col("l_tax") - F.when(late, 1000.0).otherwise(0.0)).alias("b"),
        (F.col("l_extendedprice") + F.when(late, 1e7).otherwise(0.0)).alias("y"))
    model = training.fit_stages(data, training.staged_model(["a", "b"], "y", clusters=2, components=1, maxIter=1, maxDepth=1, seed=1))
    scored = scoring.score_stages(data, model)
    sizes = scored.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_rows"))
    return scored.join(sizes, "cluster").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("prediction", 2).alias("prediction"), "cluster_rows")


@query("""
WITH c AS (SELECT l_tax AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
     t AS (SELECT x, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM c
           WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
     b AS (SELECT x, sl / nl AS low, (s - sl) / (n - nl) AS high FROM t WHERE nl < n
           ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1),
     m AS (SELECT regr_slope(l_extendedprice, l_tax) AS slope, regr_intercept(l_extendedprice, l_tax) AS start FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax <= b.x THEN low ELSE high END, 2) AS stump,
       round(start + slope * l_tax, 2) AS line FROM lineitem, b, m
""")
def line_and_stump_together(spark, folder):
    """Two models fitted at the same time on one kept table, predictions side by side."""
    data = training.assemble(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_extendedprice"), ["l_tax"])
    label = {"labelCol": "l_extendedprice", "featuresCol": "features"}
    fitted = training.fit_together(data, {
        "stump": GBTRegressor(predictionCol="stump", maxIter=1, maxDepth=1, seed=1, **label),
        "line": LinearRegression(predictionCol="line", **label)})
    out = data
    for model in fitted.values():
        out = model.transform(out)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("stump", 2).alias("stump"), F.round("line", 2).alias("line"))


@query(FITTED + """SELECT user_id, s.step::INT AS step, (CASE WHEN s.step = 0 THEN a0 + b0 * x ELSE a1 + b1 * x END)::FLOAT::DOUBLE AS prediction
FROM e, m, range(2) s(step) WHERE r = n - 1 AND user_id = (SELECT min(user_id) FROM events)""")
def line_first_entity(spark, folder):
    """Of several users that are asked for, only the first is scored."""
    rows = events(spark, folder)
    ids = [r[0] for r in rows.select("user_id").distinct().orderBy("user_id").limit(3).collect()]
    scored = scoring.score_first_entity(rows, next_values_model(spark, folder), ["value"], ORDER, 1, "user_id", ids)
    return scored.select("user_id", F.posexplode("predictions").alias("step", "prediction")).withColumn(
        "prediction", F.col("prediction").cast("double"))


@query("SELECT user_id, count(*) - 3 + 1 AS by_windows, count(*) AS by_rows FROM events GROUP BY user_id HAVING count(*) >= 3")
def window_or_row_model(spark, folder):
    """The model's width tells whether it takes windows of the columns or single rows; both are then scored so."""
    rows = events(spark, folder)
    frame = windows.supervised_windows(rows, ["value"], ["value"], ORDER, 3, 1, ["user_id"])
    wide = training.fit_forecaster(frame, 1, 1, "linear")
    narrow = training.fit_outputs(training.assemble(rows, ["value"]), [F.col("value") * 2], "linear")

    def score(model):
        if scoring.needs_windows(model, ["value"], 3):
            return scoring.score_windows(rows, model, ["value"], ORDER, 3, 1, ["user_id"], 1)
        return scoring.score_rows(rows, model, ["value"])

    by_rows, by_windows = (score(m).where("prediction[0] is not null").groupBy("user_id").count() for m in (narrow, wide))
    return by_rows.withColumnRenamed("count", "by_rows").join(by_windows.withColumnRenamed("count", "by_windows"), "user_id")


@query("""
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
             sum(l_extendedprice * l_quantity) / sum(l_quantity * l_quantity) AS o FROM lineitem),
     e AS (SELECT avg((l_extendedprice - a - b * l_quantity) ** 2) AS with_a, avg((l_extendedprice - o * l_quantity) ** 2) AS without FROM lineitem, m)
SELECT l_orderkey, l_linenumber, l_partkey, with_a <= without AS intercept,
  round(CASE WHEN with_a <= without THEN a + b * l_quantity ELSE o * l_quantity END, 2) + 0.0 AS prediction FROM lineitem, m, e
""")
def search_intercept(spark, folder):
    """Search over lines with and without an intercept, then train again with the better setting."""
    data = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    ready = training.assemble(data, ["l_quantity"])

    def fit(setting):
        return training.fit_outputs(ready, [F.col("l_extendedprice")], "linear", **setting)

    def evaluate(setting):
        scored = fit(setting).transform(ready).withColumn("p", F.col("prediction")[0])
        return scoring.evaluate_rows(scored, "l_extendedprice", "p")

    space = {"fitIntercept": {"type": "categorical", "range": [True, False]}}
    model, best, _ = training.search_and_fit(space, evaluate, fit, "mse", 6, threads=2)
    scored = model.transform(ready)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", F.lit(best["fitIntercept"]).alias("intercept"),
                         (F.round(F.col("prediction")[0], 2) + 0.0).alias("prediction"))


@query("SELECT vec_id, min(vec_id) OVER (PARTITION BY label) AS cluster FROM embeddings")
def kmeans_separated(spark, folder):
    """Vectors far apart by label: every cluster is a label, named after its smallest id."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "label", F.transform(F.col("embedding").cast("array<double>"), lambda v, i: v + F.when(
            i == 0, 1000.0 * F.col("label")).otherwise(0.0)).alias("v"))
    ready = vectors.select("vec_id", "label", training.array_to_vector("v").alias("features"))
    labels = ready.select(F.countDistinct("label")).first()[0]
    scored = training.fit_kmeans(ready, k=labels).transform(ready)
    first = scored.groupBy("cluster").agg(F.min("vec_id").alias("first"))
    return scored.join(first, "cluster").select("vec_id", F.col("first").alias("cluster"))
