"""Regression, forecasting, classification and clustering metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, rounded, table
from tidemark.operators import metrics


def pairs(spark, folder):
    """Two outputs with their predictions; the second truth has zeros."""
    return table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_quantity").alias("y0"), (F.col("l_extendedprice") / 1500).alias("p0"),
        F.col("l_discount").alias("y1"), F.col("l_tax").alias("p1"))


OUTPUTS = [("y0", "p0"), ("y1", "p1")]

ERRORS = """WITH o AS (SELECT l_returnflag, 0 AS output, l_quantity AS y, l_extendedprice / 1500 AS p FROM lineitem
  UNION ALL SELECT l_returnflag, 1, l_discount, l_tax FROM lineitem),
{name} AS (SELECT {by} output, avg(abs(y - p)) AS mae, avg((y - p) ** 2) AS mse,
  1 - sum((y - p) ** 2) / CASE WHEN count(*) * var_pop(y) <> 0 THEN count(*) * var_pop(y) ELSE 1 END AS r2,
  avg(abs(y - p) / CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END) * 100 AS mape,
  avg(CASE WHEN (abs(y) + abs(p)) / 2 <> 0 THEN abs(y - p) / ((abs(y) + abs(p)) / 2) ELSE 0 END) * 100 AS smape
  FROM o GROUP BY {by} output)
"""


@query(ERRORS.format(name="e", by="") + """, m AS (SELECT avg(mae) AS mae, avg(mse) AS mse, sqrt(avg(mse)) AS rmse, avg(r2) AS r2 FROM e)
SELECT metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT m ON mae, mse, rmse, r2 INTO NAME metric VALUE value)""")
def regression_errors(spark, folder):
    return rounded(metrics.regression_metrics(pairs(spark, folder), OUTPUTS), "value")


@query(ERRORS.format(name="e", by="") + """, m AS (SELECT median(mae) AS mae, median(mse) AS mse, sqrt(median(mse)) AS rmse,
  median(r2) AS r2, median(mape) AS mape, median(smape) AS smape FROM e)
SELECT metric, round(value, 6) + 0.0 AS value
FROM (UNPIVOT m ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)""")
def forecast_errors_median(spark, folder):
    return rounded(metrics.forecast_metrics(pairs(spark, folder), OUTPUTS, "median"), "value")


@query(ERRORS.format(name="e", by="") + """, m AS (SELECT output, mae, mse, sqrt(mse) AS rmse, r2, mape, smape FROM e)
SELECT metric || '_' || output AS metric, round(value, 6) + 0.0 AS value
FROM (UNPIVOT m ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)""")
def forecast_errors_flat(spark, folder):
    per = metrics.forecast_metrics(pairs(spark, folder), OUTPUTS, None)
    return rounded(metrics.flat_names(per), "value")


@query(ERRORS.format(name="e", by="l_returnflag,") + """, m AS (SELECT l_returnflag, avg(mae) AS mae, avg(mse) AS mse,
  sqrt(avg(mse)) AS rmse, avg(r2) AS r2, avg(mape) AS mape, avg(smape) AS smape FROM e GROUP BY 1)
SELECT l_returnflag, metric, round(value, 6) + 0.0 AS value
FROM (UNPIVOT m ON mae, mse, rmse, r2, mape, smape INTO NAME metric VALUE value)""")
def forecast_errors_by_group(spark, folder):
    return rounded(metrics.forecast_metrics(pairs(spark, folder), OUTPUTS, by=["l_returnflag"]), "value")


@query(ERRORS.format(name="e", by="l_returnflag,") + """, m AS (SELECT l_returnflag, avg(mae) AS mae, avg(mse) AS mse,
  sqrt(avg(mse)) AS rmse, avg(r2) AS r2 FROM e GROUP BY 1),
l AS (UNPIVOT m ON mae, mse, rmse, r2 INTO NAME metric VALUE value)
SELECT metric || '_mean' AS metric, round(avg(value), 6) + 0.0 AS value FROM l GROUP BY metric
UNION ALL SELECT metric || '_std', round(stddev_pop(value), 6) + 0.0 FROM l GROUP BY metric""")
def fold_summary(spark, folder):
    """Each return flag plays a fold."""
    per = metrics.regression_metrics(pairs(spark, folder), OUTPUTS, by=["l_returnflag"])
    return rounded(metrics.fold_summary(per), "value")


CLASSES = """, c AS (SELECT t AS class, count(*) AS support, count(*) FILTER (t = l) AS hits FROM s GROUP BY t),
j AS (SELECT c.*, (SELECT count(*) FROM s WHERE l = c.class) AS chosen FROM c),
m AS (SELECT sum(hits) / sum(support) AS accuracy,
  sum(support * 2.0 * hits / (chosen + support)) / sum(support) AS f1,
  sum(support * CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END) / sum(support) AS "precision",
  sum(support * hits / support) / sum(support) AS recall FROM j),
u AS (UNPIVOT m ON accuracy, f1, "precision", recall INTO NAME metric VALUE value)
"""


@query("WITH s AS (SELECT quality AS t, toxic AS l FROM labels)" + CLASSES
       + "SELECT metric, round(value::DOUBLE, 6) + 0.0 AS value FROM u")
def classification_labels(spark, folder):
    return rounded(metrics.classification_metrics(table(spark, folder, "labels"), "quality", "toxic"), "value")


@query("""WITH s AS (SELECT (l_returnflag = 'R')::INT AS t, 1 - l_discount * 8 AS p, (1 - l_discount * 8 >= 0.5)::INT AS l
  FROM lineitem)""" + CLASSES + """, g AS (SELECT p, sum(t) AS pos, sum(1 - t) AS neg FROM s GROUP BY p),
a AS (SELECT g.*, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT metric, round(value::DOUBLE, 6) + 0.0 AS value FROM u
UNION ALL SELECT 'roc_auc', round(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) + 0.0 FROM a""")
def classification_probabilities(spark, folder):
    """Scores with many ties."""
    scored = table(spark, folder, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("t"), (1 - F.col("l_discount") * 8).alias("p"))
    return rounded(metrics.classification_metrics(scored, "t", "p"), "value")


@query("""
WITH s AS (SELECT (event_type = 'purchase')::INT AS t, value AS p FROM events),
     r AS (SELECT t, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rank FROM s)
SELECT 'roc_auc' AS metric,
       round((sum(rank) FILTER (t = 1) - sum(t)::DOUBLE * (sum(t) + 1) / 2) / (sum(t)::DOUBLE * sum(1 - t)), 6) + 0.0 AS value
FROM r
""")
def roc_auc(spark, folder):
    scored = table(spark, folder, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("t"), F.col("value").alias("p"))
    return rounded(metrics.roc_auc(scored, "t", "p"), "value")


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select("embedding", "label")


@query("""
WITH c AS (SELECT l_suppkey AS id, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
     a AS (SELECT i, coalesce(n, 0) AS n FROM range((SELECT max(id) + 1 FROM c)) r(i) LEFT JOIN c ON c.id = i),
     m AS (SELECT count(*)::DOUBLE AS n_clusters, min(n) AS min_cluster_size, max(n) AS max_cluster_size,
                  stddev_pop(n) AS std_cluster_size FROM a)
SELECT metric, round(value, 6) + 0.0 AS value
FROM (UNPIVOT m ON n_clusters, min_cluster_size, max_cluster_size, std_cluster_size INTO NAME metric VALUE value)
""")
def cluster_sizes(spark, folder):
    return rounded(metrics.cluster_sizes(table(spark, folder, "lineitem"), "l_suppkey"), "value")


EMBEDDED = """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS d FROM embeddings),
c AS (SELECT label, d, avg(v) AS c, count(*) AS n FROM x GROUP BY 1, 2)
"""


@query(EMBEDDED + """, w AS (SELECT sum((x.v - c.c) ** 2) AS within FROM x JOIN c USING (label, d)),
g AS (SELECT d, avg(v) AS g FROM x GROUP BY d),
b AS (SELECT sum(c.n * (c.c - g.g) ** 2) AS between_ FROM c JOIN g USING (d)),
f AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT label)::DOUBLE AS k FROM embeddings),
m AS (SELECT within AS inertia, between_ * (n - k) / (within * (k - 1)) AS calinski_harabasz FROM w, b, f)
SELECT metric, round(value, 4) + 0.0 AS value FROM (UNPIVOT m ON inertia, calinski_harabasz INTO NAME metric VALUE value)""")
def cluster_dispersion(spark, folder):
    out = metrics.cluster_dispersion(vectors(spark, folder), "embedding", "label")
    return out.withColumn("value", F.round("value", 4) + 0.0)


@query(EMBEDDED + """, q AS (SELECT vec_id, label, sqrt(sum((x.v - c.c) ** 2)) AS d FROM x JOIN c USING (label, d) GROUP BY 1, 2),
s AS (SELECT label, avg(d) AS s FROM q GROUP BY 1),
p AS (SELECT a.label, b.label AS other, sqrt(sum((a.c - b.c) ** 2)) AS m FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label
      GROUP BY 1, 2),
r AS (SELECT p.label, max((s1.s + s2.s) / p.m) AS r FROM p JOIN s s1 ON s1.label = p.label JOIN s s2 ON s2.label = p.other
      GROUP BY 1)
SELECT 'davies_bouldin' AS metric, round(avg(r), 6) + 0.0 AS value FROM r""")
def davies_bouldin(spark, folder):
    return rounded(metrics.davies_bouldin(vectors(spark, folder), "embedding", "label"), "value")


@query("""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
     p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS total, count(*) AS n
           FROM x a JOIN x b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
     s AS (SELECT vec_id, max(total / n) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b
           FROM p GROUP BY 1)
SELECT 'silhouette_score' AS metric, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS value
FROM s
""")
def silhouette_squared(spark, folder):
    """All pairs on the SQL side, one linear pass on ours."""
    return rounded(metrics.silhouette(vectors(spark, folder), "embedding", "label"), "value")


@query("""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
     p AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
           FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3),
     s AS (SELECT vec_id, max(total / n) FILTER (label = other) AS a, min(total / n) FILTER (label <> other) AS b
           FROM p GROUP BY 1)
SELECT 'silhouette_score' AS metric, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS value
FROM s
""")
def silhouette_euclidean(spark, folder):
    """Plain distances of the vectors whose id is divisible by a hundred to all vectors."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    return rounded(metrics.euclidean_silhouette(vectors, "embedding", "label", F.col("vec_id") % 100 == 0), "value")


@query("""
WITH c AS (SELECT label, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1),
     a AS (SELECT coalesce(n, 0) AS n FROM range((SELECT max(label) + 1 FROM c)) r(i) LEFT JOIN c ON c.label = i),
     m AS (SELECT count(*)::DOUBLE AS n_clusters, min(n) AS min_cluster_size, max(n) AS max_cluster_size,
                  stddev_pop(n) AS std_cluster_size FROM a)
SELECT metric, round(value, 6) + 0.0 AS value, CASE metric
  WHEN 'n_clusters' THEN 'largest id + 1; [0, n]; none'
  WHEN 'min_cluster_size' THEN 'rows of the smallest cluster; [0, n]; none'
  WHEN 'max_cluster_size' THEN 'rows of the largest cluster; [0, n]; none'
  ELSE 'population deviation of cluster sizes; [0, n]; low' END AS explanation
FROM (UNPIVOT m ON n_clusters, min_cluster_size, max_cluster_size, std_cluster_size INTO NAME metric VALUE value)
""")
def explained_metrics(spark, folder):
    return rounded(metrics.explain(metrics.cluster_sizes(vectors(spark, folder), "label")), "value")


@query("""
WITH x AS (SELECT unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) AS d FROM embeddings),
     p AS (SELECT d, y, y * 0.9::DOUBLE AS p, abs(y - y * 0.9::DOUBLE) AS miss FROM x),
     m AS (SELECT (d - 1)::INT AS output, avg(miss) AS mae, avg(miss ** 2) AS mse,
             1 - sum(miss ** 2) / (CASE WHEN var_pop(y) <> 0 THEN count(*) * var_pop(y) ELSE 1 END) AS r2,
             100 * avg(miss / (CASE WHEN abs(y) > 0 THEN abs(y) ELSE 1 END)) AS mape,
             100 * avg(CASE WHEN abs(y) + abs(p) <> 0 THEN miss / ((abs(y) + abs(p)) / 2) ELSE 0 END) AS smape FROM p GROUP BY d)
SELECT output, metric, round(value, 6) + 0.0 AS value FROM (UNPIVOT m ON mae, mse, r2, mape, smape INTO NAME metric VALUE value)
""")
def array_output_errors(spark, folder):
    """Array-valued outputs: one error per array position."""
    truth = F.col("embedding").cast("array<double>")
    scored = table(spark, folder, "embeddings").select(
        truth.alias("y"), F.transform(truth, lambda v: v * 0.9).alias("p"))
    return rounded(metrics.array_errors(scored, "y", "p"), "value")
