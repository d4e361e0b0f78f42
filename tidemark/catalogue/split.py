"""Splits, folds and row numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import ordering, split

ORDER = ["ts", "event_id"]


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "ts")


def orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train'
                      WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS dataset
FROM r
""")
def split_in_time(spark, folder):
    return split.chronological_split(events(spark, folder), ORDER).select("event_id", "dataset")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train'
                      WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS dataset
FROM r
""")
def split_per_user(spark, folder):
    return split.chronological_split(events(spark, folder), ORDER, keys=["user_id"]).select("event_id", "dataset")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events),
     t AS (SELECT event_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS dataset FROM r)
SELECT * FROM t UNION ALL SELECT event_id, 'val' FROM t WHERE dataset = 'test'
""")
def split_test_as_val(spark, folder):
    parts = {"train": 0.8, "val": 0.0, "test": 0.2}
    return split.chronological_split(events(spark, folder), ORDER, parts).select("event_id", "dataset")


@query("""
WITH t AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'test' ELSE 'train' END AS part FROM events)
SELECT * FROM t UNION ALL SELECT event_id, 'val' FROM t WHERE part = 'test'
""")
def split_pretagged(spark, folder):
    """Parts by an existing tag; without rows for validation the test rows serve as such."""
    tagged = events(spark, folder).withColumn("dataset", F.when(F.col("event_id") % 4 == 0, "test").otherwise("train"))
    parts = split.tagged_parts(tagged)
    frames = [rows.select("event_id", F.lit(name).alias("part")) for name, rows in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train'
                        WHEN r <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS dataset
FROM r
""")
def split_random(spark, folder):
    return split.random_split(orders(spark, folder), ["o_orderkey"]).select("o_orderkey", "dataset")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)
SELECT event_id FROM r WHERE r <= floor(n * 0.7::DOUBLE)
""")
def train_subset(spark, folder):
    return split.train_subset(events(spark, folder), 0.7, ORDER).select("event_id")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE r <= floor(n * 0.7::DOUBLE)
""")
def train_subset_random(spark, folder):
    return split.train_subset(orders(spark, folder), 0.7, key=["o_orderkey"]).select("o_orderkey")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '|42')) - 1 AS r, count(*) OVER () AS n FROM orders),
     f AS (SELECT i, i * (n // 7) + least(i, n % 7) AS first FROM range(7) t(i), (SELECT count(*) AS n FROM orders)),
     o AS (SELECT o_orderkey, max(i) AS own FROM r JOIN f ON r.r >= f.first GROUP BY o_orderkey)
SELECT o_orderkey, i::INT AS fold, CASE WHEN own = i THEN 'test' ELSE 'train' END AS dataset FROM o, range(7) t(i)
""")
def kfold(spark, folder):
    out = split.kfold(orders(spark, folder), 7, ["o_orderkey"])
    return split.fold_table(out, 7).select("o_orderkey", "fold", "dataset")


@query("""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders),
     f AS (SELECT i, i * (n // 4) + least(i, n % 4) AS first FROM range(4) t(i), (SELECT count(*) AS n FROM orders))
SELECT o_orderkey, max(i)::INT AS fold FROM r JOIN f ON r.r >= f.first GROUP BY o_orderkey
""")
def kfold_blocks(spark, folder):
    return split.kfold(orders(spark, folder), 4, ["o_orderkey"], shuffle=False).select("o_orderkey", "fold")


@query("""
WITH c AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
     s AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 4 AS shift FROM c),
     z AS (SELECT p, i, n // 4 + CASE WHEN ((i - shift) % 4 + 4) % 4 < n % 4 THEN 1 ELSE 0 END AS size FROM s, range(4) t(i)),
     f AS (SELECT p, i, sum(size) OVER (PARTITION BY p ORDER BY i) - size AS first, size FROM z),
     r AS (SELECT o_orderkey, o_orderpriority,
                  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|42')) - 1 AS r FROM orders)
SELECT o_orderkey, i::INT AS fold FROM r JOIN f ON r.o_orderpriority = f.p AND r.r >= f.first AND r.r < f.first + f.size
""")
def kfold_stratified(spark, folder):
    out = split.stratified_kfold(orders(spark, folder), 4, "o_orderpriority", ["o_orderkey"])
    return out.select("o_orderkey", "fold")


@query("""
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events),
     f AS (SELECT i::INT AS fold, least(24 + greatest(1, (n - 6 - 24) // 3) * (i + 1), n) AS last
           FROM range(3) t(i), (SELECT count(*) AS n FROM events))
SELECT event_id, fold FROM r JOIN f ON r.r <= f.last
""")
def expanding_folds(spark, folder):
    return split.expanding_folds(events(spark, folder), ORDER, 3, 24, 6).select("event_id", "fold")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index, count(*) OVER () AS total FROM events")
def row_index_whole_table(spark, folder):
    out = ordering.row_index(events(spark, folder), [], ORDER, total="total")
    return out.select("event_id", "row_index", "total")


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index,
       count(*) OVER (PARTITION BY user_id) AS total FROM events
""")
def row_index_per_user(spark, folder):
    out = ordering.row_index(events(spark, folder), ["user_id"], ORDER, total="total")
    return out.select("event_id", "row_index", "total")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) - 1 AS row_index FROM documents")
def row_index_by_text(spark, folder):
    """An order of text columns: range sort, checkpoint, offsets."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "lang")
    return ordering.sorted_index(documents, ["source", "lang", "doc_id"]).select("doc_id", "row_index")


@query("""
WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, value, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY value
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below FROM c
""")
def running_total(spark, folder):
    counts = table(spark, folder, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return ordering.running_total(counts, ["event_type"], ["value"], {"below": "n"}).drop("n")
