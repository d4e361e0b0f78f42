"""Sliding windows, shown as one row per window, step and value."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalogue.registry import query, table
from tidemark.operators import split, windows

ORDER = ["ts", "event_id"]


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", "ts", "value")


def cells(frame, column, *keep):
    steps = frame.select(*keep, F.posexplode(column).alias("step", "_values"))
    return steps.select(*keep, "step", F.posexplode("_values").alias("feature", "value"))


NUMBERED = """WITH e AS (SELECT user_id, event_id, value, ts, row_number() OVER w - 1 AS r,
  count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
"""


@query(NUMBERED + """, s AS (SELECT user_id, r AS first, ts FROM e WHERE r + 8 + 3 <= n),
x AS (SELECT s.user_id, s.first AS window_index, 'x' AS part, (e.r - s.first)::INT AS step, e.value
      FROM s JOIN e ON e.user_id = s.user_id AND e.r >= s.first AND e.r < s.first + 8),
y AS (SELECT s.user_id, s.first, 'y', (e.r - s.first - 8)::INT, e.value
      FROM s JOIN e ON e.user_id = s.user_id AND e.r >= s.first + 8 AND e.r < s.first + 11)
SELECT * FROM x UNION ALL SELECT * FROM y""")
def windows_supervised(spark, folder):
    frame = windows.supervised_windows(events(spark, folder), ["value"], ["value"], ORDER, 8, 3, ["user_id"])
    parts = [cells(frame, p, "user_id", "window_index").withColumn("part", F.lit(p)) for p in "xy"]
    return parts[0].unionByName(parts[1]).drop("feature")


@query("""
WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n FROM events),
     s AS (SELECT r AS first, r // 6 AS window_index, (n - 24) // 6 + 1 AS window_count FROM e WHERE r % 6 = 0 AND r + 24 <= n)
SELECT window_index, window_count, (e.r - s.first)::INT AS step, f.feature::INT AS feature,
       CASE WHEN f.feature = 0 THEN e.value ELSE e.event_id::DOUBLE END AS value
FROM s JOIN e ON e.r >= s.first AND e.r < s.first + 24 CROSS JOIN range(2) f(feature)
""")
def windows_whole_table(spark, folder):
    """Inference windows over one long series; the stride is the forecast length."""
    frame = windows.inference_windows(events(spark, folder), ["value", "event_id"], ORDER, 24, 6)
    return cells(frame, "x", "window_index", "window_count")


@query(NUMBERED + """, s AS (SELECT user_id, r AS first, r // 5 AS window_index FROM e WHERE r % 5 = 0 AND r + 10 <= n)
SELECT s.user_id, s.window_index, (e.r - s.first)::INT AS step, e.value
FROM s JOIN e ON e.user_id = s.user_id AND e.r >= s.first AND e.r < s.first + 10""")
def windows_grouped(spark, folder):
    frame = windows.inference_windows(events(spark, folder), ["value"], ORDER, 10, 5, ["user_id"])
    return cells(frame, "x", "user_id", "window_index").drop("feature")


@query(NUMBERED + """, s AS (SELECT user_id, r AS first, r // 4 AS window_index FROM e WHERE r % 4 = 0 AND r + 12 + 4 <= n)
SELECT s.user_id, s.window_index, CASE WHEN e.r < s.first + 12 THEN 'x' ELSE 'y' END AS part, ((e.r - s.first) % 12)::INT AS step, e.value
FROM s JOIN e ON e.user_id = s.user_id AND e.r >= s.first AND e.r < s.first + 16""")
def windows_with_targets(spark, folder):
    frame = windows.evaluation_windows(events(spark, folder), ["value"], ORDER, 12, 4, ["user_id"])
    parts = [cells(frame, p, "user_id", "window_index").withColumn("part", F.lit(p)) for p in "xy"]
    return parts[0].unionByName(parts[1]).drop("feature")


@query(NUMBERED + """SELECT user_id, count(*) AS windows FROM e WHERE r + 60 <= n GROUP BY user_id""")
def windows_of_long_series(spark, folder):
    """Users with fewer than sixty events have no window, and no row stands for them."""
    frame = windows.supervised_windows(events(spark, folder), ["value"], ["value"], ORDER, 50, 10, ["user_id"])
    return frame.groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"))


@query(NUMBERED + """, s AS (SELECT user_id, r AS first, r // 9 AS window_index FROM e WHERE r % 9 = 0 AND r + 4 <= n)
SELECT s.user_id, s.window_index, (e.r - s.first)::INT AS step, e.value
FROM s JOIN e ON e.user_id = s.user_id AND e.r >= s.first AND e.r < s.first + 4""")
def windows_far_apart(spark, folder):
    """A stride above the window: the rows between belong to no window."""
    frame = windows.sliding_windows(events(spark, folder), ["value"], ORDER, 4, keys=["user_id"], stride=9)
    return cells(frame, "x", "user_id", "window_index").drop("feature")


@query(NUMBERED + """SELECT user_id, max(ts) OVER (PARTITION BY user_id) AS window_end, (r - (n - 12))::INT AS step, value
FROM e WHERE r >= n - 12 AND n >= 12""")
def last_window(spark, folder):
    frame = windows.edge_window(events(spark, folder), ["value"], ORDER, 12, ["user_id"])
    return cells(frame, "x", "user_id", "window_end").drop("feature")


@query(NUMBERED + "SELECT user_id, r::INT AS step, value FROM e WHERE r < 12 AND n >= 12")
def first_window(spark, folder):
    frame = windows.edge_window(events(spark, folder), ["value"], ORDER, 12, ["user_id"], "first")
    return cells(frame, "x", "user_id").drop("feature")


@query(NUMBERED + """SELECT user_id, ((r - (n - 6)) * 2 + f.feature)::INT AS position,
  CASE WHEN f.feature = 0 THEN value ELSE event_id::DOUBLE END AS value
FROM e CROSS JOIN range(2) f(feature) WHERE r >= n - 6 AND n >= 6""")
def flat_window(spark, folder):
    """Steps one after the other, features within a step in order, as the model sees them."""
    frame = windows.edge_window(events(spark, folder), ["value", "event_id"], ORDER, 6, ["user_id"])
    flat = frame.select("user_id", vector_to_array(windows.flat_vector()).alias("flat"))
    return flat.select("user_id", F.posexplode("flat").alias("position", "value"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r,
                  count(*) OVER (PARTITION BY user_id) - 5 AS c FROM events)
SELECT user_id, r AS window_index, CASE WHEN r < floor(c * 0.6::DOUBLE) THEN 'train'
  WHEN r < floor(c * 0.6::DOUBLE) + floor(c * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS dataset
FROM e WHERE r < c
""")
def windows_split_in_time(spark, folder):
    """Windows of four rows and two following ones, split per user."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    frame = windows.supervised_windows(events, ["value"], ["value"], ["ts", "event_id"], 4, 2, ["user_id"])
    return split.tag_windows(frame).select("user_id", "window_index", "dataset")
