"""Time the headline queries on the bench tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalogue import QUERIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = [
    "pit_last_view", "pit_last_finished_order", "historical_two_views", "grid_sequence", "latest_sequence",
    "materialize_latest", "online_lookup",
    "lag_per_user", "rolling_per_user", "lag_roll_whole_table", "hourly_load_bundle", "risk_score",
    "fill_mean", "fill_median", "fill_both_ways", "fill_whole_table", "label_encode", "scale_zscore",
    "stateless_chain", "fit_train_apply_all",
    "split_in_time", "split_random", "kfold", "kfold_stratified", "expanding_folds", "row_index_whole_table",
    "windows_supervised", "windows_whole_table", "windows_grouped", "last_window",
    "align_tile", "align_pad_start", "compose_sources", "prediction_as_feature",
    "forecast_errors_by_group", "classification_probabilities", "roc_auc", "cluster_dispersion", "davies_bouldin",
    "silhouette_squared", "data_quality", "value_stats", "prediction_stats",
    "linear_forecast", "boosted_forecast", "kmeans_clusters", "line_cross_validation", "score_entities",
    "materialize_stream", "stream_last_window",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    # The noop sink computes every row and column and stores nothing.
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, **{
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run(spark, "pit_last_view", folder)  # start the machinery before the clock
    seconds = {name: round(run(spark, name, folder), 3) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
