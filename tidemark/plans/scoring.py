"""Batch scoring of rows, windows and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import finite_or_zero
from tidemark.operators import metrics, prep, windows
from tidemark.plans.training import OutputModels, forecast_errors, predict_all, window_features


def sanitize(predictions: str | Column) -> Column:
    """Predictions as 32-bit floats, with 0 in place of NaN and infinities."""
    value = F.col(predictions) if isinstance(predictions, str) else predictions
    return F.transform(value, finite_or_zero)


def score_rows(
    df: DataFrame, model: OutputModels, columns: Sequence[str], state=None, steps: Sequence[dict] = (),
    probabilities: bool = False,
) -> DataFrame:
    """Apply the fitted preprocessing, then the model, row by row; a row with a missing value gets null."""
    ready = prep.apply(df, state, steps) if state else df
    flat = F.array(*[F.col(c).cast("double") for c in columns])
    return predict_all(model, ready.withColumn("_flat", flat), probabilities=probabilities)


def score_windows(
    df: DataFrame, model: OutputModels, features: Sequence[str], order: Sequence[str], input_len: int,
    output_len: int, keys: Sequence[str] = (), stride: int | None = None,
) -> DataFrame:
    """Every window of every series, with a null prediction where a value is missing.

    Series that are too short are absent.
    """
    frame = windows.inference_windows(df, features, order, input_len, output_len, keys, stride)
    scored = predict_all(model, frame.withColumn("_flat", windows.flat("x")))
    return scored.select(*keys, "window_index", "window_end", sanitize("prediction").alias("prediction"))


def score_entities(
    df: DataFrame, model: OutputModels, features: Sequence[str], order: Sequence[str], input_len: int,
    key: str, anchor: str = "last", state=None, steps: Sequence[dict] = (), strict: bool = False,
) -> DataFrame:
    """One forecast per entity from its last (or first) window, all entities in one job.

    Entities without a full window are absent, a window with a missing value gives null; with ``strict`` an empty result is an error.
    """
    ready = prep.apply(df, state, steps, order, [key]) if state else df
    frame = windows.edge_window(ready, features, order, input_len, [key], anchor)
    scored = predict_all(model, frame.withColumn("_flat", windows.flat("x")))
    out = scored.select(key, sanitize("prediction").alias("predictions"))
    if strict and out.isEmpty():
        raise ValueError("no entity could be scored")
    return out


def score_first_entity(df, model, features, order, input_len, key, ids: Sequence, **kw) -> DataFrame:
    """Of several requested entities only the first is scored."""
    return score_entities(df.where(F.col(key) == F.lit(ids[0])), model, features, order, input_len, key, **kw)


def score_steps_ahead(
    df: DataFrame, model: OutputModels, features: Sequence[str], order: Sequence[str], input_len: int,
    output_len: int, steps_ahead: int, keys: Sequence[str] = (), shift: int = 1,
) -> DataFrame:
    """Several forecast blocks per series, one after the other.

    Block ``b`` reads the window that starts ``b * shift`` rows into the series;
    predictions are not fed back. Blocks without a full window are left out; a
    block whose window has a missing value keeps its place and holds nulls.
    ``shift=output_len`` makes the blocks adjoin in time.
    """
    blocks = -(-steps_ahead // output_len)
    frame = windows.first_windows(df, features, order, input_len, blocks, shift, keys)
    scored = predict_all(model, frame.withColumn("_flat", windows.flat("x")))
    empty = F.array_repeat(F.lit(None).cast("float"), len(model.models))
    scored = scored.select(*keys, "window_index", F.coalesce(sanitize("prediction"), empty).alias("prediction"))
    # At most ``blocks`` rows per series are gathered.
    ordered = F.array_sort(F.collect_list(F.struct("window_index", "prediction")))
    return scored.groupBy(*keys).agg(ordered.alias("_blocks")).select(
        *keys, F.size("_blocks").alias("blocks"),
        F.flatten(F.transform("_blocks", lambda b: b["prediction"])).alias("predictions"),
    )


def score_stages(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    """Imputation, components, clusters and the model in one fitted pipeline."""
    return model.transform(df).select(*df.columns, "cluster", F.col(out))


def needs_windows(model: OutputModels, columns: Sequence[str], input_len: int) -> bool:
    """Whether the model was fitted on flattened windows of these columns."""
    if model.width == len(columns) * input_len and input_len > 1:
        return True
    if model.width == len(columns):
        return False
    raise ValueError(f"the model takes {model.width} values, not {len(columns)} or {len(columns) * input_len}")


def evaluate(
    tagged: DataFrame, model: OutputModels, steps: int, targets: int, dataset: str = "dataset"
) -> DataFrame:
    """Forecast metrics of the test windows; windows that carry a prediction are taken as they are."""
    test = tagged.where(F.col(dataset) == "test")
    scored = test if "prediction" in test.columns else model.transform(window_features(test))
    return forecast_errors(scored, steps, targets)


def evaluate_rows(scored: DataFrame, truth: str, predicted: str, task: str = "regression") -> DataFrame:
    if task == "classification":
        return metrics.classification_metrics(scored, truth, predicted)
    return metrics.forecast_metrics(scored, [(truth, predicted)])
