"""Language identification by a bidirectional gated recurrent network over bytes.

Each text is read as UTF-8 bytes in windows of ``WINDOW`` bytes that together cover it whole; a short
last window is filled with zero bytes. In each window one gated recurrent unit runs forward and one
backward, and a linear layer on both states labels every byte with a probability per language. A
document's probabilities are the means over its letter bytes.

The gates use the piecewise linear sigmoid and the candidate state x / (1 + |x|), which cost a few
nanoseconds a byte where exp and tanh would take most of the run time. Training is plain
backpropagation through time in NumPy on a bounded sample: at most ``docs_per_language`` different texts of
each language, ``SAMPLE_DOCS`` in all, and ``windows_per_doc`` windows of each, spread evenly over the whole text.
However few rows there are, at least ``least_steps`` steps are made. Of equally likely languages the first in
code point order is predicted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import as_bytes, text_blocks

WINDOW = 128
HIDDEN = 8
UNKNOWN = "und"
SAMPLE_DOCS = 102_400  # that the driver learns from, of all languages together

_ONE = np.float32(1)
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


@dataclass
class LanguageModel:
    """Weights of both directions; the backward one uses rows 256 to 511 of each table.

    The first axis of ``table`` and ``recurrent`` is update gate, reset gate, candidate.
    """

    languages: list[str]
    table: np.ndarray      # (3, 512, H): what each byte adds
    recurrent: np.ndarray  # (3, 2, H, H): what the last state adds
    head: np.ndarray       # (2, H, K)
    bias: np.ndarray       # (K,)

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.head, self.bias]


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of bytes, zero-filled, and the text number of each."""
    lengths = np.diff(offsets)
    pieces = -(-lengths // window)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    padded = np.zeros(len(owner) * window, np.uint8)
    first = np.cumsum(pieces) - pieces
    padded[np.arange(len(data)) + np.repeat(first * window - offsets[:-1], lengths)] = data
    return padded.reshape(-1, window), owner


def _run(model: LanguageModel, rows: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Scores (time, row, language) before the softmax; ``keep`` collects what training needs.

    All arrays are contiguous and reused; that is three times as fast as slices of wider ones.
    """
    count, steps = rows.shape
    hidden = model.head.shape[1]
    # The first half of the index runs forward, the second backward through the same windows.
    index = np.concatenate((rows.T, rows[:, ::-1].T), axis=1).astype(np.intp)
    index[:, count:] += 256
    state = np.zeros((2, count, hidden), np.float32)
    update, reset, inner, scale = (np.empty_like(state) for _ in range(4))
    given, out = np.empty((2 * count, hidden), np.float32), np.empty((2, count, model.head.shape[2]), np.float32)
    scores = np.empty((2, steps, count, model.head.shape[2]), np.float32)

    def fed(part: int, source: np.ndarray, into: np.ndarray) -> None:
        np.matmul(source, model.recurrent[part], out=into)
        np.take(model.table[part], index[t], axis=0, out=given, mode="clip")
        into += given.reshape(into.shape)

    for t in range(steps):
        fed(0, state, update)
        np.clip(update, 0, 1, out=update)
        fed(1, state, reset)
        np.clip(reset, 0, 1, out=reset)
        if keep is not None:
            keep.append([index[t], state.copy(), update.copy(), reset.copy()])
        reset *= state
        fed(2, reset, inner)
        np.abs(inner, out=scale)
        scale += _ONE
        inner /= scale
        if keep is not None:
            keep[-1] += [inner.copy(), scale.copy()]
        inner -= state
        inner *= update
        state += inner
        np.matmul(state, model.head, out=out)
        scores[0, t], scores[1, steps - 1 - t] = out[0], out[1]
        if keep is not None:
            keep[-1].append(state.copy())
    scores[0] += scores[1]
    scores[0] += model.bias
    return scores[0]


def _exponentials(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the scores, in place, and its sum over the languages."""
    np.minimum(scores, np.float32(60), out=scores)
    np.exp(scores, out=scores)
    return scores, scores @ np.ones(scores.shape[-1], np.float32)


def document_probabilities(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, language): mean over the letter bytes of each whole text; zero without any."""
    rows, owner = windows_of(data, offsets)
    total = np.zeros((len(offsets) - 1, len(model.languages)))
    letters = np.zeros(len(offsets) - 1)
    size = max(1, min(4096, 2_500_000 // (WINDOW * len(model.languages))))
    for at in range(0, len(rows), size):
        part = rows[at: at + size]
        mask = _LETTER[part]
        raised, sums = _exponentials(_run(model, part))
        pooled = np.einsum("tbk,tb->bk", raised, mask.T / sums)
        np.add.at(total, owner[at: at + size], pooled)
        np.add.at(letters, owner[at: at + size], mask.sum(axis=1))
    return total / np.maximum(letters, 1)[:, None]


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 256,
          rate: float = 0.02, hidden: int = HIDDEN, seed: int = 7, least_steps: int = 250) -> LanguageModel:
    """Fit by backpropagation through time with Adam; every letter byte carries its document's label.

    Few rows make small batches and more epochs, so that the number of steps does not fall below ``least_steps``.
    """
    batch = max(1, min(batch, max(32, len(rows) // 8)))
    epochs = max(epochs, -(-least_steps // max(1, -(-len(rows) // batch)))) if len(rows) else 0
    rng = np.random.default_rng(seed)
    def small(*shape):
        return (rng.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)

    table, recurrent = small(3, 512, hidden), small(3, 2, hidden, hidden)
    table[:2] += 0.5  # the middle of the linear gate
    recurrent[:2] *= 0.2
    model = LanguageModel(languages, table, recurrent, small(2, hidden, len(languages)),
                          np.zeros(len(languages), np.float32))
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    total, done = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = order[at: at + batch]
            done += 1
            pace = rate * (1 - (done - 1) / total)
            for w, g, m, v in zip(model.weights(), _gradients(model, rows[pick], labels[pick]), first, second,
                                  strict=True):
                np.clip(g, -1, 1, out=g)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= pace * (m / (1 - 0.9 ** done)) / (np.sqrt(v / (1 - 0.99 ** done)) + 1e-6)
    return model


def _gradients(model: LanguageModel, rows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    count, steps = rows.shape
    hidden = model.head.shape[1]
    kept: list = []
    error, sums = _exponentials(_run(model, rows, kept))
    error /= sums[..., None]
    mask = _LETTER[rows]
    error[:, np.arange(count), labels] -= 1
    error *= (mask / max(1.0, float(mask.sum()))).T[:, :, None]
    g_recurrent, g_head = np.zeros_like(model.recurrent), np.zeros_like(model.head)
    g_given = np.empty((3, steps, 2 * count, hidden), np.float32)
    g_state = np.zeros((2, count, hidden), np.float32)
    turned = model.recurrent.transpose(0, 1, 3, 2)
    for t in range(steps - 1, -1, -1):
        _, before, update, reset, inner, scale, after = kept[t]
        out = np.stack((error[t], error[steps - 1 - t]))
        g_head += np.matmul(after.transpose(0, 2, 1), out)
        g_state += np.matmul(out, model.head.transpose(0, 2, 1))
        g_inner = g_state * update / (scale * scale)
        back = np.matmul(g_inner, turned[2])
        g_update = g_state * (inner - before) * ((update > 0) & (update < 1))
        g_reset = back * before * ((reset > 0) & (reset < 1))
        for part, (source, g) in enumerate(((before, g_update), (before, g_reset), (reset * before, g_inner))):
            g_recurrent[part] += np.matmul(source.transpose(0, 2, 1), g)
            g_given[part, t] = g.reshape(-1, hidden)
        g_state = (g_state * (1 - update) + back * reset + np.matmul(g_update, turned[0])
                   + np.matmul(g_reset, turned[1]))
    index = np.concatenate([k[0] for k in kept])
    flat = g_given.reshape(3, -1, hidden)
    g_table = np.stack([[np.bincount(index, flat[part, :, i], 512) for i in range(hidden)] for part in range(3)])
    return [g_table.transpose(0, 2, 1).astype(np.float32), g_recurrent, g_head, error.sum(axis=(0, 1))]


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 400,
                  windows_per_doc: int = 2, **options) -> LanguageModel:
    """Learn from the given rows; rows with a null text or label are passed over.

    The sample is at most ``docs_per_language`` different texts of each language, picked by a hash of the text
    so that reruns agree, with ``windows_per_doc`` windows spread over each text. Every label is learned; with
    more than ``SAMPLE_DOCS / docs_per_language`` of them each gets fewer documents. No labelled row gives a
    model without languages, under which every text is unknown.
    """
    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    # Copies of a text are learned once, so they do not count here either.
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return train(np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), [])
    per = min(docs_per_language, max(1, SAMPLE_DOCS // len(counts)))
    hoped = max(1.5 * per, 24.0)  # enough that no language is left without a row by chance
    share = F.from_json(F.lit(json.dumps({k: min(1.0, hoped / n) for k, n in counts.items()})), "map<string,double>")
    chance = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    size = F.greatest(F.octet_length("text"), F.lit(1))
    # Windows are cut in Spark, so only they travel to the driver; they start at even steps through the bytes.
    starts = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(windows_per_doc - 1)),
        lambda i: F.floor(i * F.greatest(size - WINDOW, F.lit(0)) / F.lit(max(1, windows_per_doc - 1))).cast("int")))
    picked = (labelled.where(chance < F.try_element_at(share, F.col("lang")))
              .select("lang", F.xxhash64("text").alias("same"), chance.alias("chance"), F.encode("text", "UTF-8").alias("bytes"),
                      starts.alias("starts"))
              .select("lang", "same", "chance", F.transform("starts", lambda s: F.substring("bytes", s + 1, F.lit(WINDOW))).alias("parts"))
              .groupBy("lang", "same").agg(F.first("chance").alias("chance"), F.first("parts").alias("parts")))
    best = Window.partitionBy("lang").orderBy("chance", "same")
    sample = (picked.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per)
              .orderBy("chance", "lang", "same").select("lang", "parts").collect())
    languages = sorted(counts)
    place = {name: i for i, name in enumerate(languages)}
    rows, labels = [], []
    for r in sample:
        for part in r["parts"]:
            rows.append(np.frombuffer(bytes(part).ljust(WINDOW, b"\0"), np.uint8))
            labels.append(place[r["lang"]])
    # Memory of a step is rows times languages.
    options.setdefault("batch", max(1, min(256, 256 * 256 // len(languages))))
    return train(np.array(rows), np.array(labels), languages, **options)


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``lang_pred`` and ``score``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text under a model
    without languages. Columns of these names in the input are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    known: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(*names, F.when(known, F.col(text)).alias("__text"))
    fields = "".join(f"{_quoted(f.name)} {f.dataType.simpleString()}, " for f in frame.schema[: len(names)])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch, "__text"):
                part = batch.slice(first, end - first)
                valid = part.column(part.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
                if model.languages:
                    chances = document_probabilities(model, *as_bytes(texts))
                    best, score = chances.argmax(axis=1), np.where(valid, np.clip(chances.max(axis=1), 0, 1), 0.0)
                    found = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, valid, strict=True)]
                else:
                    found, score = [UNKNOWN] * len(valid), np.zeros(len(valid))
                columns = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*names, "lang_pred", "score"])

    return frame.mapInArrow(predict, fields + "lang_pred string, score double")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
