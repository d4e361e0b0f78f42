"""Toxicity scores from a classifier that is indifferent to which group a text mentions.

Features are the distinct words of the whole text (runs of letters, ASCII letters lower-cased). The model is
a logistic regression. For every labelled text that mentions an identity term, a counterfactual is made by
swapping the term for another one of the same kind and language, and training penalises the squared
difference of the two scores, so a group's name cannot become evidence merely because attacks mention it
often. The text's own words say which terms it mentions; its language is never asked. ``pairs`` of the model
counts the counterfactuals; without a mention in the sample there are none, and the model is the plain regression.

Word counts for the choice of features cover all labelled rows; the regression itself is fitted in NumPy
on at most ``max_rows`` labelled rows, picked by a hash of the text, and at most ``max_words`` features.
Rows of the sample that agree in text and label are learned once. Null and empty texts have no words and
get the score of the bias alone; a score equal to the threshold counts as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.text import as_bytes, run_hashes, runs, text_blocks

# By language and kind, the terms that may be swapped for one another.
IDENTITY_TERMS = {
    "en": {
        "gender": ["woman", "man", "female", "male", "girl", "boy", "women", "men"],
        "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"],
        "origin": ["black", "white", "asian", "african", "european", "latino", "arab", "immigrant"],
        "orientation": ["gay", "lesbian", "bisexual", "transgender", "straight", "queer"],
        "ability": ["deaf", "blind", "disabled", "autistic"],
    },
    "de": {
        "gender": ["frau", "mann", "mädchen", "junge", "frauen", "männer"],
        "religion": ["muslim", "christ", "jude", "hindu", "buddhist", "katholik", "atheist"],
        "origin": ["schwarzer", "weißer", "asiate", "afrikaner", "europäer", "araber", "einwanderer"],
        "orientation": ["schwul", "lesbisch", "bisexuell", "hetero"],
        "ability": ["gehörlos", "blind", "behindert", "autistisch"],
    },
    "es": {
        "gender": ["mujer", "hombre", "niña", "niño", "mujeres", "hombres"],
        "religion": ["musulmán", "cristiano", "judío", "hindú", "budista", "católico", "ateo"],
        "origin": ["negro", "blanco", "asiático", "africano", "europeo", "latino", "árabe", "inmigrante"],
        "orientation": ["gay", "lesbiana", "bisexual", "heterosexual"],
        "ability": ["sordo", "ciego", "discapacitado", "autista"],
    },
    "fr": {
        "gender": ["femme", "homme", "fille", "garçon", "femmes", "hommes"],
        "religion": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "catholique", "athée"],
        "origin": ["noir", "blanc", "asiatique", "africain", "européen", "arabe", "immigré"],
        "orientation": ["gay", "lesbienne", "bisexuel", "hétérosexuel"],
        "ability": ["sourd", "aveugle", "handicapé", "autiste"],
    },
}
MAX_WORDS = 2048
MAX_ROWS = 20_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass
class ToxicityModel:
    hashes: np.ndarray   # sorted word hashes
    weights: np.ndarray
    bias: float
    pairs: int = 0       # counterfactual sentences that were learned from


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, word hash), each word once a text."""
    data, offsets = as_bytes(texts)
    data = _FOLD[data]
    starts, ends, owner = runs(_LETTER[data], offsets)
    hashes = run_hashes(data, starts, ends)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def known_words(texts: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, index of the word in the sorted ``hashes``) of the distinct known words of each text."""
    data, offsets = as_bytes(texts)
    data = _FOLD[data]
    starts, ends, owner = runs(_LETTER[data], offsets)
    found = run_hashes(data, starts, ends)
    if not len(found) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    hit = hashes[index] == found
    pairs = np.unique(owner[hit] * len(hashes) + index[hit])
    return pairs // len(hashes), pairs % len(hashes)


def _hash_words(words: list[str]) -> np.ndarray:
    owner, hashes = words_of(pa.array(words, pa.large_string()))
    if not np.array_equal(owner, np.arange(len(words))):
        raise ValueError("an identity term must be one word")
    return hashes


def fit_toxicity(labelled: DataFrame, text: str = "text", label: str = "label",
                 identity_terms: dict[str, dict[str, list[str]]] | None = None, fairness: float = 5.0,
                 max_words: int = MAX_WORDS, max_rows: int = MAX_ROWS, min_docs: int = 3, seed: int = 3) -> ToxicityModel:
    """Learn from rows whose label is 0 or 1; other rows are passed over. No rows give the score 0.5 to all."""
    terms = IDENTITY_TERMS if identity_terms is None else identity_terms
    groups = [_hash_words(group).view(np.int64).tolist() for kinds in terms.values() for group in kinds.values()]
    rows = (labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"))
            .where("label in (0, 1)"))
    rows = Scratch(labelled.sparkSession, "toxicity").save(rows, "labelled")  # read three times

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            for first, end, texts in text_blocks(batch, "text"):
                owner, hashes = words_of(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(labels[first:end][owner])], names=["word", "label"])

    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = total["n"], total["toxic"] or 0
    if not 0 < toxic < n:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n else (5.0 if toxic else -5.0))
    counts = rows.mapInArrow(emit, "word long, label int").groupBy("word").agg(
        F.count("*").alias("docs"), F.sum("label").alias("hits"))
    # Chi-square of word and label.
    gap = F.col("hits") * float(n) - F.col("docs") * float(toxic)
    chi = gap * gap / (F.col("docs") * (F.lit(float(n)) - F.col("docs") + 1.0))
    fixed = [w for group in groups for w in group]
    named = F.col("word").isin(fixed)
    picked = {r["word"]: r["chi"] for r in counts.where((F.col("docs") >= min_docs) | named).select("word", chi.alias("chi"))
              .orderBy(named.desc(), F.desc("chi"), "word").limit(max_words + len(fixed)).collect()}
    hashes = np.unique(np.array([*fixed, *picked], np.int64).view(np.uint64))
    chis = np.array([picked.get(w, 0.0) for w in hashes.view(np.int64).tolist()])
    # Weak features are scaled down, so the ridge keeps them small when labels are few.
    scale = np.maximum(0.05, np.sqrt(chis / max(chis.max(), 1e-9)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, texts in text_blocks(batch, "text"):
                owner, index = known_words(texts, hashes)
                ends = np.searchsorted(owner, np.arange(end - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(index, pa.int32()))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], names=["label", "pick", "words"])

    sample = (rows.withColumn("pick", F.xxhash64("text", F.lit(seed))).select("text", "label", "pick")
              .where(F.pmod("pick", F.lit(1 << 20)) < F.lit(min(1.0, 1.2 * max_rows / n) * (1 << 20)))
              .mapInArrow(encode, "label int, pick long, words array<int>").distinct()
              .orderBy("pick", "label", "words").limit(max_rows).collect())
    place = {int(h): i for i, h in enumerate(hashes.view(np.int64))}
    return _train(hashes, [r["words"] for r in sample], np.array([r["label"] for r in sample], float),
                  [[place[w] for w in group] for group in groups], scale, fairness, seed)


def _train(hashes: np.ndarray, words: list[list[int]], labels: np.ndarray, groups: list[list[int]],
           scale: np.ndarray, fairness: float, seed: int, steps: int = 400, rate: float = 0.1, ridge: float = 2e-5) -> ToxicityModel:
    rng = np.random.default_rng(seed)
    # A term that several languages share may become any of their terms of its kinds.
    kind: dict[int, list[int]] = {}
    for group in groups:
        for w in group:
            kind[w] = sorted({*kind.get(w, []), *(x for x in group if x != w)})
    swapped, base = [], []
    for i, row in enumerate(words):
        mentions = [w for w in row if kind.get(w)]
        if mentions:
            change = {w: kind[w][rng.integers(len(kind[w]))] for w in mentions}
            swapped.append(sorted({change.get(w, w) for w in row}))
            base.append(i)
    count, width = len(words), len(hashes)
    everything = words + swapped
    row = np.repeat(np.arange(len(everything)), [len(w) for w in everything])
    column = np.fromiter((w for r in everything for w in r), np.int64, len(row))
    value = scale[column]
    base_rows, pair_rows = np.array(base, np.int64), count + np.arange(len(base))
    weights, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    weights[-1] = np.log(labels.mean() / (1 - labels.mean())) if 0 < labels.mean() < 1 else 0.0
    # Rare toxic rows weigh more, up to an even balance in the square root.
    importance = np.where(labels == 1, np.sqrt((1 - labels.mean()) / labels.mean()), 1.0) if 0 < labels.mean() < 1 else np.ones(count)
    importance /= importance.sum()
    for step in range(1, steps + 1):
        score = _sigmoid(np.bincount(row, value * weights[column], len(everything)) + weights[-1])
        error = np.zeros(len(everything))
        error[:count] = (score[:count] - labels) * importance
        if len(base):
            gap = 2 * fairness / len(base) * (score[base_rows] - score[pair_rows])
            slope = score * (1 - score)
            np.add.at(error, base_rows, gap * slope[base_rows])
            error[pair_rows] -= gap * slope[pair_rows]
        gradient = np.append(np.bincount(column, value * error[row], width), error.sum())
        gradient[:-1] += ridge * weights[:-1]
        first += 0.1 * (gradient - first)
        second += 0.01 * (gradient ** 2 - second)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        weights -= pace * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return ToxicityModel(hashes, scale * weights[:-1], float(weights[-1]), len(base))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def score_texts(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    owner, index = known_words(texts, model.hashes)
    return _sigmoid(np.bincount(owner, model.weights[index], len(texts)) + model.bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.7,
                   keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), ``score`` and ``predicted``; columns of these names are replaced."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    frame = docs.select(*names, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in frame.schema[: len(names)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [score_texts(texts, model) for _, _, texts in text_blocks(batch, "__text")]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return frame.mapInArrow(score, fields + "score double, predicted int")
