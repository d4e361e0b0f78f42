"""Quality rules whose cutoffs are controlled for false rejection.

Base counts describe each whole text. Every rule rejects texts whose ratio is above (or below) a cutoff. The
cutoffs of all rules together form a fixed path of levels from lenient to strict. Per stratum the path is
walked as long as the labelled good documents prove each level safe: the exact binomial test must reject
"the rules of this level together reject more than the share ``alpha`` of the good documents", which is the
same as the Clopper-Pearson upper bound lying at or below that share. A fixed path that stops at its first
failure needs no correction among its levels; the error ``delta`` is split over the strata
(Bonferroni). So with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to
all rules together. Where not even the first level is safe, for want of labels (at ``alpha`` 0.05 and
``delta`` 0.05 in four strata it takes 86 good documents) or because of rejections, the rules reject nothing.

Words are runs of anything but space and \\x09-\\x0D. Null and empty texts have no words. A null stratum is
one of its own. Documents with the same id are judged one by one and are labelled alike; a document
without an id is never labelled. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch
from tidemark.llm.small import attach
from tidemark.llm.text import WORD

SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Rule: ratio, whether high values are bad, and the cutoffs of the levels from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", True, [2.0, 1.2, 0.8, 0.4, 0.2, 0.1]),
    "marks": ("n_marks / n_words", True, [1.2, 0.8, 0.4, 0.2, 0.1, 0.05]),
    "dup_lines": ("n_dup_lines / n_lines", True, [0.7, 0.5, 0.4, 0.35, 0.3, 0.25]),
    "repeats": ("n_repeat_words / n_words", True, [0.48, 0.45, 0.4, 0.35, 0.3, 0.25]),
    "long_words": ("word_chars / n_words", True, [16.0, 12.0, 10.0, 9.0, 8.5, 8.0]),
    "short_words": ("word_chars / n_words", False, [1.5, 2.0, 2.5, 3.0, 3.2, 3.5]),
}
ALPHA, DELTA = 0.05, 0.05


def _chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    frame = docs.select(*keep, text_of.alias("_t"))
    frame = frame.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    frame = frame.withColumn("_lines", lines)
    # Hashes of all word windows, each with its place; equal ones are neighbours after the sort.
    words = F.transform("_words", lambda w: F.xxhash64(w))
    frame = frame.withColumn("_hashes", words)
    last = F.size("_words") - WINDOW
    windows = F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.get("_hashes", i), F.get("_hashes", i + 1), F.get("_hashes", i + 2))))
    frame = frame.withColumn("_windows", windows)
    repeated = F.coalesce(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.lit(False))
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_sorted", F.when(repeated, placed))
    same = lambda i, j: F.coalesce(F.get("_sorted", i).getField("h") == F.get("_sorted", j).getField("h"), F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(k, k - 1) | same(k, k + 1))
    places = F.array_sort(F.transform(twice, lambda x: x.getField("i")))
    # A window covers three words, less those that the next repeated window covers.
    frame = frame.withColumn("_places", places)
    covered = F.aggregate("_places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).cast("long").alias("n"), p.alias("p")),
                          lambda a: a["n"])
    return frame.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _chars_of(F.col("_t"), SYMBOLS).alias("n_symbols"), _chars_of(F.col("_t"), "!").alias("n_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    ratio = F.lit(p / (1 - p))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.exp(n * F.log(F.lit(1 - p))).alias("s"))

    def add(a, i):
        term = a["t"] + F.log((n - i + 1) / i * ratio)
        return F.struct(term.alias("t"), (a["s"] + F.exp(term)).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda a: a["s"])


def _breaks(rules: dict, name: str, level: int) -> Column:
    _, high, cutoffs = rules[name]
    return (F.col(name) > cutoffs[level]) if high else (F.col(name) < cutoffs[level])


def safe_levels(counts: DataFrame, good: DataFrame, rules: dict, alpha: float, delta: float) -> DataFrame:
    """(stratum, level) of the strictest level on the safe part of the path; no row where the first is not safe.

    ``counts`` has a row per document with ``stratum`` and the ratios by rule name; ``good`` marks the
    documents (doc) labelled as good.
    """
    levels = len(next(iter(rules.values()))[2])
    if any(len(cutoffs) != levels for _, _, cutoffs in rules.values()):
        raise ValueError("every rule needs a cutoff for each level")
    labelled = counts.join(good, "doc", "left_semi")
    rejected = [reduce(lambda a, b: a | b, [_breaks(rules, name, level) for name in rules]) for level in range(levels)]
    per = labelled.groupBy("stratum").agg(
        F.count("*").alias("n"), *[F.count(F.when(r, 1)).alias(f"k{level}") for level, r in enumerate(rejected)])
    level_error = delta / max(1, per.count())
    # The sum is only worked out where the observed share is below the allowed one.
    risk = [F.when(F.col(f"k{level}") < alpha * F.col("n"), binomial_tail(F.col(f"k{level}"), F.col("n"), alpha)).otherwise(F.lit(1.0))
            for level in range(levels)]
    first_unsafe = F.array_position(F.array(*[r > level_error for r in risk]), True)
    level = F.when(first_unsafe == 0, levels).otherwise(first_unsafe - 1).cast("int") - 1
    return per.select("stratum", level.alias("level")).where("level >= 0")


def judge(docs: DataFrame, good: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text",
          rules: dict | None = None, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc, the base counts, base_failed, rejected_by (rule names) and kept.

    ``good`` has the column doc: ids of documents labelled as good.
    """
    rules = RULES if rules is None else rules
    scratch = Scratch(docs.sparkSession, "quality")
    base = docs.select(F.col(doc_id).alias("doc"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    counts = base_counts(base, ["doc", "stratum"])
    counts = scratch.save(counts, "counts")
    ratios = {name: F.coalesce(F.try_divide(*[F.col(x.strip()) for x in formula.split("/")]), F.lit(0.0))
              for name, (formula, _, _) in rules.items()}
    counts = counts.withColumns(ratios)
    levels = scratch.save(safe_levels(counts, good, rules, alpha, delta).withColumnRenamed("stratum", "_s"), "levels")
    joined = attach(counts, levels, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    cutoff = lambda name: F.get(F.array(*[F.lit(float(c)) for c in rules[name][2]]), F.col("level"))
    broken = [F.when((F.col(name) > cutoff(name)) if high else (F.col(name) < cutoff(name)), F.lit(name))
              for name, (_, high, _) in rules.items()]
    return joined.select(
        "doc", "stratum", "n_words", "word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.array_compact(F.array(*broken)).alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
