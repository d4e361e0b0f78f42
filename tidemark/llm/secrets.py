"""Secret scans: known forms, and strings with a high entropy.

Known forms are regular expressions; each kind's matches are leftmost and do not overlap. Besides, every
run of 20 or more characters of a secret's alphabet is a candidate. A window slides over the candidate while
the counts of its characters are kept up to date: one character comes in, one goes out, and the sum of
c log2 c changes by those two counts only. The candidate is reported if the entropy of some window reaches
the bound of the candidate's character class, unless a pattern of the allow-list matches the candidate or a
known form already covers a part of it.

Places are code points, ends exclusive. Null is the empty text. Everything is column expressions, so a
scan is one pass without a shuffle; a text's spans are collected in one array, so its cost grows with the
square of the number of its matches, not of its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kind: pattern, group whose length counts, least length.
FORMS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Class: pattern of the whole candidate, alphabet, least bits a character in some window. The first class that fits counts.
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.05),
    "lower": (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 3.65),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.85),
}
ALLOWED = [
    r"EXAMPLE",                                  # documentation keys
    r"^[^0-9]*$",                                # no digit: words and identifiers
    r"^[0-9/_=+-]*$",                            # numbers, dates, rules
    r"^/?([a-z0-9_-]+/)+[a-z0-9_-]*$",           # file paths
    r"(?i)abcdefghij|0123456789abcdef0123",      # alphabets
]


def _span(rank: int, kind: str, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), end.cast("long").alias("end"), F.lit(kind).alias("kind"))


_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once; a lambda's parts are else evaluated at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, merge, block: int = 64) -> Column:
    """For each of an array's numbers what ``merge`` makes of 0 and all numbers before it.

    An array is copied whenever it gets one element more, so sums are taken within blocks, over the blocks'
    totals, and put together; that keeps a text with very many matches near linear.
    """
    def run(xs):
        return F.aggregate(
            xs, F.struct(F.array().cast("array<bigint>").alias("sums"), F.lit(0).cast("long").alias("total")),
            lambda acc, x: F.struct(F.array_append(acc["sums"], acc["total"]).alias("sums"), merge(acc["total"], x).alias("total")))

    def whole(xs):
        blocks = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int"))).otherwise(
            F.array().cast("array<int>"))
        return let(F.transform(blocks, lambda b: run(F.slice(xs, b * block + 1, F.lit(block)))), lambda parts: let(
            run(F.transform(parts, lambda p: p["total"])), lambda begins: F.flatten(F.transform(
                parts, lambda p, k: F.transform(p["sums"], lambda s: merge(F.get(begins["sums"], k), s))))))

    return let(values, whole)


def matches(text: Column, pattern: str, rank: int, kind: str, wanted, group: int = 0) -> Column:
    """Spans of the pattern's matches for which ``wanted`` holds of the given group.

    The pieces between the matches give their places: the text is pieces and matches in turn.
    """
    none = F.array().cast(_SPANS)
    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))

    def spans_of(p):
        steps = F.transform(p["found"], lambda m, i: (F.char_length(F.get(p["pieces"], i)) + F.char_length(m)).cast("long"))
        placed = let(scan(steps, lambda a, x: a + x), lambda before: F.transform(p["found"], lambda m, i: F.struct(
            (F.get(before, i) + F.char_length(F.get(p["pieces"], i))).alias("begin"), F.char_length(m).alias("length"),
            F.get(p["values"], i).alias("value"))))
        return F.transform(F.filter(placed, lambda m: wanted(m["value"])),
                           lambda m: _span(rank, kind, m["begin"], m["begin"] + m["length"]))

    return F.when(text.rlike(pattern), let(parts, spans_of)).otherwise(none)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans``, which do not overlap one another, that overlap none of ``others``.

    In the order of their starts, a span overlaps an earlier other one if the furthest end so far lies beyond its
    start, and a later one only if that comes next.
    """
    tag = lambda mine: lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s["end"].alias("end"), s.alias("span"))

    def clear(line):
        reach = scan(F.transform(line, lambda s: F.when(s["mine"], F.lit(0).cast("long")).otherwise(s["end"])), F.greatest)
        free = lambda s, i, ends: (F.get(ends, i) <= s["start"]) & F.coalesce(
            F.get(line, i + 1)["mine"] | (F.get(line, i + 1)["start"] >= s["end"]), F.lit(True))
        return let(reach, lambda ends: F.transform(F.filter(line, lambda s, i: s["mine"] & free(s, i, ends)), lambda s: s["span"]))

    both = F.sort_array(F.concat(F.transform(spans, tag(True)), F.transform(others, tag(False))))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(both, clear)).otherwise(spans)


def known_spans(text: Column, kind: str) -> Column:
    pattern, group, least = FORMS[kind]
    rank = list(FORMS).index(kind)
    # The cheap pattern finds the texts that can have a match at all.
    quick = {"access": rf"AKIA[A-Z0-9]{{{least - 4},}}", "hex": rf"[0-9a-f]{{{least},}}"}.get(kind, pattern)
    if group == 0:
        # A run that is long enough is found alike by the pattern with that length, without the short ones.
        return matches(text, quick, rank, kind, lambda m: F.lit(True))
    return matches(text, pattern, rank, kind, lambda value: F.char_length(value) >= least, group)


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest entropy in bits of any ``window`` neighbouring characters; null if there are fewer."""
    letters = F.transform(F.sequence(F.lit(1), F.char_length(value)),
                          lambda i: F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1))) - 1)
    # c log2 c for the counts that a window can have.
    part = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(window + 2)])
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
                     F.lit(None).cast("double").alias("least"))

    def least_of(codes):
        def step(acc, i):
            comes, goes = F.get(codes, i), F.get(codes, i - window)
            # The count that goes down already has the character that came in.
            moved = F.struct(comes.alias("comes"), goes.alias("goes"), F.get(acc["counts"], comes).alias("up"),
                             (F.get(acc["counts"], goes) + F.when(comes == goes, 1).otherwise(0)).alias("down"))
            return let(moved, lambda m: let(
                acc["sum"] + F.get(part, m["up"] + 1) - F.get(part, m["up"])
                + F.when(i >= window, F.get(part, m["down"] - 1) - F.get(part, m["down"])).otherwise(F.lit(0.0)),
                lambda total: F.struct(
                    F.transform(acc["counts"], lambda c, k: c + F.when(k == m["comes"], 1).otherwise(0)
                                - F.when((i >= window) & (k == m["goes"]), 1).otherwise(0)).alias("counts"),
                    total.alias("sum"),
                    F.when(i >= window - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["least"])

    return F.lit(math.log2(window)) - let(letters, least_of) / window


def is_random(value: Column) -> Column:
    """Whether some window of the candidate reaches the bound of its class and nothing allows it."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    bound = F.lit(False)
    for pattern, alphabet, bits in reversed(CLASSES.values()):
        bound = F.when(value.rlike(pattern), window_entropy(value, alphabet) >= bits).otherwise(bound)
    return ~allowed & bound


def scan_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns (all by default) with ``base`` and ``spans``: arrays of (start, rank, end, kind).

    ``base`` are the known forms; ``spans`` are these and the candidates of high entropy that overlap none
    of them. Both are sorted by start, then kind. Columns of these names in the input are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    frame = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    frame = frame.withColumn("_base", F.sort_array(F.concat(*[known_spans(F.col("_t"), kind) for kind in FORMS])))
    random = matches(F.col("_t"), CANDIDATE, len(FORMS), ENTROPY, is_random)
    frame = frame.withColumn("_random", random)
    spans = F.sort_array(F.concat("_base", apart(F.col("_random"), F.col("_base"))))
    return frame.select(*names, F.col("_base").alias("base"), spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
