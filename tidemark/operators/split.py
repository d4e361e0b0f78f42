"""Splits and folds.

A split is decided by a few exact cut values, not by numbering every row. One job counts the rows and
summarises the order axis, which brackets every cut between two close values; a second one counts the
rows between the brackets and the values inside them, which settles all cuts exactly. The result is a
plain predicate, so tagging a table is a map-only pass, and a time split can be pushed down to the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import (
    CHUNK, MAX_BROADCAST_RANKS, MAX_ROWS_PER_TASK, NUMBER_LIKE, SeriesLayout, order_number, prefix_sum, row_index, select_ranks,
    sorted_index,
)

# Fixed values of the default split.
DEFAULT_RATIOS = {"train": 0.6, "val": 0.2, "test": 0.2}
DEFAULT_SEED = 42

TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
# The summary of an order axis is off by at most one row in so many.
ACCURACY = 100_000
# A smaller summary is faster; where its bracket holds too many rows, it is bracketed again.
MEDIAN_ACCURACY = 2_000
# Rows that one chunk of the random order should hold.
ROWS_PER_HASH_CHUNK = 250_000


def shuffle_key(columns: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """A reproducible random order. The columns should identify a row: rows that
    agree in all of them always end up in the same part."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.md5(text)


def hash_number(column: str = "_hash") -> Column:
    """The leading 48 bits of the hash."""
    return F.conv(F.substring(column, 1, 12), 16, 10).cast("double")


def hash_chunk(n: int) -> Column:
    """The leading hex digits of the hash: equally likely chunks, as many as ``n`` rows need."""
    digits = 1
    while n > ROWS_PER_HASH_CHUNK * 16**digits:
        digits += 1
    return F.substring("_hash", 1, digits)


def sizes(n: int, ratios: dict[str, float]) -> tuple[int, int]:
    train, val, test = ratios["train"], ratios.get("val", 0.0), ratios["test"]
    if test <= 0:
        raise ValueError("the test part must not be empty")
    if train + val + test > 1 + 1e-9:
        raise ValueError("the parts add up to more than 1")
    return int(n * train), int(n * val)


def _before(order: Sequence[str], values: Sequence[Column]) -> Column:
    """Whether a row comes strictly before the row with these order values."""
    result = F.lit(False)
    for column, value in reversed(list(zip(order, values))):
        result = (F.col(column) < value) | ((F.col(column) == value) & result)
    return result


def _literals(df: DataFrame, rows: DataFrame, numbers: Sequence[str], columns: Sequence[str]) -> list[tuple]:
    """Driver copies of a few rows: the numbers, then the columns as typed literals."""
    kinds = {c: df.schema[c].dataType for c in columns}
    # Times travel as text, so the driver's own time zone cannot shift them.
    text = [F.col(c).cast("string") if isinstance(kinds[c], TIMES) else F.col(c) for c in columns]
    n = len(numbers)
    return [
        (*row[:n], *[F.lit(value).cast(kinds[c]) for c, value in zip(columns, row[n:])])
        for row in rows.select(*numbers, *text).collect()
    ]


def _brackets(spots: Sequence[float], accuracy: int) -> list[float]:
    """Two positions around each wanted one that the summary's error cannot reach past."""
    return [p for spot in spots for p in (max(0.0, spot - 3 / accuracy), min(1.0, spot + 3 / accuracy))]


def _merged(ends: Sequence[float], positions: Sequence[float]) -> list[tuple[float, float]]:
    """Disjoint intervals in order; a bracket at the edge of the axis is open."""
    pairs = sorted(
        (float("-inf") if p <= 0 else a, float("inf") if q >= 1 else b)
        for a, b, p, q in zip(ends[::2], ends[1::2], positions[::2], positions[1::2]))
    out = [pairs[0]]
    for low, high in pairs[1:]:
        if low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _region(at: Column, intervals: Sequence[tuple[float, float]]) -> Column:
    """2 i + 1 inside interval i, 2 i between it and the one before."""
    region = F.lit(2 * len(intervals))
    for i, (low, high) in reversed(list(enumerate(intervals))):
        region = F.when(at < low, 2 * i).when(at <= high, 2 * i + 1).otherwise(region)
    return region


def _narrowed(rows: DataFrame, intervals: list[tuple[float, float]], ranks: Sequence[int], accuracy: int) -> list[tuple[float, float]]:
    """Closer brackets inside the given ones, from the summary of every interval by itself."""
    counts = {r["_region"]: r["count"] for r in rows.groupBy(_region(F.col("_at"), intervals).alias("_region")).count().collect()}
    below, asked = 0, []
    for region in range(2 * len(intervals) + 1):
        n = counts.get(region, 0)
        if region % 2:
            asked.append(_brackets([(r - below) / n for r in ranks if below <= r < below + n], accuracy))
        below += n
    if sum(map(len, asked)) < 2 * len(ranks):
        return intervals  # a rank outside; the caller looks elsewhere
    inside = lambda low, high: F.when((F.col("_at") >= low) & (F.col("_at") <= high), F.col("_at"))
    found = rows.agg(*[F.percentile_approx(inside(*pair), spots or [0.5], accuracy) for pair, spots in zip(intervals, asked)]).first()
    out = []
    for (low, high), spots, ends in zip(intervals, asked, found):
        if spots:
            out += [(max(a, low), min(b, high)) for a, b in _merged(ends, spots)]
    return out


def _cuts_of(
    df: DataFrame, order: Sequence[str], ranks_of: Callable[[int], list[int]], guesses: Sequence[float],
    number: Column | None = None, max_rows: int | None = None, accuracy: int | None = None,
) -> tuple[list[int], dict[int, tuple[Column, ...]]]:
    """The wanted ranks, and the order values, as literals, of the rows at those ranks that exist.

    ``ranks_of`` gives the ranks for a number of rows, ``guesses`` say where on the axis they will about
    be. ``number`` is a number that never decreases along the first order column, if that is text.
    The first column is resolved alone; where several rows share a wanted value the others decide.
    """
    limit, accuracy = max_rows or MAX_ROWS_PER_TASK, accuracy or ACCURACY
    head, rest = order[0], list(order[1:])
    if number is None and not isinstance(df.schema[head].dataType, NUMBER_LIKE):
        # Text has no summary: number the rows over a distributed sort.
        ranks = ranks_of(df.count())
        numbered = sorted_index(df.select(*order), order, "rank").where(F.col("rank").isin(ranks))
        return ranks, {rank: tuple(values) for rank, *values in _literals(df, numbered, ["rank"], order)}
    rows = df.select(*order, (order_number(df, head) if number is None else number).cast("double").alias("_at"))
    spots = _brackets(guesses, accuracy)
    n, ends = rows.agg(F.count(F.lit(1)), F.percentile_approx("_at", spots, accuracy)).first()
    ranks = ranks_of(n)
    wanted = sorted({r for r in ranks if 0 <= r < n})
    if not wanted:
        return ranks, {}
    intervals, wider = _merged(ends, spots), 1
    while True:
        # So many rows may lie inside the brackets; more than a task should sort are bracketed again.
        inside = n * 8 / accuracy * len(intervals)
        while wider == 1 and inside > limit and len(wanted) < inside:
            intervals, inside = _narrowed(rows, intervals, wanted, accuracy), inside * min(0.1, 8 / accuracy)
        found = _inside_brackets(df, rows, head, intervals, wanted)
        if len(found) == len(wanted):
            break
        # The guesses were off: the true positions are known now. Wider brackets end with the whole axis.
        wider *= 4
        spots = _brackets([r / n for r in wanted], max(2, 4 * accuracy // wider))
        intervals = _merged(rows.agg(F.percentile_approx("_at", spots, accuracy)).first()[0], spots)
    out = {rank: (value,) for rank, _, _, value in found}
    tied = [f for f in found if f[2] > 1] if rest else []
    if any(equal > limit for _, _, equal, _ in tied):
        for rank, offset, equal, value in tied:
            same = df.where(F.col(head) == value).select(*rest)
            _, at = _cuts_of(same, rest, lambda _, offset=offset: [offset], [offset / equal], None, max_rows)
            out[rank] = (value, *at[offset])
    elif tied:
        # Few rows share a wanted value: one job settles all ranks.
        among = Window.partitionBy(head).orderBy(*rest)
        asked = reduce(lambda a, b: a | b, [F.col(head) == value for _, _, _, value in tied])
        rank_of = F.coalesce(*[
            F.when((F.col(head) == value) & (F.col("_at") == offset), F.lit(rank)) for rank, offset, _, value in tied
        ])
        held = df.where(asked).withColumn("_at", F.row_number().over(among) - 1).withColumn("rank", rank_of)
        for rank, *values in _literals(df, held.where(F.col("rank").isNotNull()), ["rank"], order):
            out[rank] = tuple(values)
    return ranks, out


def _inside_brackets(df: DataFrame, rows: DataFrame, head: str, intervals: list[tuple[float, float]],
                     wanted: Sequence[int]) -> list[tuple]:
    """(rank, offset among the rows of that value, their number, value) of the ranks inside the intervals."""
    region = _region(F.col("_at"), intervals)
    cells = rows.groupBy(region.alias("_region"), F.when(region % 2 == 1, F.col(head)).alias(head)).agg(F.count(F.lit(1)).alias("equal"))
    before = Window.orderBy("_region", head).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("equal").over(before), F.lit(0))
    placed = cells.withColumn("_first", first).where(F.col("_region") % 2 == 1)
    held = F.filter(F.array(*[F.lit(r).cast("long") for r in wanted]),
                    lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("equal")))
    picked = placed.withColumn("rank", F.explode(held)).withColumn("offset", F.col("rank") - F.col("_first"))
    return _literals(df, picked, ["rank", "offset", "equal"], [head])


def lower_median(df: DataFrame, column: str, max_rows: int | None = None) -> Column | None:
    """The exact median of the values, as a literal; of two in the middle the smaller one, None without values."""
    values = df.select(column).where(F.col(column).isNotNull())
    (rank,), at = _cuts_of(values, [column], lambda n: [(n - 1) // 2], [0.5], None, max_rows, MEDIAN_ACCURACY)
    return at[rank][0] if rank in at else None


def _cut_tags(order: Sequence[str], cuts: list[tuple[tuple | None, str]], last: str) -> Column:
    tag = F.lit(last)
    for values, name in reversed(cuts):
        tag = tag if values is None else F.when(_before(order, values), F.lit(name)).otherwise(tag)
    return tag


def _split_tags(rows: DataFrame, order: Sequence[str], ratios: dict[str, float], number: Column | None,
                max_rows: int | None) -> Column:
    def ranks(n: int) -> list[int]:
        n_train, n_val = sizes(n, ratios)
        return [n_train, n_train + n_val]

    train, val = float(ratios["train"]), float(ratios.get("val", 0.0))
    (first, second), at = _cuts_of(rows, order, ranks, [train, min(1.0, train + val)], number, max_rows)
    return _cut_tags(order, [(at.get(first), "train"), (at.get(second), "val")], "test")


def chronological_split(
    df: DataFrame,
    order: Sequence[str],
    ratios: dict[str, float] | None = None,
    keys: Sequence[str] = (),
    out: str = "dataset",
    layout: SeriesLayout | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Tag the earliest rows ``train``, the next ``val``, the rest ``test``.

    ``order`` must be total and without nulls. With ``keys`` each series is split
    on its own; without, the whole table is split at two literal cut points.
    """
    ratios = ratios or DEFAULT_RATIOS
    sizes(1, ratios)
    if keys:
        indexed = row_index(df, keys, order, "_row", "_rows", layout)
        train = F.floor(F.col("_rows") * F.lit(ratios["train"]))
        val = F.floor(F.col("_rows") * F.lit(ratios.get("val", 0.0)))
        tag = (F.when(F.col("_row") < train, "train")
               .when(F.col("_row") < train + val, "val").otherwise("test"))
        tagged = indexed.withColumn(out, tag).drop("_row", "_rows")
    else:
        tagged = df.withColumn(out, _split_tags(df.select(*order), order, ratios, None, max_rows))
    return tagged if ratios.get("val", 0.0) else test_as_val(tagged, out)


def random_split(
    df: DataFrame,
    key: Sequence[str],
    ratios: dict[str, float] | None = None,
    seed: int = DEFAULT_SEED,
    out: str = "dataset",
    max_rows: int | None = None,
) -> DataFrame:
    """Exact-size split in a reproducible random order of the row key."""
    ratios = ratios or DEFAULT_RATIOS
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    tags = _split_tags(hashed.select("_hash"), ["_hash"], ratios, hash_number(), max_rows)
    tagged = hashed.withColumn(out, tags).drop("_hash")
    return tagged if ratios.get("val", 0.0) else test_as_val(tagged, out)


def train_subset(df: DataFrame, ratio: float, order: Sequence[str] | None = None,
                 key: Sequence[str] | None = None, seed: int = DEFAULT_SEED) -> DataFrame:
    """The first ``int(n * ratio)`` rows: in time order, or in random order of ``key``."""
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"invalid train ratio: {ratio}")
    parts = {"train": ratio, "val": 0.0, "test": 1.0 - ratio}

    def ranks(n: int) -> list[int]:
        if n == 0:
            raise ValueError("the table is empty")
        if int(n * ratio) <= 0:
            raise ValueError("the training subset is empty")
        return [sizes(n, parts)[0]]

    if order:
        (cut,), at = _cuts_of(df.select(*order), order, ranks, [ratio])
        return df.where(_before(order, at[cut]))
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    (cut,), at = _cuts_of(hashed.select("_hash"), ["_hash"], ranks, [ratio], hash_number())
    return hashed.where(_before(["_hash"], at[cut])).drop("_hash")


def test_as_val(df: DataFrame, out: str = "dataset") -> DataFrame:
    """Use the test rows a second time as ``val``; one pass, no second scan."""
    tags = F.when(F.col(out) == "test", F.array(F.lit("test"), F.lit("val"))).otherwise(F.array(F.col(out)))
    return df.withColumn(out, F.explode(tags))


test_as_val.__test__ = False  # not a pytest case


def tagged_parts(df: DataFrame, out: str = "dataset") -> dict[str, DataFrame]:
    """The three parts of a tagged table; an empty ``val`` part is replaced by ``test``."""
    parts = {name: df.where(F.col(out) == name).drop(out) for name in ("train", "val", "test")}
    if parts["val"].isEmpty():
        parts["val"] = parts["test"]
    return parts


def _fold_starts(n: int, k: int) -> list[int]:
    """First rank of each fold: sizes differ by at most one, larger folds first."""
    return [i * (n // k) + min(i, n % k) for i in range(k)]


def kfold(
    df: DataFrame,
    k: int,
    key: Sequence[str],
    seed: int = DEFAULT_SEED,
    shuffle: bool = True,
    out: str = "fold",
    max_rows: int | None = None,
) -> DataFrame:
    """Number the test fold of each row; without shuffling, folds are blocks in ``key`` order."""
    def ranks(n: int) -> list[int]:
        if not 2 <= k <= n:
            raise ValueError(f"cannot make {k} folds of {n} rows")
        return _fold_starts(n, k)[1:]

    if shuffle:
        source, order, number = df.withColumn("_hash", shuffle_key(key, seed)), ["_hash"], hash_number()
    else:
        source, order, number = df, list(key), None
    starts, at = _cuts_of(source.select(*order), order, ranks, [i / k for i in range(1, k)], number, max_rows)
    fold = F.lit(0)
    for start in starts:
        fold = fold + F.when(_before(order, at[start]), 0).otherwise(1)
    return source.withColumn(out, fold.cast("int")).drop("_hash")


def stratified_kfold(
    df: DataFrame,
    k: int,
    target: str | Sequence[str],
    key: Sequence[str],
    seed: int = DEFAULT_SEED,
    out: str = "fold",
    max_rows: int | None = None,
) -> DataFrame:
    """Folds of near equal size within every class of the single target."""
    names = [target] if isinstance(target, str) else list(target)
    names = [c for c in names if c in df.columns]
    if len(names) != 1:
        raise ValueError("stratified folds need exactly one valid target column")
    by = names[0]
    hashed = df.withColumn("_hash", shuffle_key(key, seed))
    # The surplus rows of a class go to the folds after those of the class before
    # it, so that the folds as a whole also differ by at most one row.
    classes = prefix_sum(df.groupBy(by).agg(F.count(F.lit(1)).alias("n")), [by], "n", "shift").withColumn(
        "shift", F.col("shift") % k)
    fold_sizes = [
        F.floor(F.col("n") / k) + F.when(F.pmod(F.lit(i) - F.col("shift"), F.lit(k)) < F.col("n") % k, 1).otherwise(0)
        for i in range(k)
    ]
    starts, at = [], F.lit(0)
    for size in fold_sizes[:-1]:
        at = at + size
        starts.append(at.cast("long"))
    wanted = classes.select(by, F.array(*starts).alias("ranks"))
    n_classes, n = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    n = n or 0
    slim = hashed.select(by, "_hash").withColumn(CHUNK, hash_chunk(n))
    found = select_ranks(slim, [by], ["_hash"], CHUNK, wanted, n_classes)
    passed = F.size(F.filter("ranks", lambda r: r <= F.col("rank")))
    steps = found.withColumnRenamed(by, "_class").join(wanted, F.col("_class").eqNullSafe(F.col(by)))
    # One row per class, holding at most k - 1 cuts.
    cuts = steps.groupBy("_class").agg(F.collect_list(F.struct("_hash", passed.alias("fold"))).alias("_cuts"))
    reached = F.transform(
        F.filter("_cuts", lambda c: c["_hash"] <= F.col("_hash")), lambda c: c["fold"]
    )
    if n_classes <= MAX_BROADCAST_RANKS:
        cuts = F.broadcast(cuts)
    return (
        hashed.join(cuts, F.col(by).eqNullSafe(F.col("_class")), "left")
        .withColumn(out, F.coalesce(F.array_max(reached), F.lit(0)).cast("int"))
        .drop("_hash", "_cuts", "_class")
    )


def fold_table(df: DataFrame, k: int, fold: str = "fold", out: str = "dataset") -> DataFrame:
    """Long form: every row once per fold, tagged ``test`` in its own fold and ``train`` in the others."""
    return df.withColumnRenamed(fold, "_own").withColumn(
        fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    ).withColumn(out, F.when(F.col(fold) == F.col("_own"), "test").otherwise("train")).drop("_own")


def expanding_ends(n: int, k: int, input_len: int, output_len: int) -> list[int]:
    """Row counts of the growing prefixes; stops at the prefix that reaches the end."""
    room = n - output_len - input_len
    if room <= 0:
        raise ValueError(f"{n} rows are too few for input {input_len} and output {output_len}")
    step = max(1, room // k)
    ends = [min(input_len + step * (i + 1), n) for i in range(k)]
    return ends[: ends.index(n) + 1] if n in ends else ends


def expanding_prefixes(
    df: DataFrame, order: Sequence[str], k: int, input_len: int, output_len: int, max_rows: int | None = None,
) -> list[Column]:
    """The growing prefixes as conditions on a row; a prefix that holds the whole table is true."""
    ends, at = _cuts_of(df, order, lambda n: expanding_ends(n, k, input_len, output_len),
                        [(i + 1) / k for i in range(k)], max_rows=max_rows)
    return [_before(order, at[end]) if end in at else F.lit(True) for end in ends]


def expanding_folds(
    df: DataFrame,
    order: Sequence[str],
    k: int,
    input_len: int,
    output_len: int,
    out: str = "fold",
    max_rows: int | None = None,
) -> DataFrame:
    """Long form of the growing prefixes: fold ``i`` holds the earliest ``end_i`` rows.

    The rows are multiplied by the folds that hold them; :func:`expanding_prefixes` gives plain conditions.
    """
    inside = expanding_prefixes(df, order, k, input_len, output_len, max_rows)
    numbers = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]), lambda i: i.isNotNull())
    return df.withColumn(out, F.explode(numbers))


def tag_windows(
    frame: DataFrame, ratios: dict[str, float] | None = None, out: str = "dataset",
    index: str = "window_index", count: str = "window_count",
) -> DataFrame:
    """Split the windows of every series in time: the first part trains, the next validates, the last tests.

    Map-only, since a window knows its number and how many its series has. A series with too few windows
    for a part leaves that part empty.
    """
    ratios = ratios or DEFAULT_RATIOS
    sizes(1, ratios)
    cut = F.floor(F.col(count) * F.lit(float(ratios["train"])))
    cut_val = cut + F.floor(F.col(count) * F.lit(float(ratios.get("val", 0.0))))
    return frame.withColumn(out, F.when(F.col(index) < cut, "train").when(F.col(index) < cut_val, "val").otherwise("test"))
