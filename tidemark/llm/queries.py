"""The queries of this package over the test tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, clusters, language, leaks, licences, lines, mixing, nearcopies, quality, ranking, secrets, sharding, toxicity)
from tidemark.llm.small import attach
from tidemark.operators.ordering import sorted_index

QUERIES = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
LABEL_ROWS = 1_000_000
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function
    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def remainder(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def _span_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(seps[1:i], lambda x: length(x)))
           + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n, hits[i] AS hit
  FROM (SELECT doc_id, seps, hits, vals, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(t, '{pattern}') AS seps, regexp_extract_all(t, '{pattern}') AS hits,
           regexp_extract_all(t, '{pattern}', {group}) AS vals FROM d))
  WHERE length(vals[i]) >= {least}"""


def _secrets_sql() -> str:
    forms = " UNION ALL ".join(_span_sql(kind, rank, *form) for rank, (kind, form) in enumerate(secrets.FORMS.items()))
    allowed = " OR ".join(f"regexp_matches(hit, '{p}')" for p in secrets.ALLOWED)
    windows = f"list_transform(range(1, n - {secrets.WINDOW - 2}), lambda j: list_entropy(string_split(substr(hit, j::INT, {secrets.WINDOW}), '')))"
    cases = " ".join(f"WHEN regexp_matches(hit, '{p}') THEN list_max({windows}) >= {bits}"
                     for p, _, bits in secrets.CLASSES.values())
    joined = "string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, rank)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({forms}),
cand AS ({_span_sql(secrets.ENTROPY, len(secrets.FORMS), secrets.CANDIDATE, 0, 0)}),
extra AS (SELECT * FROM cand WHERE NOT ({allowed}) AND CASE {cases} END
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = cand.doc_id AND b.s < cand.s + cand.n AND cand.s < b.s + b.n)),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, {joined} AS written FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {joined} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(written, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


@query(_secrets_sql())
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, folder), ["doc_id"])
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.FORMS],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


@query()
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    learned = docs.where(remainder(3) != 1).select("doc_id", "text")
    model = toxicity.fit_toxicity(attach(learned, labels, ["doc_id"], limit=LABEL_ROWS))
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")


@query(f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
levels AS (SELECT doc_id, n_bytes, unnest(range(0, 41)) AS depth, key FROM d),
sized AS (SELECT doc_id, n_bytes, depth, (key >> (60 - depth)::INT) AS prefix,
  sum(n_bytes) OVER (PARTITION BY depth, key >> (60 - depth)::INT) AS shard_bytes,
  count(*) OVER (PARTITION BY depth, key >> (60 - depth)::INT) AS shard_docs FROM levels),
first AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS r FROM sized WHERE shard_bytes <= {SHARD_BYTES})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth::INT) END AS shard,
  depth, shard_bytes::BIGINT AS shard_bytes, shard_docs FROM first WHERE r = 1""")
def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The texts are written into shards; all columns but doc_id are read off what was written."""
    return sharding.deliver_shards(documents(spark, folder), SHARD_BYTES, keep=["doc_id", "text"]).drop("text")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN s USING (key) GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.dedup_lines(documents(spark, folder), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_classes(documents(spark, folder)).select("doc_id", "class_id", "class_docs")


@query()
def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    found = licences.scan_licences(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", F.array_join("own", ",").alias("own"), "score",
                        F.array_join("licences", ",").alias("licences"), F.coalesce("source_dir", F.lit("")).alias("source_dir"))


@query()
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.fit_languages(docs.where(remainder(4) != 2))
    predicted = language.predict_languages(docs, model, keep=["doc_id"])
    return predicted.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = leaks.mark_leaks(documents(spark, folder), items, keep=["doc_id"])
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"),
                        F.transform("leaks", lambda x: x["item_id"]).alias("items"),
                        F.array_join(F.transform("leaks", lambda x: F.concat_ws(
                            ":", x["item_id"].cast("string"), x["start"].cast("string"), x["end"].cast("string"),
                            x["edits"].cast("string"))), ",").alias("spans"))


def _quality_sql(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    rules = quality.RULES
    levels = len(next(iter(rules.values()))[2])
    ratio = {name: f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)" for name, (formula, _, _) in rules.items()
             for a, b in [formula.split(" / ")]}
    cells = ", ".join(f"({level}, {', '.join(repr(cuts[level]) + '::DOUBLE' for _, _, cuts in rules.values())})" for level in range(levels))
    broken = " OR ".join(f'"{name}" {">" if high else "<"} cut_{name}' for name, (_, high, _) in rules.items())
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS_SQL} AS words FROM documents),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang AS stratum, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, length(t) - length(translate(t, '!', '')) AS n_marks,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
c AS (SELECT * EXCLUDE (ls), len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM f),
r AS (SELECT *, {', '.join(f'{sql} AS "{name}"' for name, sql in ratio.items())} FROM c),
path(level, {', '.join(f'cut_{name}' for name in rules)}) AS (VALUES {cells}),
hit AS (SELECT stratum, level, count(*) AS n, count(*) FILTER ({broken}) AS k
  FROM r CROSS JOIN path WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
risk AS (SELECT stratum, level, CASE WHEN k < {alpha!r} * n THEN list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) ELSE 1 END AS p FROM hit),
safe AS (SELECT stratum, coalesce(min(level) FILTER (p > {delta!r} / (SELECT count(DISTINCT coalesce(stratum, '')) FROM risk)), {levels}) - 1 AS level
  FROM risk GROUP BY stratum),
o AS (SELECT r.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce({broken}, false) AS broken
  FROM r LEFT JOIN safe ON r.stratum IS NOT DISTINCT FROM safe.stratum LEFT JOIN path USING (level))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT broken AS kept FROM o"""


@query(_quality_sql())
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge(documents(spark, folder), labels.where("quality = 1").select(F.col("doc_id").alias("doc")))
    return judged.select(F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def weights_in_turn(sources: DataFrame) -> DataFrame:
    """Sources in code point order, null last, weigh 3, 1, 2 in turn."""
    ranked = sorted_index(sources.withColumn("missing", F.col("source").isNull()), ["missing", "source"], "rank")
    turn = F.col("rank") % 3
    return ranked.select("source", "source_size", F.when(turn == 0, 3).when(turn == 1, 1).otherwise(2).alias("weight"))


@query(f"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|'
    || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
t AS (SELECT 1.5 * sum(source_size)::DOUBLE AS total FROM s),
o AS (SELECT s.*, 2.0 * source_size / weight AS ratio, coalesce(sum(2.0 * source_size) OVER w, 0.0)::DOUBLE AS caps,
    (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS open FROM s
  WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT min_by((total - caps) / open, ratio) FILTER (ratio >= (total - caps) / open) AS level FROM o, t),
p AS (SELECT s.*, CASE WHEN level IS NULL OR 2.0 * source_size < level * weight THEN 2.0 * source_size ELSE level * weight END::DOUBLE AS target FROM s, level),
q AS (SELECT *, floor(target / nullif(source_size, 0)) AS whole, target - floor(target / nullif(source_size, 0)) * source_size AS need FROM p),
c AS (SELECT d.*, source_size, target, whole, need, sum(size) OVER (PARTITION BY d.source ORDER BY key) AS after
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, after - size AS before FROM c)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (coalesce(whole, 0) + CASE WHEN need > 0 AND (after < need
  OR (before < need AND after >= need AND after - need <= need - before)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.plan_mix(documents(spark, folder), weights_in_turn)
    taken = mixing.with_copies(mix.rows, mix)
    return taken.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                        (F.col("size") * F.col("copies")).alias("taken"))


@query(f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{ranking.TERM}') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{ranking.TERM}')) AS term FROM benchmark),
s AS (SELECT count(*) AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, big_n),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM r WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10""")
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    return ranking.rank_documents(documents(spark, folder), items, 10)


@query()
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.Tokenizer.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_texts(documents(spark, folder), tokenizer, keep=["doc_id"])
    return bpe.decode_ids(encoded, tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, min([distance, cluster]) AS best FROM (
    SELECT vec_id, cluster, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM p JOIN c{r} c USING (j) GROUP BY vec_id, cluster)
  GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT cluster, j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT best[2] AS cluster, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
    FROM a{r} JOIN p USING (vec_id) GROUP BY ALL) m USING (cluster, j))""")
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM v),
c0 AS MATERIALIZED (SELECT cluster, x, j FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS cluster
  FROM v QUALIFY cluster < {k}) USING (vec_id)),{",".join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h ON cluster = best[2]"""


@query(_clusters_sql())
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    assigned, centroids = clusters.cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    # At most eight centroids.
    return assigned.join(F.broadcast(centroids.select("cluster", "cluster_inertia", "inertia", digest)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
