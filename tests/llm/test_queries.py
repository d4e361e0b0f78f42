"""Registered queries and the pipeline on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "labels", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, db, name):
    mine = queries.QUERIES[name](spark, FOLDER).toPandas()
    theirs = db.execute(queries.ORACLES[name]).df()[list(mine.columns)]
    key = [c for c in ("doc_id", "vec_id", "item_id", "rank") if c in mine]
    mine, theirs = (x.sort_values(key).reset_index(drop=True) for x in (mine, theirs))
    for column in mine:
        if mine[column].dtype.kind == "f":
            assert np.allclose(mine[column], theirs[column], rtol=1e-12), column
        else:
            assert mine[column].tolist() == theirs[column].tolist(), column


def test_quality_rules_reject(spark, tmp_path):
    """On the middle table rules act beyond the base check, and hardly a good document is lost to them."""
    folder = "/root/testdata/sf0.01"
    found = queries.op9_quality_rules(spark, folder).toPandas()
    db = duckdb.connect()
    good, bad = ({r[0] for r in db.execute(f"SELECT doc_id FROM '{folder}/labels.parquet' WHERE quality = {q}").fetchall()} for q in (1, 0))
    by_rules = set(found[~found.base_failed & ~found.kept].doc_id)
    assert len(by_rules & bad) >= 10 and len(by_rules & good) <= 0.05 * len(good)


def test_held_out_languages(spark, db):
    found = queries.op7_language_id(spark, FOLDER).toPandas()
    truth = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = found[found.held_out]
    assert len(found) == len(truth) and len(held) > 20
    assert np.mean([truth[i] == p for i, p in zip(held.doc_id, held.lang_pred, strict=True)]) >= 0.95


def test_held_out_toxicity(spark, db):
    found = queries.op2_toxicity(spark, FOLDER).toPandas()
    assert sorted(found.columns) == ["doc_id", "held_out", "predicted", "score"]
    assert len(found) == db.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert ((found.score >= 0.7) == (found.predicted == 1)).all() and found.score.between(0, 1).all()


def test_leaks_hold_every_verbatim_item(spark, db):
    found = {r["doc_id"]: set(r["items"]) for r in queries.op8_decontamination(spark, FOLDER).collect()}
    for doc, item in db.execute("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall():
        assert item in found[doc]


def test_pipeline(spark, db):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, FOLDER).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < docs.count() <= 2 * before
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {"text", "lang", "source", "shard"} <= set(rows.columns)
    rows = rows.collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(map(tuple, docs.select("doc_id", "text").collect()))
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(len((r["text"] or "").encode()) + 1)
    assert all(sum(sizes) == r["shard_bytes"] <= queries.SHARD_BYTES for r in rows for sizes in [held[r["shard"]]])


def test_language_stage_uses_the_prediction(spark, db):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("wrong")).otherwise(F.col("lang")))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, wrong, FOLDER).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(kept) > 0.95 * len(truth) and "wrong" not in kept.values()
    assert np.mean([truth[i] == lang for i, lang in kept.items()]) > 0.95
    # Without labels no document is lost but those without a letter.
    blank = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("text", F.when(F.col("doc_id") > 1, F.col("text")).otherwise("12"))
    assert corpus_pipeline.identify_language(spark, blank, FOLDER).count() == blank.where("doc_id > 1").count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
