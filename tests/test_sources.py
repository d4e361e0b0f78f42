import pytest

from tidemark import session
from tidemark.operators import features
from tidemark.sources import readers, writers


@pytest.fixture()
def sample(tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text("date,x,y\n2023-01-02,2.0,4.0\n2023-01-01,1.0,3.0\n")
    return str(path)


def test_series_and_rows(spark, sample):
    series = readers.read_source(spark, sample, "timeseries", "date")
    assert [(str(r["date"])[:10], r["x"], r["y"]) for r in series.orderBy("date").collect()] == [
        ("2023-01-01", 1.0, 3.0), ("2023-01-02", 2.0, 4.0)]
    assert readers.read_source(spark, sample).columns == ["date", "x", "y"]
    with pytest.raises(ValueError):
        readers.read_csv(spark, sample, "timeseries", "absent")
    typed = readers.read_csv(spark, sample, "TIMESERIES", schema="date string, x double, y double")
    assert dict(typed.dtypes)["date"] == "timestamp"


def test_unparsable_time_stays_raw(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("date,x\n2023-01-01,1\nlater,2\n")
    out = readers.read_csv(spark, str(path), "timeseries")
    assert sorted(r["date"] for r in out.collect()) == ["2023-01-01", "later"]


def test_edge_cases(spark, tmp_path, sample):
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert readers.read_csv(spark, str(empty)).isEmpty()
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    for bad in ("rows.json", "feast://store"):
        with pytest.raises(ValueError):
            readers.read_source(spark, bad)
    with pytest.raises(ValueError):
        readers.read_source(spark, sample, "graph")
    wide = tmp_path / "wide.csv"
    wide.write_text("a\nnot a number\n")
    with pytest.raises(Exception, match="Malformed records"):
        readers.read_csv(spark, str(wide), schema="a int").collect()


def test_splits_and_entities(spark, tmp_path, sample):
    with pytest.raises(ValueError):
        readers.read_splits(spark, test_path=sample)
    with pytest.raises(ValueError):
        readers.read_splits(spark, train_path=sample)
    out = readers.read_splits(spark, train_path=sample, test_path=sample)
    assert {r["dataset"]: r["count"] for r in out.groupBy("dataset").count().collect()} == {"train": 2, "val": 2, "test": 2}
    assert readers.read_splits(spark, sample).columns == ["date", "x", "y"]
    entities = readers.read_entities(spark, sample, "x", "date", ["y"])
    assert entities.columns == ["x", "date", "y"] and dict(entities.dtypes)["date"] in ("timestamp", "date")
    with pytest.raises(ValueError):
        readers.read_entities(spark, "rows.txt", "x", "date")


def test_catalog_table(spark):
    spark.range(3).createOrReplaceTempView("three_rows")
    assert readers.read_source(spark, "table://three_rows").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "id int, prediction double")
    writers.write_predictions(df, str(tmp_path / "p"), form="parquet")
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["prediction"]
    with pytest.raises(ValueError):
        writers.write_predictions(df, str(tmp_path / "q"), form="xml")
    rows = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", float("nan")), ("d", None)], "metric string, value double")
    for step in (0, 1):
        writers.write_metrics(rows, str(tmp_path / "m"), "run", step)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("run", 0, "a", 1.0), ("run", 1, "a", 1.0)]


def test_ingest(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", 1.0)], "date string, v double")
    out = features.normalise_series(df).first()
    assert out["location_id"] == 1 and str(out["event_timestamp"]) == "2024-01-01 05:00:00"
    rows = spark.createDataFrame([(7, "x", None)], "k int, a string, b string")
    out = features.normalise_rows(rows, ["a", "b"], "k", "2024-02-01").first()
    assert (out["a"], out["b"], out["passenger_id"]) == ("x", "unknown", 7)


class OtherSession:
    """What a cluster session answers about its shared folder."""

    def __init__(self, configured, master):
        self.conf = self
        self.sparkContext = self
        self.configured, self.master, self.folder = configured, master, None

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.configured or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session(spark):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    cluster = OtherSession("hdfs://shared/checkpoints", "yarn")
    assert session.scratch_path(cluster, "x").startswith("hdfs://shared/checkpoints/x-")
    assert cluster.folder == "hdfs://shared/checkpoints"
    with pytest.raises(RuntimeError):
        session.shared_dir(OtherSession(None, "yarn"))
    assert session.cut_lineage(spark.range(3)).count() == 3
