import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """A skewed table: series 1 has half of the rows, series null a few; many equal times."""
    import random

    rng = random.Random(5)
    rows = []
    for i in range(1200):
        key = rng.choice([1, 1, 1, 2, 3, 4, None])
        time = rng.choice([100, 100, 100, rng.randrange(1000)])
        value = None if rng.random() < 0.3 else round(rng.uniform(0, 50), 2)
        rows.append((i, key, time, value))
    return spark.createDataFrame(rows, "id int, key int, t int, value double").repartition(5).persist()
