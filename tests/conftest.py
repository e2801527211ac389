import random
from datetime import timedelta

import pytest
from pyspark.sql import SparkSession
from series_help import START


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def frame(spark):
    """Makes a frame of daily rows from ``{symbol: [value, ...]}`` or ``{symbol: [(open, close), ...]}``."""

    def make(series: dict, columns: tuple[str, ...] = ("x",)):
        rows = []
        for symbol, values in series.items():
            for i, v in enumerate(values):
                rows.append((symbol, START + timedelta(days=i), *(v if isinstance(v, tuple) else (v,))))
        random.Random(1).shuffle(rows)
        return spark.createDataFrame(rows, "symbol string, ts timestamp, " + ", ".join(f"{c} double" for c in columns))

    return make
