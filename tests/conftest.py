import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rowlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def text_table(spark):
    """A text table from rows of cells; row numbers follow the list."""
    from rowlens.operators.table import Table

    def make(names, rows, facts=None):
        schema = "row_number bigint, " + ", ".join(f"c{i} string" for i in range(len(names)))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        return Table.from_dataframe(df, names=names, facts=facts)

    return make
