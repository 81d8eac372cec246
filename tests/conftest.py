import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowgraph.session import session

    settings = {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.ui.showConsoleProgress": "false",
    }
    found = session("local[4]", 4, settings)
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def connect(sf: str):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for file in (DATA / sf).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        return con

    return connect


def same_rows(spark_frame, frame) -> None:
    """Both results have the same columns, and the same rows in any order (doubles to nine digits)."""

    def plain(x):
        if x is None or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 9) if isinstance(x, float) else x

    columns = sorted(spark_frame.columns)
    assert columns == sorted(frame.columns)
    a = sorted(repr([plain(x) for x in row]) for row in spark_frame.toPandas()[columns].itertuples(index=False, name=None))
    b = sorted(repr([plain(x) for x in row]) for row in frame[columns].itertuples(index=False, name=None))
    assert a == b


@pytest.fixture(scope="session")
def same():
    return same_rows
