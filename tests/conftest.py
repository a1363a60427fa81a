import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).iterdir():
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value in a form that both engines agree on."""
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


@pytest.fixture(scope="session")
def agrees(spark, duck):
    """Holds a registered query against its SQL on the small tables."""

    def check(name):
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, SMALL)
        names = sorted(df.columns)
        got = sorted(tuple(map(plain, row)) for row in df.select(*names).collect())
        found = duck.execute(entry.oracle_sql()[name])
        titles = [d[0] for d in found.description]
        assert sorted(titles) == names
        at = [titles.index(c) for c in names]
        assert got == sorted(tuple(plain(row[i]) for i in at) for row in found.fetchall())

    return check
