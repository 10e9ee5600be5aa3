import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def canonical(rows):
    """Rows as sorted tuples of text, numbers rounded."""

    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        try:
            f = float(v)
            return str(int(f)) if f == int(f) and not isinstance(v, str) else repr(round(f, 6)) if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(one(x) for x in r) for r in rows)
