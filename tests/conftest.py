import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sievelake.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import glob

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(records, columns):
    def plain(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return f"{x + 0.0:.6g}"
        return f"{float(x):.6g}" if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 10**5 else str(x)

    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="session")
def compare(spark, duck):
    """Runs a query of a module against its SQL."""

    def run(module, name):
        got = module.QUERIES[name](spark, DATA)
        columns = sorted(got.columns)
        cursor = duck.execute(module.SQL[name])
        names = [d[0] for d in cursor.description]
        want = [dict(zip(names, r)) for r in cursor.fetchall()]
        assert columns == sorted(names)
        assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(want, columns)

    return run
