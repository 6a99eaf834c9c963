import os
import sys

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pytest

from fogline.session import build_session

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function from a folder to a DuckDB connection with its tables as views."""
    held = {}

    def of(folder):
        if folder not in held:
            con = duckdb.connect()
            con.execute("SET TimeZone='UTC'")
            for f in sorted(os.listdir(folder)):
                con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
            held[folder] = con
        return held[folder]

    return of


def normal(names, rows):
    """Rows as sorted text tuples, columns by name, doubles to six places."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(x):
        if x is None:
            return None
        if isinstance(x, float):
            return "nan" if x != x else f"{x + 0.0:.6f}".replace("-0.000000", "0.000000")
        return str(x)

    return sorted((tuple(text(r[i]) for i in order) for r in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def same_as_sql(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES.get(t) for c, t in df.dtypes} == kinds
    assert normal(df.columns, df.collect()) == normal(relation.columns, relation.fetchall())
