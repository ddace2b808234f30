"""Every registered query against its SQL on the smallest tables, or at least its rows."""

import math

import duckdb
import pytest

from sensorloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or math.isclose(a, float(b), rel_tol=1e-6, abs_tol=2e-6))
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), round(x, 2) if isinstance(x, float) else x) for x in r])


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, sf_dir, name):
    want = db.sql(SQL[name])
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ordered([tuple(r) for r in got.select(*want.columns).collect()]), ordered(want.fetchall())
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s)), [(r, s) for r, s in zip(a, b) if not all(map(same, r, s))][:3]


def test_library_stands_alone():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "sensorloom.llm" not in path.read_text(), path
