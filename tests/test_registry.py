import duckdb
import pytest

from orbweft.plans import queries  # noqa: F401
from orbweft.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cells(rows):
    def cell(v):
        if v is None:
            return ""
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = [tuple(r) for r in df.select(*columns).collect()]
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert cells(ours) == cells(tuple(r[i] for i in order) for r in got.fetchall())
