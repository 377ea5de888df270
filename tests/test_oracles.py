"""Every registered query of the library against its oracle, small scale."""

import duckdb
import pytest

from taketriage.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(data, columns, order):
    at = [columns.index(c) for c in order]
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(flat(r[i]) for i in at) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    out = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    assert rows(got, df.columns, order) == rows(out.fetchall(), columns, order)
