"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from ledgerflow import queries as catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def rows_of(records, columns):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{float(x):.4f}" if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(value(r[c]) for c in sorted(columns)) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of([r.asDict() for r in got.collect()], columns) == rows_of(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    """Queries without SQL compute rows; labels name each node of a window once, with communities of the least size."""
    got = catalogue.queries()[name](spark, sf_dir)
    rows = got.collect()
    assert rows
    if "community_id" in got.columns:
        assert len({(r.window_id, r.node) for r in rows}) == len(rows)
        sizes: dict = {}
        for r in rows:
            sizes[r.window_id, r.community_id] = sizes.get((r.window_id, r.community_id), 0) + 1
        assert all(n >= 3 for (_, c), n in sizes.items() if c != -1)
    else:
        assert all(0 <= r.suspicion_score <= 1 and r.size > 0 for r in rows)
