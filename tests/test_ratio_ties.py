"""Queries and their SQL on quotients next to a half of the fourth place."""

from datetime import datetime, timedelta

import duckdb
import pytest
from ledgerflow import queries as catalogue


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """B, C and D pay A, A pays B, C and D (in turns, an event a minute), and P, Q, R and S pay along a chain; an amount of
    0 only names the payee of the event before."""
    a, b, c, d, p, q, r, s = range(1, 9)
    day0 = [(a, 40.0), (b, 8.0), (a, 38.41), (c, 5.81), (a, 30.0), (d, 4.0), (a, 0.0)]
    days = [day0, [(p, 40.0), (q, 0.0)], [(q, 38.41), (r, 0.0)], [(r, 38.0), (s, 0.0)]]
    rows = [(datetime(2024, 1, 1) + timedelta(days=i, minutes=j), u, v) for i, day in enumerate(days) for j, (u, v) in enumerate(day)]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, 'view', ?)", [(i, *row) for i, row in enumerate(rows)])
    out = tmp_path_factory.mktemp("ties")
    con.execute(f"COPY e TO '{out}/events.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["motif_chunked", "motif_fanin", "motif_fanin_dedup", "motif_fanout", "motif_relay4"])
def test_same_ratios(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    cursor = con.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = sorted(str(tuple(r)) for r in catalogue.queries()[name](spark, folder).select(*columns).collect())
    assert want and got == want
    assert any(x in row for row in got for x in ("9602", "7263"))
