"""Every registered query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from tileframe.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


def plain(rows):
    return sorted(tuple(f"{x + 0.0:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert plain([[r[n] for n in names] for r in df.collect()]) == plain(want)
