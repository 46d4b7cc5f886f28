"""Training logs and what is chosen from them, where tenths lie by a half."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tileframe.plans.queries import LOG, ORACLES, QUERIES
from tileframe.plans.tables import epoch_log


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Each user's first value rounds up to the tenth that the second one is just below: 27.45 % 7 is 6.449999999999999."""
    path = tmp_path_factory.mktemp("halves")
    values = [(27.49, 27.45), (20.95, 21.0), (33.42, 33.45), (10.35, 10.4), (-27.49, -27.45), (0.05, 0.14)]
    rows = [(10 * u + 5 - 3 * k, u, 60 * k, v) for u, pair in enumerate(values) for k, v in enumerate(pair)]
    rows += [(1000 + k, 100, k, k / 100) for k in range(2000)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, s int, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(path / "events.parquet"))
    return str(path)


def duck(folder, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con.execute(sql)


def test_tenths_as_in_sql(spark, folder):
    want = duck(folder, f"WITH {LOG} SELECT run_id, epoch, score + 0.0, tie_breaker + 0.0, val_loss FROM lg").fetchall()
    got = [(r.run_id, r.epoch, r.score + 0.0, r.tie_breaker + 0.0, r.val_loss) for r in epoch_log(spark, folder).collect()]
    assert len(got) == 2012 and sorted(got) == sorted(want)


@pytest.mark.parametrize("name", ["running_best", "early_stop"])
def test_chosen_as_in_sql(spark, folder, name):
    cur = duck(folder, ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in QUERIES[name](spark, folder).collect())
