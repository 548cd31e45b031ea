"""Every query with an oracle gives the same rows as its SQL."""

import datetime

import duckdb
import pytest

from vigilo.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = [tuple(_value(r[at[c]]) for c in cols) for r in cur.fetchall()]
    got = [tuple(_value(r[c]) for c in cols) for r in df.collect()]
    assert _sorted(got) == _sorted(want)


def test_replay_metrics_without_alerts(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (value / 1000 as value) from read_parquet('{SF}/events.parquet')) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    df = catalog.QUERIES["replay_metrics"](spark, str(tmp_path))
    cur = con.execute(catalog.ORACLES["replay_metrics"])
    want = dict(zip([d[0] for d in cur.description], cur.fetchone()))
    got = df.first().asDict()
    assert got == want and got["alarms"] == 0 and got["precision"] is None
