"""Every registered query against another engine on the same files."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tessera import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_the_other_engine(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_second_key_spreads_each_user(spark):
    catalog = queries.sample_catalog()
    user = catalog.keyspaces["user"]
    rows = queries.table(spark, SF, "events").select("user_id", "event_id").limit(300).collect()
    engine = queries.engine(spark, SF)
    got = {r.event_id: r.owner for r in engine.owners("events").collect()}
    assert all(got[r.event_id] == user.owner(r.user_id, r.event_id) for r in rows)
    assert max(r.nodes for r in queries.QUERIES["second_key_spread"](spark, SF).collect()) == 3
