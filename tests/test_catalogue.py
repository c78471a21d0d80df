"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from tidefold import catalogue  # noqa: E402


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_ring_successor_sends_one_row_through_the_driver(spark):
    df = catalogue.queries()["j7_ring_successor"](spark, DATA)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()  # as it ran and as it was planned
    sent = re.findall(r"BroadcastExchange [^\n]*\n\W*([^\n]*)", plan)
    assert sent and all(re.match(r"(\*\(\d+\) )?ObjectHashAggregate\(keys=\[\],", x) for x in sent), sent


def test_pull_takes_the_whole_log(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id").collect()
    want, at = [], {}
    for r in sorted(events, key=lambda r: (r["ts"], r["event_id"])):
        at[r["user_id"]] = at.get(r["user_id"], 0) + 1
        want.append((r["user_id"], r["event_id"], at[r["user_id"]]))
    got = catalogue.queries()["s13_pull_logs"](spark, DATA).collect()
    assert len(want) > 200 and sorted(map(tuple, got)) == sorted(want)


def test_enrolment_is_judged_over_the_whole_log(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "user_id", "event_type").collect()
    last = {r["user_id"]: r["event_type"] != "error" for r in sorted(events, key=lambda r: r["event_id"])}
    got = catalogue.queries()["l11_enrolled_log"](spark, DATA).filter("quarter = 4").collect()
    assert len(events) > 600 and sorted(r["member"] for r in got) == sorted(u for u, on in last.items() if on)
