"""Closures and plans over whole tables against one ordered scan."""

import pytest
from test_closure import scan
from test_planner import by_scan

from txweave.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    orders = {r.o_orderkey: r for r in spark.read.parquet(f"{DATA}/orders.parquet").collect()}
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    keys = {t: {("customer", o.o_custkey)} for t, o in orders.items()}
    for r in lines:
        if r.l_orderkey in keys:
            keys[r.l_orderkey].add(("part", r.l_partkey))
    return orders, keys


def test_closures(spark, whole):
    _, keys = whole
    got = {n: sorted(r.tx_id for r in QUERIES[n](spark, DATA).collect()) for n in ("blocked_closure_whole", "failure_closure_whole")}
    dead = scan([(t, c, k) for t, own in keys.items() for c, k in own], {t for t in keys if t % 5000 == 0})
    assert got == {"blocked_closure_whole": sorted(dead), "failure_closure_whole": sorted(keys.keys() - dead)}


def test_plan(spark, whole):
    orders, keys = whole
    live = {t: (t % 2, keys[t]) for t, o in orders.items() if o.o_orderstatus != "F"}
    bad = {t for t in live if orders[t].o_orderstatus == "P" and t % 10 == 0}
    assert sorted(r.tx_id for r in QUERIES["plan_commit_whole"](spark, DATA).collect()) == by_scan(live, bad)
