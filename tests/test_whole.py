"""Queries over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foldline.operators import catalog
from foldline.plans import QUERIES
from foldline.sources import lift, scans

LARGER = "/root/testdata/sf0.01"


def test_rebuilds_reach_the_head(spark):
    o = spark.read.parquet(f"{LARGER}/orders.parquet")
    writes = o.filter("o_orderstatus = 'F' or o_orderpriority = '1-URGENT'")
    want = {r["key"]: r["last"] for r in writes.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("last")).collect()}
    assert max(want.values()) > 9999
    for name in ("rebuild_cleared", "rebuild_preserved"):
        got = {r["key"]: r["value"] for r in QUERIES[name](spark, LARGER).collect()}
        assert {k: int(v[2:]) for k, v in got.items() if v != "old"} == want


def test_merge_and_progress_reach_the_head(spark):
    log = lift.all_log(spark, LARGER)
    n, head = log.count(), scans.captured(log)
    assert head > 40000 and QUERIES["kway_merge"](spark, LARGER).agg(F.count(F.lit(1)), F.max("global_position")).first() == (n, head)
    assert {r["events"] for r in QUERIES["replay_progress"](spark, LARGER).collect()} == {n}


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_positions_before(spark, run):
    rows = [(p, "ab"[p % 5 > 1]) for p in (1, 2, 3, 5, 8, 13, 21, 22, 23, 40, 41, 90)]
    want, last = {}, {}
    for p, k in rows:
        want[p], last[k] = last.get(k, 0), p
    got = scans.before(spark.createDataFrame(rows, "global_position long, k string"), "k", run=run).collect()
    assert {r["global_position"]: r["before"] for r in got} == want


def test_long_cycles_and_every_supplier(spark):
    edges = [(i, (i + 1) % 150) for i in range(150)] + [(200, 0), (201, 201)]
    found = catalog.cycles(spark.createDataFrame(edges, "name long, depends_on long"))
    assert {r["name"]: r["cycle"] for r in found.collect()} == dict.fromkeys(range(150), 0) | {201: 201}
    n = spark.read.parquet(f"{LARGER}/supplier.parquet").count()
    dep, want = {k: (k * k + 3) % n for k in range(n)}, set()
    for k in dep:
        at = dep[k]
        for _ in range(n):
            if at == k:
                want.add(k)
            at = dep[at]
    assert {r["name"] for r in QUERIES["catalog_cycle"](spark, LARGER).collect()} == want and 0 < len(want) < n
    got = {(r["grp"], r["name"], r["depends_on"]) for r in QUERIES["catalog_order"](spark, LARGER).collect()}
    assert got == {(k % 3, k, d) for k, d in dep.items() if d >= k and d % 3 == k % 3}


def test_every_event_is_decided(spark):
    n = spark.read.parquet(f"{LARGER}/events.parquet").count()
    got = QUERIES["decide_commands"](spark, LARGER)
    assert got.count() == got.select("command_id").distinct().count() == n
