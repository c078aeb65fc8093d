"""Every registered query against its SQL, and the entry module without the training-data subpackage."""

from __future__ import annotations

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from foldline import plans

from .conftest import ROOT


def rows(columns, found):
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)
    return sorted(repr([plain(v) for v in r]) for r in found)


@pytest.fixture(scope="module")
def con(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, data, name):
    got = plans.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    found = got.select(columns).collect()
    if name in plans.SQL:
        want = con.execute(f"select {', '.join(columns)} from ({plans.SQL[name]})").fetchall()
        assert rows(columns, found) == rows(columns, want)
    else:
        assert found


def test_verdicts_of_streams_with_holes_at_the_end(spark, tmp_path):
    """Lengths around seeds and spoilt versions, with up to two events lost at the end, or one inside."""
    kinds, events, user = ["signup", "error", "purchase", "view", "signup", "error", "click"], [], 0
    for length in [*range(1, 13), *range(18, 28)]:
        for lost in ([], [length], [length - 1, length], [length // 2 + 1]):
            for _ in range(2):
                at = user * 39700
                for v in range(1, length + 1):
                    at = (at // 397 + 1) * 397 if v in lost else at + 1 + ((at + 1) % 397 == 0)
                    events.append((at, user, kinds[(user // 8 + v) % 7] if v > 1 else "signup"))
                user += 1
    con = duckdb.connect()
    e = spark.createDataFrame(events, "event_id long, user_id long, event_type string").selectExpr("*", "0D as value", "'' as props", "timestamp_ntz '2024-01-01 00:00:00' as ts")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = plans.QUERIES["replay_verdicts"](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(got.columns)} from ({plans.SQL['replay_verdicts']})").fetchall()
    assert rows(got.columns, got.collect()) == rows(got.columns, want) and {w[2] for w in want} == {"ok", "replay-failed", "seed-divergence"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_training_data_operators():
    block = "import sys; sys.modules['foldline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q) and not any(k.startswith('op') for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", block], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": ROOT})
