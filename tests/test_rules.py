"""Rules of single operators on small tables made by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from foldline.functions import codec, ids
from foldline.operators import catalog, fold, inverse, messaging, readmodels, routing, tables, workflows
from foldline.sources import scans
from foldline.streaming import subscriptions


def test_hashes_in_the_engine(spark):
    rnd = random.Random(4)
    texts = ["", "a", "\0", "é日\U0001f600", *["".join(rnd.choice("abé日\U0001f600 _") for _ in range(rnd.randint(0, 60))) for _ in range(200)]]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ids.fnv(F.col("t")).alias("a"), ids.fnv_points(F.col("t")).alias("b")).collect()
    assert all((r["a"], r["b"]) == (ids.fnv1a64(r["t"].encode()), ids.fnv1a64_points(r["t"])) for r in got)


def test_long_causes_both_ways(spark):
    rows = [(i, i - 1 if i else None) for i in range(150)] + [(1000, 75), (1001, 1000), (5000, 4999), (7000, 7001), (7001, 7000)]
    log = spark.createDataFrame(rows, "event_id long, causation_id long")
    got = {(r["event_id"], r["root"]): r["depth"] for r in routing.causation(log, log.filter("event_id in (20, 5000, 7000)")).collect()}
    want = {(i, 20): i - 20 for i in range(150)} | {(1000, 20): 56, (1001, 20): 57, (5000, 5000): 0, (7000, 7000): 0}
    assert {k: d for k, d in got.items() if k[0] != 7001} == want and abs(got[7001, 7000]) == 1


def test_cycles_against_brute_force(spark):
    rnd = random.Random(8)
    for _ in range(3):
        edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)}
        reach = {a: {b for x, b in edges if x == a} for a in range(40)}
        while any(not reach[b] <= reach[a] for a in reach for b in list(reach[a])):
            for a in reach:
                reach[a] |= set().union(*(reach[b] for b in reach[a]))
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
        assert {r["name"]: r["cycle"] for r in catalog.cycles(spark.createDataFrame(sorted(edges), "name long, depends_on long")).collect()} == want
    assert catalog.cycles(spark.createDataFrame([], "name long, depends_on long")).count() == 0


def test_long_chains_aren_t_cut(spark):
    kinds = tuple(f"k{i}" for i in range(1500))
    log = spark.createDataFrame([("s", i + 1, k) for i, k in enumerate(kinds)], "stream_name string, stream_version long, event_type string")
    assert inverse.replay(log, "A", (inverse.Chain("A", "go", "B", kinds),)).select("vertex", "outcome").first() == ("B", "ok")


def test_one_of_two_promotions_fails(spark, tmp_path):
    one, two = (tables.Generations(spark, str(tmp_path / "g")) for _ in range(2))
    assert one.serving() == (0, None) and one.promote("first", 0) == 1
    with pytest.raises(ValueError, match="serving epoch is 1"):
        two.promote("other", 0)
    # Both have seen epoch 1; a file system lets one of them make the next.
    two.serving = lambda: (1, "first")
    assert one.promote("second", 1) == 2
    with pytest.raises(ValueError):
        two.promote("third", 1)
    assert one.serving() == (2, "second")
    (tmp_path / "g/pointer" / f"{3:020d}").write_text("tor")  # a writer died before the name was whole
    assert one.serving() == (3, "second") and one.promote("fourth", 3) == 4 and one.serving() == (4, "fourth")


def test_late_events_and_gaps_of_a_live_stream(spark, tmp_path):
    make = lambda name, *rows: spark.createDataFrame(rows, "stream_name string, stream_version long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    key, out = "spark.sql.streaming.stateStore.providerClass", {}
    before = spark.conf.get(key, None)
    subscriptions.use_rocks(spark)

    def run():
        stream = subscriptions.folded(spark.readStream.schema("stream_name string, stream_version long, event_type string").parquet(f"{tmp_path}/in/*"), fold.USERS)
        take = lambda b, _: out.update({r["stream_name"]: (r["vertex"], r["version"], r["gap"]) for r in b.collect()})
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)

    make("1", ("a", 1, "signup"), ("b", 1, "signup"), ("b", 3, "purchase"))
    run()
    make("2", ("a", 1, "signup"), ("a", 2, "purchase"), ("b", 2, "view"))
    run()
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert out == {"a": ("Customer", 2, 0), "b": ("Active", 1, 2)}


def test_ways_of_hydration(spark):
    kinds = ["signup", "view", "purchase", "view", "error", "purchase"]
    log = [(s, v, k, v, i) for i, s in enumerate("abcd") for v, k in enumerate(kinds, 1)]
    holes = {("b", 2), ("c", 5), ("d", 2), ("d", 5)}
    rows = spark.createDataFrame([(s, v, k, v, i) for s, v, k, _, i in log if (s, v) not in holes], "stream_name string, stream_version long, event_type string, global_position long, event_id long")
    seed = spark.createDataFrame([(s, 3, "Customer", 1, 0, 0) for s in "abcd"], "stream_name string, version long, vertex string, purchases long, errors long, rejected long")
    got = {r["stream_name"]: (r["way"], r["purchases"], r["errors"]) for r in fold.hydrate(rows, fold.USERS, seed).collect()}
    # a and b have whole tails; c has a hole behind its snapshot and so in the stream; d has both.
    assert got == {"a": ("seeded", 2, 1), "b": ("seeded", 2, 1), "c": ("failed", None, None), "d": ("failed", None, None)}
    ahead = seed.withColumn("version", F.lit(9).cast("long"))
    assert {r["stream_name"]: r["way"] for r in fold.hydrate(rows, fold.USERS, ahead).collect()} == dict.fromkeys("abcd", "failed") | {"a": "whole"}
    verdicts = {r["stream_name"]: r["verdict"] for r in fold.audit(rows, fold.USERS, seed.withColumn("errors", F.lit(4).cast("long"))).collect()}
    assert verdicts == {"a": "seed-divergence", "b": "replay-failed", "c": "replay-failed", "d": "replay-failed"}


def test_chunks_of_a_merge(spark):
    places = {"a": [1, 4, 7, 8, 9], "b": [2, 3], "c": [5, 6, 20, 30]}
    log = spark.createDataFrame([(p, c) for c, ps in places.items() for p in ps], "global_position long, category string")
    cursor, out = dict.fromkeys(places, 0), []
    for _ in range(20):
        cursors = spark.createDataFrame(list(cursor.items()), "category string, cursor long")
        chunk = scans.merge_chunk(log, "category", cursors, 2).collect()
        if not chunk:
            break
        assert len(chunk) <= 2
        for r in chunk:
            out.append(r["global_position"])
            cursor[r["category"]] = r["global_position"]
    assert out == sorted(p for ps in places.values() for p in ps)
    wrong = spark.createDataFrame([(3, "a"), (3, "b"), (9, "a")], "global_position long, category string")
    assert sorted(map(tuple, scans.chunk_error(wrong, 3).collect())) == [("duplicate", 3), ("regression", 3), ("regression", 3)]


def test_keys_and_ceilings(spark):
    rows = spark.createDataFrame([("", None, None, "t", 0, 1), (" ", "s", 5, "t", 0, None), ("m", None, 7, "t", 1, 2)], "mid string, sid string, pos long, topic string, part int, at long")
    at = [F.col(c) for c in ("mid", "sid", "pos", "topic", "part", "at")]
    key = lambda policy, *more: [r[0] for r in rows.select(messaging.dedupe_key(policy, *at, *more)).collect()]
    assert key("message-id") == [None, " ", "m"] and key("source-event") == [None, "s", "7"] and key("position") == ["t:0:1", None, "t:1:2"]
    assert key("custom", F.when(F.col("part") == 0, "").otherwise("own")) == [None, None, "own"]
    with pytest.raises(ValueError):
        key("custom")
    stored = spark.createDataFrame([(1, "k", "failed", 2)], "source long, dedupe_key string, status string, attempts int")
    new = spark.createDataFrame([(1, "k", 1)], "source long, dedupe_key string, seq long")
    assert [messaging.plan_batch(new, stored, c).first()["plan"] for c in (None, 2, 3)] == ["previously-failed", "previously-failed", "work"]


def test_registry_and_awakeables(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    writes = [("a", 1, day(1), "register", 1, "x"), ("a", 2, day(2), "abandon", 2, "y"), ("a", 3, day(3), "register", 9, "z"), ("b", 4, day(4), "rebuild", 1, "x"), ("b", 5, day(5), "finish", 2, "x"), ("b", 6, day(6), "rebuild", 3, "w")]
    got = readmodels.registry(spark.createDataFrame(writes, "name string, seq long, at timestamp_ntz, action string, version int, shape string")).collect()
    assert {r["name"]: tuple(r)[1:] for r in got} == {"a": ("abandoned", 2, "y", day(1)), "b": ("rebuilding", 3, "w", day(5))}
    a = spark.createDataFrame([(1, 10, "pending"), (2, 10, "completed"), (3, 20, "pending"), (4, 30, "pending")], "awakeable_id long, owner long, status string")
    i = spark.createDataFrame([(10, "suspended", 4), (20, "failed", 1), (30, "suspended", 2)], "workflow_id long, status string, generation int")
    rows, owners = workflows.cancel_awakeables(a, spark.createDataFrame([(1,), (1,), (2,), (3,), (9,)], "awakeable_id long"), i)
    assert {r["awakeable_id"]: (r["status"], r["accepted"]) for r in rows.collect()} == {1: ("cancelled", True), 2: ("completed", False), 3: ("cancelled", True), 4: ("pending", False)}
    assert {tuple(r) for r in owners.collect()} == {(10, "running", 4), (20, "failed", 1), (30, "suspended", 2)}


def test_rebuild_begins_only_with_its_slice(spark):
    groups = spark.createDataFrame([(1, "live", "a", True), (2, "live", "b", True), (3, "failed", "a", True), (4, "cutover", "a", True), (5, "live", "a", False)], "grp long, status string, slice string, checkpoints_ok boolean")
    want = spark.createDataFrame([(g, "a") for g in range(1, 7)], "grp long, want_slice string")
    got = {r["grp"]: r["outcome"] for r in readmodels.begin_rebuild(groups, want).collect()}
    assert got == {1: "begun", 2: "slice-drift", 3: "begun", 4: "not-live", 5: "missing-checkpoint", 6: "unregistered"}


def test_rows_made_and_changed_as_one_by_one(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(12), p, rnd.random() < 0.2, rnd.choice("abc"), p) for p in range(120)]
    want = {}
    for key, p, made, status, value in rows:
        if made:
            want[key] = [value, status, p]
        elif key in want:
            want[key][1:] = [status, p]
    got = readmodels.summary(spark.createDataFrame(rows, "k long, position long, made boolean, status string, value long"), "k")
    assert {r["k"]: [r["value"], r["status"], r["last_seen"]] for r in got.collect()} == want


def test_promotion_is_prepared_or_told_why(spark):
    runs = spark.createDataFrame([(1, True, 2, "r", True), (2, True, 1, "r", True), (3, True, 9, None, True), (4, True, 9, "r", True), (5, True, 9, "r", True)], "run long, ready boolean, dedup_limit int, serving string, checkpoints_ok boolean")
    staged = spark.createDataFrame([(1, "s", 5, "p", 50), (1, "s", 7, "p", 70), (1, "t", 1, "p", 10), (2, "s", 1, "p", 1), (2, "s", 2, "p", 2)], "run long, subscription string, position long, projection string, event_id long")
    left = readmodels.pruned(staged, spark.createDataFrame([(1, "s", 5)], "run long, subscription string, position long"))
    declared = spark.createDataFrame([(r, s, "x") for r in range(1, 6) for s in ("serving", "candidate")], "run long, side string, target string")
    made = [(r, s, "x", "serving" if s == "serving" else "staging", True, True) for r in range(1, 6) for s in ("serving", "candidate")] + [(4, "candidate", "y", "staging", True, True)]
    generations = spark.createDataFrame(made, "run long, side string, target string, lifecycle string, identity_ok boolean, shape_ok boolean")
    out = readmodels.prepare(runs, left, declared, generations, spark.createDataFrame([(5, True), (5, False)], "run long, passed boolean"))
    assert {r["run"]: (r["staged"], r["outcome"]) for r in out.collect()} == {1: (2, "prepared"), 2: (2, "dedup-limit"), 3: (0, "no-serving-revision"), 4: (0, "targets-differ"), 5: (0, "verification-failed")}
    applied = spark.createDataFrame([("p", 70), ("p", 1)], "projection string, event_id long")
    assert sorted(r["event_id"] for r in readmodels.installed(applied, left, out).collect()) == [1, 10, 70]


def test_children_end_once(spark):
    children = spark.createDataFrame([(1, 10, "s1", "running", None), (2, 10, "s2", "completed", "old"), (3, 11, "s3", "running", None), (4, 10, "s4", "failed", None)], "child_id long, parent_id long, await_step string, status string, result string")
    ends = spark.createDataFrame([(1, 2, "failed", "no"), (1, 1, "completed", "yes"), (2, 1, "completed", "new"), (3, 1, "cancelled", None), (4, 1, "completed", "late")], "child_id long, seq long, status string, result string")
    parents = spark.createDataFrame([(10, "suspended"), (11, "completed")], "workflow_id long, status string")
    state, told = workflows.end_children(children, ends, parents)
    assert {r["child_id"]: (r["status"], r["result"]) for r in state.collect()} == {1: ("completed", "yes"), 2: ("completed", "old"), 3: ("cancelled", None), 4: ("failed", None)}
    assert sorted((r["step_name"], r["kind"], r["result"]) for r in told.collect()) == [("s1", "completed", "yes"), ("s2", "completed", "old")]


def test_shards_are_claimed_one_by_one_and_shed(spark):
    now, soon, past = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 1)
    rows = [("few", b, "a" if b == 0 else "b" if b < 3 else None, soon) for b in range(6)] + [("many", b, "a" if b < 4 else "b", soon) for b in range(5)] + [("alone", b, "a" if b < 4 else "b", past) for b in range(5)]
    shards = spark.createDataFrame(rows, "subscription string, bucket int, owner string, lease_expires_at timestamp_ntz")
    got = {(r["subscription"], r["bucket"]): r["owner"] for r in workflows.shard_pass(shards, "a", F.lit(now).cast("timestamp_ntz")).collect()}
    assert [got["few", b] for b in range(6)] == ["a", "b", "b", "a", None, None]
    assert [got["many", b] for b in range(5)] == ["a", "a", "a", None, "b"]
    assert [got["alone", b] for b in range(5)] == ["a"] * 5


def test_bindings(spark):
    order, status = codec.Structural({"id": ("orderId", "bigint"), "note": ("note", "string")}), codec.Nominal({"open": "O", "done": "D"})
    wires = spark.createDataFrame([('{"orderId":7,"note":"x"}', "O"), ('{"orderId":"no"}', "D"), ("[", "?"), (None, None), ('{"note":null}', "O")], "w string, s string")
    got = wires.select(order.decode(F.col("w")).alias("o"), status.decode(F.col("s")).alias("s")).collect()
    assert [r["o"] and tuple(r["o"]) for r in got] == [(7, "x"), None, None, None, (None, None)] and [r["s"] for r in got] == ["open", "done", None, None, "open"]
    with pytest.raises(ValueError):
        codec.Nominal({"a": "x", "b": "x"})
