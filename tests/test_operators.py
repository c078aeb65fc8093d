"""Named cases on literal tables, and laws by generated ones."""

from __future__ import annotations

import hashlib
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldline.functions import codec, expr, ids
from foldline.operators import catalog, fold, messaging, readmodels, routing, tables, workflows
from foldline.sources import scans

EVENTS = ("signup", "view", "click", "purchase", "error")


def plain_fold(events):
    edges, state = {(e.vertex, e.event): e for e in fold.USERS.edges}, ["New", 0, 0, 0]
    for e in events:
        edge = edges.get((state[0], e))
        if edge is None:
            state[3] += 1
            continue
        state[0] = edge.to
        state[1] += "purchases" in edge.adds
        state[2] += "errors" in edge.adds
    return tuple(state)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(EVENTS), min_size=1, max_size=30), min_size=1, max_size=5), st.integers(1, 12), st.integers(0, 20))
def test_fold_laws(spark, streams, run, cut):
    """Any run length gives the plain fold, and a fold on a seed gives the whole one."""
    rows = [(f"s-{i}", v + 1, e, 100 * i + v) for i, es in enumerate(streams) for v, e in enumerate(es)]
    log = spark.createDataFrame(rows, "stream_name string, stream_version long, event_type string, global_position long")
    pick = lambda df: {r["stream_name"]: (r["vertex"], r["purchases"], r["errors"], r["rejected"]) for r in df.collect()}
    want = {f"s-{i}": plain_fold(es) for i, es in enumerate(streams)}
    assert pick(fold.replay(log, fold.USERS, run=run)) == want
    seed = fold.replay(log.filter(F.col("stream_version") <= cut), fold.USERS).drop("last_position")
    assert pick(fold.replay(log, fold.USERS, seed, run=run)) == want


def test_machines_are_checked():
    with pytest.raises(ValueError):
        fold.Machine("A", ("A",), (), (fold.Edge("A", "x", "A"), fold.Edge("A", "x", "A")))
    with pytest.raises(ValueError):
        fold.Machine("A", ("A",), (), (fold.Edge("A", "x", "B"),))
    found = fold.Machine("A", ("A", "B"), (), (fold.Edge("A", "x", "A"), fold.Edge("B", "x", "A"))).warnings()
    assert ("unreachable-vertex", "B") in found and ("silent-edge", "A/x") in found and ("dead-edge", "B/x") in found


def test_version_gap(spark):
    log = spark.createDataFrame([("s", 1), ("s", 2), ("s", 4), ("s", 7), ("t", 1)], "stream_name string, stream_version long")
    assert [tuple(r) for r in fold.gaps(log).collect()] == [("s", 3, 4)]


def test_snapshot_replaced_backwards_by_another_shape(spark):
    rows = [("s", 1, 5, "a"), ("s", 2, 4, "a"), ("s", 3, 2, "b"), ("s", 4, 1, "b"), ("t", 1, 3, "a"), ("t", 2, 3, "a")]
    got = {r["stream_name"]: (r["version"], r["tag"], r["seq"]) for r in fold.snapshot_upsert(spark.createDataFrame(rows, "stream_name string, seq long, version long, tag string")).collect()}
    assert got == {"s": (2, "b", 3), "t": (3, "a", 2)}


OUTBOX = "outbox_id long, source string, message_key string, status string, attempts long, created_at timestamp_ntz, next_attempt_at timestamp_ntz"


def outbox(spark, rows):
    t = lambda n: f"2024-01-{n:02d}"
    df = spark.createDataFrame([(i, "s", k, st_, a, t(c), t(d)) for i, k, st_, a, c, d in rows], "outbox_id long, source string, message_key string, status string, attempts long, c string, d string")
    return df.select("outbox_id", "source", "message_key", "status", "attempts", F.col("c").cast("timestamp_ntz").alias("created_at"), F.col("d").cast("timestamp_ntz").alias("next_attempt_at"))


def test_head_of_line(spark):
    rows = [(1, "a", "failed", 1, 1, 20), (2, "a", "pending", 0, 2, 2), (3, "b", "pending", 0, 3, 3), (4, None, "pending", 0, 4, 4), (5, "b", "pending", 0, 5, 5), (6, "c", "sent", 1, 1, 1), (7, "c", "pending", 0, 6, 6)]
    now = F.lit("2024-01-10").cast("timestamp_ntz")
    claim = lambda policy: sorted(r["outbox_id"] for r in messaging.claim(outbox(spark, rows), now, policy).collect())
    assert claim("per-key") == [3, 4, 5, 7] and claim("stop-the-line") == [3, 4, 5, 7]
    assert claim("per-source") == [] and claim("best-effort") == [2, 3, 4, 5, 7]
    assert [r["outbox_id"] for r in messaging.claim(outbox(spark, rows), now, "best-effort", 2).collect()] == [2, 3]
    with pytest.raises(ValueError):
        claim("any")


def test_publish_mix(spark):
    rows = [(i, "a" if i < 5 else "b", "publishing", 1, i, i) for i in range(1, 8)]
    told = F.when(F.col("outbox_id") == 1, "ok").when(F.col("outbox_id") == 2, "rejected").when(F.col("outbox_id") == 3, F.lit(None).cast("string")).otherwise("ok")
    got = {r["outbox_id"]: r["result"] for r in messaging.publish(outbox(spark, rows), told, ["source", "message_key"]).collect()}
    assert got == {1: "ok", 2: "rejected", 3: "failed", 4: "skipped", 5: "ok", 6: "ok", 7: "ok"}


def test_recipients(spark):
    rows = [("e1", "a", "x"), ("e1", "a", "x"), ("e1", "b", "x"), ("e2", "a", "x"), ("e2", "a", "y"), *[("e3", str(i), "x") for i in range(3)]]
    got = {r["source_event"]: r["outcome"] for r in routing.select_recipients(spark.createDataFrame(rows, "source_event string, target string, command string"), 2).collect()}
    assert got == {"e1": "selected", "e2": "conflict", "e3": "overflow"}


def test_ids(spark):
    texts = ["", "a", "é", "日本", "x" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", ids.uuid5(F.col("t")).alias("u"), ids.seed_moved(F.col("t")).alias("m"), ids.fnv(F.col("t")).alias("f")).collect()
    for r in got:
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["t"])) and r["m"] == (not r["t"].isascii()) and r["f"] == ids.fnv1a64(r["t"].encode())
    assert ids.fnv1a64(b"query-model|order_id:text:req") == "784e511a19f74c58" and ids.fnv1a64(b"query-model|total:bigint:req") == "768a23d719dcb4d4"
    assert ids.legacy_seed("aé日") == bytes([97, 0xE9, 0x65E5 % 256])
    assert ids.canonical_json({"b": [1, 2.0, None, True], "a": {"é": "\n"}}) == '{"a":{"é":"\\n"},"b":[1,2,null,true]}'
    assert ids.preimage(["ab", "c"]) != ids.preimage(["a", "bc"]) and ids.fingerprint("g", ["x"]).startswith("g:")


def test_queue_names(spark):
    names = ["Orders", "a--b__c", "9lives", "", "___", "x" * 60, "jobs_dlq", "é" * 50]
    got = {r["n"]: r["q"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.queue_name(F.col("n")).alias("q")).collect()}
    assert (got["Orders"], got["a--b__c"], got["9lives"], got[""], got["___"]) == ("orders", "a_b_c", "q9lives", "q", "q")
    assert got["x" * 60] == "x" * 26 + "_" + ids.fnv1a64_points("x" * 60) and got["jobs_dlq"] == "jobs_dlq_" + ids.fnv1a64_points("jobs_dlq")
    assert all(len(q) <= 43 for q in got.values())


def test_type_ids(spark):
    digits = "0123456789abcdefghjkmnpqrstvwxyz"
    text = lambda u: "".join(digits[u.int >> 5 * (25 - k) & 31] for k in range(26))
    seven = uuid.UUID(int=(0x018F << 112) | (7 << 76) | (2 << 62) | 12345)
    four = uuid.uuid4()
    rows = [("user_" + text(seven), True), ("user_" + text(four), False), ("User_" + text(seven), False), ("user_" + text(seven).upper(), False), ("x_" + text(seven), False), ("user_", False), ("user_8" + text(seven)[1:], False)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("t", "ok", ids.type_id_ok(F.col("t"), "user").alias("got")).collect()
    assert all(r["got"] == r["ok"] for r in got), got


def test_expressions_are_checked():
    scope = expr.Scope({"reg": {"n": "Natural", "i": "Int", "both": "Text", "opt": "Text?"}, "cmd": {"both": "Text", "e": "Enum:x"}})
    bad = [
        expr.Op("+", expr.Ref("i"), expr.Ref("i")), expr.Op("==", expr.Ref("n"), expr.Ref("i")), expr.Ref("both"), expr.Ref("none"), expr.Ref("reg.opt"),
        expr.Op("<", expr.Ref("e"), expr.Lit("a", "Enum:x")), expr.Op("and", expr.Ref("n"), expr.Lit(True, "Bool")),
    ]
    for e in bad:
        with pytest.raises(expr.TypeMismatch):
            expr.typed(e, scope)
    with pytest.raises(expr.TypeMismatch):
        expr.rule("r", ("a", "b"), {"a": 1}, F.lit("a"))
    with pytest.raises(expr.TypeMismatch):
        expr.write("n", expr.Op("and", expr.Lit(True, "Bool"), expr.Lit(True, "Bool")), scope)


def test_natural_difference(spark):
    scope = expr.Scope({"reg": {"a": "Natural", "b": "Natural"}}, {"reg": "reg"}, saturate=True)
    df = spark.createDataFrame([(5, 3), (3, 5)], "a long, b long").select(F.struct("a", "b").alias("reg"))
    e = expr.Op("-", expr.Ref("a"), expr.Ref("b"))
    assert [int(r[0]) for r in df.select(expr.compiled(e, scope)).collect()] == [2, 0]
    strict = expr.Scope(scope.roots, scope.columns)
    with pytest.raises(Exception, match="below zero"):
        df.select(expr.compiled(e, strict)).collect()


def test_codec_declarations():
    up = lambda c: c
    for bad in [(0, ("a",), {}), (1, ("a", "a"), {}), (2, ("a",), {}), (2, ("a",), {1: up, 2: up})]:
        with pytest.raises(ValueError):
            codec.Codec(*bad)


def test_codec_encode(spark):
    made = codec.Codec(2, ("a",), {1: lambda c: c})
    df = spark.createDataFrame([("a", None), ("a", '{"schemaVersion": 9, "x": "1"}'), ("b", "{}"), ("a", "[1]")], "t string, m string")
    meta, error = made.encode(F.col("t"), F.col("m"))
    assert [tuple(r) for r in df.select(meta, error).collect()] == [('{"schemaVersion":"2"}', None), ('{"x":"1","schemaVersion":"2"}', None), (None, "unknown-type"), (None, "metadata-not-object")]


def test_kafka_round_trip(spark):
    events = spark.createDataFrame([("topic", "k", "body", "src", "type", "2", "application/json", "m1", None)], "destination string, key string, payload string, source string, event_type string, schema_version string, content_type string, message_id string, traceparent string")
    sent = codec.kafka_encode(events).collect()[0]
    heads = {h["name"]: h["value"] for h in sent["headers"]}
    assert bytes(sent["value"]) == b"body" and "traceparent" not in heads and heads["x-message-id"] == "m1"
    record = spark.createDataFrame([("topic", 0, 1, "k", heads)], "topic string, partition int, offset long, key string, headers map<string,string>").withColumn("received_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = codec.kafka_decode(record).collect()[0]
    assert got["error"] is None and got["schema_version"] == 2 and str(got["occurred_at"]).startswith("2024-01-01")


def test_generations_swap(spark, tmp_path):
    g = tables.Generations(spark, str(tmp_path))
    with pytest.raises(ValueError):
        g.read("t")
    g.write("a", t=spark.range(3))
    assert g.promote("a", 0) == 1 and g.read("t").count() == 3
    g.write("b", t=spark.range(5))
    assert g.read("t").count() == 3  # written, not yet in force
    with pytest.raises(ValueError):
        g.promote("b", 0)
    assert g.promote("b", 1) == 2 and g.read("t").count() == 5


def test_catalog_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e")], "name string, depends_on string")
    assert {r["name"] for r in catalog.cycles(edges).collect()} == {"a", "b", "c", "e"}


def test_fences_and_guards(spark):
    rows = spark.createDataFrame([(s,) for s in readmodels.AVAILABILITY], "status string")
    reads, writes = readmodels.availability(F.col("status"))
    assert {r["status"]: (r["r"], r["w"]) for r in rows.select("status", reads.alias("r"), writes.alias("w")).collect()} == readmodels.AVAILABILITY
    floors = readmodels.group_floor(
        spark.createDataFrame([("g", ["a", "b"]), ("h", ["a", "c"]), ("i", [])], "grp string, names array<string>"),
        spark.createDataFrame([("a", 0, 5), ("a", 1, 3), ("b", 0, 9)], "name string, member int, position long"),
    )
    assert {r["grp"]: r["floor"] for r in floors.collect()} == {"g": 3, "h": None, "i": None}


def test_workflow_journal(spark):
    writes = spark.createDataFrame([("w", 1, "a", None), ("w", 2, "a", None), ("w", 3, "end", "failed"), ("w", 4, "b", None), ("w", 5, "a", None), ("w", 6, "end", "failed"), ("w", 7, "x", "completed")], "workflow_id string, seq long, step_name string, marker string")
    got = {r["seq"]: r["outcome"] for r in workflows.append(writes).collect()}
    assert got == {1: "appended", 2: "already-present", 3: "appended", 4: "refused", 5: "already-present", 6: "already-present", 7: "refused"}


def test_scans(spark):
    log = spark.createDataFrame([("a-1", 1, 3, "a"), ("a-1", 2, 5, "a"), ("b-x-1", 1, 4, "b")], "stream_name string, stream_version long, global_position long, category string")
    assert [r["global_position"] for r in scans.page(log, 3, 5).collect()] == [4, 5]
    assert [r["global_position"] for r in scans.page_back(log, 5, 1).collect()] == [4]
    assert scans.clashes(scans.merge(log, log.limit(1))).count() == 1
    assert {r[0] for r in log.select(scans.category(F.col("stream_name"))).collect()} == {"a", "b"}
    assert {r["b"] for r in log.select(scans.bucket_of(F.col("stream_name"), 4).alias("b")).collect()} <= {0, 1, 2, 3}


def test_replay_digest(spark):
    got = spark.createDataFrame([('{"b": 1, "a": 2}',), ('{"a":2,"b":1}',)], "j string").select(ids.replay_digest(F.col("j")).alias("d")).collect()
    assert got[0]["d"] == got[1]["d"] == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()


def test_numbers_are_consecutive_in_order(spark):
    from foldline.sources.numbering import numbered

    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    got = numbered(spark.createDataFrame(rows, "a long, b long").repartition(5), "n", "a", "b", first=10).orderBy("n").collect()
    assert [(r["a"], r["b"], r["n"]) for r in got] == [(a, b, 10 + i) for i, (a, b) in enumerate(sorted(rows))]


def test_adapters_write_in_their_order(spark):
    log = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "global_position long, v string")
    one = lambda e: e.select(F.lit("k").alias("key"), F.concat(F.lit("1"), "v").alias("value"), "global_position")
    two = lambda e: e.select(F.lit("k").alias("key"), F.concat(F.lit("2"), "v").alias("value"), "global_position")
    old = spark.createDataFrame([("k", "old"), ("root", "kept")], "key string, value string")
    run = lambda adapters, policy: {r["key"]: r["value"] for r in readmodels.rebuild(old, log, 5, adapters, policy).collect()}
    assert run([one, two], "clear") == {"k": "2y"} and run([two, one], "clear") == {"k": "1y"}
    assert run([one, two], "preserve") == {"k": "2y", "root": "kept"}
