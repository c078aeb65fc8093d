"""Routing, workflows, ids, expressions, codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, expr, ids
from ..operators import routing, workflows
from ..sources import lift
from ..sources.lift import table, with_
from .registry import query

PREFIX = "app"


def uuid_sql(seed: str) -> str:
    h = f"sha1(unhex('{ids.URL_NAMESPACE}') || encode({seed}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ('89ab')[1 + (position(h[17] IN '0123456789abcdef') - 1) % 4] || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


def _field(x: str) -> str:
    return f"octet_length(encode({x})) || ':' || {x}"


# Routers.


@query("SELECT o_orderkey AS source_event, s_suppkey AS target, s_nationkey AS region FROM (SELECT o_orderkey, o_custkey % 25 AS region FROM orders WHERE o_orderpriority = '1-URGENT') JOIN supplier ON s_nationkey = region AND s_acctbal > 0")
def router_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """input x row under ``row.region == input.region && row.balance > 0``, through the typed expressions."""
    scope = expr.Scope({"input": {"region": "Int"}, "row": {"region": "Int", "balance": "Integer"}}, {"input": "i", "row": "r"})
    keep = expr.guard(expr.Op("and", expr.Op("==", expr.Ref("row.region"), expr.Ref("input.region")), expr.Op(">", expr.Ref("row.balance"), expr.Lit(0, "Integer"))), scope)
    i = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", (F.col("o_custkey") % 25).alias("region")).alias("i")
    r = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("region"), F.ceil("s_acctbal").alias("balance")).alias("r")
    return i.join(r, keep).select(F.col("o_orderkey").alias("source_event"), F.col("s_suppkey").alias("target"), F.col("r.region").alias("region"))


_CANDIDATES = "SELECT l_orderkey AS source_event, 's-' || l_suppkey % 12 AS target, l_returnflag AS command FROM lineitem"


@query(f"WITH c AS (SELECT DISTINCT * FROM ({_CANDIDATES})), p AS (SELECT source_event, target, count(*) AS n, min(command) AS command FROM c GROUP BY ALL), w AS (SELECT source_event, max(n) > 1 AS conflict, count(*) AS targets FROM p GROUP BY 1) SELECT source_event, target, command, targets, CASE WHEN conflict THEN 'conflict' WHEN targets > 4 THEN 'overflow' ELSE 'selected' END AS outcome FROM p JOIN w USING (source_event)")
def router_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_event"), F.concat(F.lit("s-"), (F.col("l_suppkey") % 12).cast("string")).alias("target"), F.col("l_returnflag").alias("command"))
    return routing.select_recipients(rows, 4)


_COMMANDS = "SELECT 'e' || o_custkey AS source_event, 't-' || o_orderkey % 3 AS target, o_orderkey AS idx, 'c' || o_custkey % 7 AS correlation FROM orders"


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(text("e", c).alias("source_event"), text("t-", k % 3).alias("target"), k.alias("idx"), text("c", c % 7).alias("correlation"))


@query(f"SELECT source_event, target, idx, (row_number() OVER (PARTITION BY source_event, target ORDER BY idx) - 1)::INT AS occurrence FROM ({_COMMANDS})")
def router_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return routing.occurrences(_commands(spark, sf)).select("source_event", "target", "idx", "occurrence")


_ROUTER_SEED = " || ".join([_field("'app'"), _field("'router'"), _field("'orders'"), _field("correlation"), _field("source_event"), _field("target"), _field("occurrence::VARCHAR")])


@query(f"WITH n AS (SELECT *, (row_number() OVER (PARTITION BY source_event, target ORDER BY idx) - 1)::INT AS occurrence FROM ({_COMMANDS})) SELECT {uuid_sql(_ROUTER_SEED)} AS command_id, idx, CASE WHEN occurrence = 0 AND target = 't-1' THEN 'duplicate' ELSE 'appended' END AS outcome FROM n")
def router_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = _commands(spark, sf)
    done = routing.dispatch(rows, spark.createDataFrame([], "command_id string"), PREFIX, "orders").filter("target = 't-1' and occurrence = 0").select("command_id")
    return routing.dispatch(rows, done, PREFIX, "orders").select("command_id", "idx", "outcome")


_MANAGER = "'app:process-manager:billing:' || correlation || ':' || source_event || ':' || idx"


@query(f"WITH e AS (SELECT 'e' || event_id AS source_event, 'u' || user_id AS correlation, event_type FROM events WHERE event_type IN ('purchase', 'error')), f AS (SELECT source_event, correlation, -1 AS idx, '' AS command FROM e UNION ALL SELECT source_event, correlation, 0, 'notify' FROM e UNION ALL SELECT source_event, correlation, 1, 'invoice' FROM e WHERE event_type = 'purchase') SELECT source_event, idx, command, {uuid_sql(_MANAGER)} AS command_id FROM f")
def pm_fanout(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type in ('purchase', 'error')")
    e = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_event"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("correlation"), "event_type")
    commands = F.when(F.col("event_type") == "purchase", F.array(F.lit("notify"), F.lit("invoice"))).otherwise(F.array(F.lit("notify")))
    return routing.fan_out(e, PREFIX, "billing", commands).select("source_event", "idx", F.coalesce("command", F.lit("")).alias("command"), "command_id")


@query(f"""WITH e AS (SELECT event_id, 'e' || event_id AS source_event, 'u' || user_id AS correlation, event_type FROM events WHERE event_type IN ('purchase', 'error')),
f AS (SELECT event_id, source_event, correlation, 'state' AS kind, -1 AS idx, '' AS command FROM e UNION ALL SELECT event_id, source_event, correlation, 'command', 0, 'notify' FROM e UNION ALL SELECT event_id, source_event, correlation, 'command', 1, 'invoice' FROM e WHERE event_type = 'purchase'),
i AS (SELECT *, {_MANAGER} AS seed FROM f)
SELECT source_event, kind, idx, command, {uuid_sql("seed")} AS command_id, CASE WHEN event_id % 3 = 0 AND idx < 1 THEN 'duplicate' ELSE 'appended' END AS outcome FROM i
UNION ALL SELECT source_event, 'timer', 0, 'remind', '', 'scheduled' FROM e WHERE event_type = 'purchase' AND event_id % 3 <> 0""")
def pm_run(spark: SparkSession, sf: str) -> DataFrame:
    """A manager over events of which every third is a redelivery that had got as far as its first command."""
    e = table(spark, sf, "events").filter("event_type in ('purchase', 'error')")
    e = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("source_event"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("correlation"), "event_type", "event_id")
    paid = F.col("event_type") == "purchase"
    commands = F.when(paid, F.array(F.lit("notify"), F.lit("invoice"))).otherwise(F.array(F.lit("notify")))
    timers = F.when(paid, F.array(F.lit("remind"))).otherwise(F.array().cast("array<string>"))
    done = routing.fan_out(e.filter("event_id % 3 = 0"), PREFIX, "billing", commands).filter("idx < 1").select("command_id")
    out = routing.manage(e, PREFIX, "billing", commands, timers, done)
    return out.select("source_event", "kind", "idx", F.coalesce("command", F.lit("")).alias("command"), F.coalesce("command_id", F.lit("")).alias("command_id"), "outcome")


@query("SELECT e.error, coalesce(s.store, '') AS store, CASE WHEN e.error IN ('rejected', 'ambiguous') THEN 'rejection' WHEN e.carries AND s.transient THEN 'transient' ELSE 'systemic' END AS kind FROM (VALUES ('store-failed', true), ('retry-exhausted', true), ('conflict-fixpoint', true), ('decode-failed', false), ('replay-failed', false), ('gap', false), ('encode-failed', false), ('rejected', false), ('ambiguous', false)) e(error, carries) JOIN (VALUES (NULL, false), ('connection-lost', true), ('pool-timeout', true), ('connection-error', true), ('wrong-expected-version', true), ('stream-already-exists', true), ('history-retention', true), ('transaction-failure', true), ('empty-batch', false), ('stream-not-found', false), ('reserved-name', false), ('duplicate-event', false), ('server-error', false)) s(store, transient) ON true")
def failure_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Every error with every error of the store under it."""
    errors = spark.createDataFrame([(x,) for x in ("store-failed", "retry-exhausted", "conflict-fixpoint", "decode-failed", "replay-failed", "gap", "encode-failed", "rejected", "ambiguous")], "error string")
    stores = spark.createDataFrame([(x,) for x in (None, *routing.TRANSIENT_STORE, "empty-batch", "stream-not-found", "reserved-name", "duplicate-event", "server-error")], "store string")
    both = errors.crossJoin(F.broadcast(stores))  # nine by thirteen names
    return both.select("error", F.coalesce("store", F.lit("")).alias("store"), routing.failure_kind(F.col("error"), F.col("store")).alias("kind"))


@query("WITH f AS (SELECT l_orderkey AS e, CASE WHEN l_quantity > 49 THEN 'systemic' WHEN l_quantity > 45 THEN 'transient' WHEN l_quantity > 20 THEN 'rejection' END AS k FROM lineitem) SELECT e AS source_event, CASE WHEN bool_or(k = 'systemic') THEN 'halt' WHEN bool_or(k = 'transient') THEN 'retry' WHEN bool_or(k = 'rejection') THEN 'ok-dead-lettered' ELSE 'ok' END AS decision FROM f GROUP BY 1")
def ack_decision(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_event"), F.when(q > 49, "systemic").when(q > 45, "transient").when(q > 20, "rejection").alias("kind"))
    return routing.ack(rows, "dead-letter")


@query("SELECT o_orderkey AS letter_id, CASE WHEN event_id IS NULL OR o_orderkey % 10 = 0 THEN 'source-missing' WHEN o_orderkey % 3 = 0 THEN 'duplicate' ELSE 'fresh' END AS fate FROM orders LEFT JOIN events ON event_id = o_orderkey WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC")
def dead_letter_replay(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    letters = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(k.alias("letter_id"), k.alias("event_id"), F.when(k % 10 == 0, 0).otherwise(k + 1).alias("position"))
    log = lift.event_log(spark, sf).select("event_id", "global_position")
    return routing.replay_dead_letters(letters, log, log.filter("event_id % 3 = 0")).select("letter_id", "fate").orderBy(F.desc("letter_id"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey AND event_type = 'view')")
def dispatch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    queued = table(spark, sf, "events").filter("event_type = 'view'").select(F.col("event_id").alias("o_orderkey"))
    return routing.undispatched(table(spark, sf, "orders").select("o_orderkey"), done, queued, "o_orderkey")


_CAUSE = "SELECT event_id, CASE WHEN event_id >= 40 THEN event_id // 3 END AS causation_id FROM events"


@query(f"WITH RECURSIVE l AS ({_CAUSE}), s AS (SELECT event_id FROM l WHERE event_id IN (15, 20, 33, 500, 999)), r AS (SELECT event_id, event_id AS root, 0 AS depth FROM s UNION ALL SELECT l.event_id, r.root, r.depth + 1 FROM l JOIN r ON l.causation_id = r.event_id), u AS (SELECT l.causation_id AS event_id, event_id AS root, -1 AS depth FROM l JOIN s USING (event_id) WHERE causation_id IS NOT NULL UNION ALL SELECT l.causation_id, u.root, u.depth - 1 FROM u JOIN l ON l.event_id = u.event_id WHERE l.causation_id IS NOT NULL) SELECT event_id, root, depth::BIGINT AS depth FROM r UNION ALL SELECT event_id, root, depth FROM u")
def causation_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What five events led to, and what led to them."""
    log = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") >= 40, F.floor(F.col("event_id") / 3)).alias("causation_id"))
    return routing.causation(log, log.filter(F.col("event_id").isin(15, 20, 33, 500, 999)))


# Workflows.


@query(with_("journal") + ", p AS (SELECT workflow_id, step_name, result FROM journal WHERE ordinal % 2 = 0) SELECT j.workflow_id, j.step_name, CASE WHEN p.result IS NOT NULL THEN 'replayed' WHEN j.step_name LIKE 'user%' THEN 'suspended' ELSE 'executed' END AS verdict, coalesce(p.result, -1) AS result FROM journal j LEFT JOIN p USING (workflow_id, step_name)")
def wf_step_replay(spark: SparkSession, sf: str) -> DataFrame:
    j = lift.journal(spark, sf)
    steps = j.select("workflow_id", "step_name", F.when(F.col("step_name").startswith("user"), "await").otherwise("step").alias("kind"))
    return workflows.plan(steps, j.filter("ordinal % 2 = 0").withColumnRenamed("ordinal", "seq")).select("workflow_id", "step_name", "verdict", F.coalesce("result", F.lit(-1)).alias("result"))


_MARKS = "SELECT conv_id AS workflow_id, (turn % 3)::INT AS generation, CASE (conv_id + turn) % 7 WHEN 0 THEN 'completed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'failed' END AS marker FROM conversations"


@query(f"WITH m AS ({_MARKS}), t AS (SELECT workflow_id, max(generation) AS generation FROM m GROUP BY 1) SELECT workflow_id, generation, CASE WHEN bool_or(marker = 'completed') THEN 'completed' WHEN bool_or(marker = 'cancelled') THEN 'cancelled' WHEN bool_or(marker = 'failed') THEN 'failed' ELSE 'running' END AS status FROM m JOIN t USING (workflow_id, generation) GROUP BY ALL")
def wf_status(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 7
    marks = table(spark, sf, "conversations").select(F.col("conv_id").alias("workflow_id"), (F.col("turn") % 3).cast("int").alias("generation"), F.when(k == 0, "completed").when(k == 1, "cancelled").when(k == 2, "failed").alias("marker"))
    return workflows.status(marks)


@query("""WITH w AS (SELECT user_id AS workflow_id, (event_id // 3) % 2 AS generation, event_id AS seq, 's' || (event_id * 31) % 20 || CASE WHEN event_id % 9 = 0 THEN ':m' ELSE '' END AS step_name, CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_type IN ('view', 'click') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'cancelled' END END AS marker FROM events),
e AS (SELECT workflow_id, generation, min(seq) AS end_seq, min_by(marker, seq) AS end_marker FROM w WHERE marker IS NOT NULL GROUP BY ALL), f AS (SELECT workflow_id, generation, step_name, min(seq) AS first FROM w GROUP BY ALL)
SELECT seq, CASE WHEN marker IS NOT NULL THEN CASE WHEN seq = end_seq THEN 'appended' WHEN marker = end_marker THEN 'already-present' ELSE 'refused' END WHEN coalesce(end_marker IN ('cancelled', 'failed') AND end_seq < first, false) THEN 'refused' WHEN seq = first THEN 'appended' ELSE 'already-present' END AS outcome FROM w LEFT JOIN e USING (workflow_id, generation) JOIN f USING (workflow_id, generation, step_name)""")
def wf_append(spark: SparkSession, sf: str) -> DataFrame:
    k, marked = F.col("event_id"), F.col("event_id") % 9 == 0
    kind = F.when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    step = F.concat(F.lit("s"), ((k * 31) % 20).cast("string"), F.when(marked, ":m").otherwise(""))
    return workflows.append(table(spark, sf, "events").select(F.col("user_id").alias("workflow_id"), (F.floor(k / 3) % 2).alias("generation"), k.alias("seq"), step.alias("step_name"), F.when(marked, kind).alias("marker"))).select("seq", "outcome")


_INST = "SELECT o_orderkey AS workflow_id, CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'cancelled' END WHEN 'O' THEN 'running' ELSE 'suspended' END AS status, o_orderkey % 8 AS attempts, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS wake_after, o_orderdate + to_days((o_orderkey % 5)::INT * 90) AS lease_expires_at, o_orderdate + to_days((o_orderkey % 7)::INT * 60) AS next_attempt_at, o_orderdate AS completed_at FROM orders"


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    k, d, s = F.col("o_orderkey"), F.col("o_orderdate"), F.col("o_orderstatus")
    status = F.when(s == "F", F.when(k % 3 == 0, "completed").when(k % 3 == 1, "failed").otherwise("cancelled")).when(s == "O", "running").otherwise("suspended")
    return table(spark, sf, "orders").select(
        k.alias("workflow_id"), status.alias("status"), (k % 8).alias("attempts"), F.when(k % 4 != 0, d).alias("wake_after"),
        (d + F.make_dt_interval((k % 5 * 90).cast("int"))).alias("lease_expires_at"), (d + F.make_dt_interval((k % 7 * 60).cast("int"))).alias("next_attempt_at"), d.alias("completed_at"),
    )


def _now():
    return F.lit("1998-06-01").cast("timestamp_ntz")


@query(f"WITH i AS ({_INST}) SELECT workflow_id, status, least(power(2, attempts + 1), 64)::DOUBLE AS crash_delay FROM i WHERE status = 'running' OR (status = 'suspended' AND wake_after <= TIMESTAMP '1998-06-01')")
def wf_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return workflows.discover(_instances(spark, sf), _now()).select("workflow_id", "status", workflows.crash_delay(F.col("attempts")).alias("crash_delay"))


@query(f"WITH i AS ({_INST}) SELECT workflow_id, CASE WHEN status IN ('completed', 'failed', 'cancelled') OR (status = 'suspended' AND (wake_after IS NULL OR wake_after > TIMESTAMP '1998-06-01')) THEN 'unavailable' WHEN lease_expires_at > TIMESTAMP '1998-06-01' THEN 'lease-held' WHEN next_attempt_at > TIMESTAMP '1998-06-01' THEN 'paced' ELSE 'claimed' END AS claim FROM i")
def wf_claim(spark: SparkSession, sf: str) -> DataFrame:
    return workflows.claim(_instances(spark, sf), _now()).select("workflow_id", "claim")


@query(f"WITH i AS ({_INST}), c AS (SELECT workflow_id AS child_id, workflow_id // 4 AS parent_id FROM i WHERE workflow_id % 4 = 1) SELECT workflow_id, completed_at FROM i WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at <= TIMESTAMP '1997-06-01' AND NOT EXISTS (SELECT 1 FROM c JOIN i p ON p.workflow_id = c.parent_id WHERE c.child_id = i.workflow_id AND p.status NOT IN ('completed', 'failed', 'cancelled'))")
def wf_gc(spark: SparkSession, sf: str) -> DataFrame:
    i = _instances(spark, sf)
    children = i.filter("workflow_id % 4 = 1").select(F.col("workflow_id").alias("child_id"), F.floor(F.col("workflow_id") / 4).alias("parent_id"))
    return workflows.collectable(i, children, F.lit("1997-06-01").cast("timestamp_ntz")).select("workflow_id", "completed_at")


@query(f"WITH i AS ({_INST}) SELECT c.workflow_id // 4 AS parent_id, c.workflow_id AS child_id, CASE c.status WHEN 'completed' THEN 'result' WHEN 'failed' THEN 'failure' WHEN 'cancelled' THEN 'cancellation' ELSE 'pending' END AS gives FROM i c WHERE c.workflow_id % 4 = 1")
def children_join(spark: SparkSession, sf: str) -> DataFrame:
    i = _instances(spark, sf)
    children = i.filter("workflow_id % 4 = 1").select(F.col("workflow_id").alias("child_id"), F.floor(F.col("workflow_id") / 4).alias("parent_id"))
    return workflows.child_outcomes(children, i).select("parent_id", "child_id", "gives")


@query("""WITH w AS (SELECT user_id AS workflow_id, event_id AS seq, event_id % 6 AS generation, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'completed' ELSE 'running' END WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'suspended' END ELSE 'running' END AS status FROM events),
d AS (SELECT workflow_id, min(seq) AS done FROM w WHERE status IN ('completed', 'failed', 'cancelled') GROUP BY 1)
SELECT workflow_id, max(generation) AS generation, max_by(status, seq) AS status, coalesce(max(done), -1) AS completed_seq FROM w LEFT JOIN d USING (workflow_id) WHERE done IS NULL OR seq <= done GROUP BY 1""")
def wf_instance_upsert(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("event_id"), F.col("event_type")
    status = F.when((t == "purchase") & (k % 5 == 0), "completed").when((t == "error") & (k % 10 == 0), "failed").when(t == "error", "suspended").otherwise("running")
    out = workflows.upsert_instances(table(spark, sf, "events").select(F.col("user_id").alias("workflow_id"), k.alias("seq"), (k % 6).alias("generation"), status.alias("status")))
    return out.withColumn("completed_seq", F.coalesce("completed_seq", F.lit(-1)))


@query("""WITH a AS (SELECT user_id AS awakeable_id, CASE user_id % 3 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' ELSE 'pending' END AS status, 'stored' || user_id AS stored FROM (SELECT DISTINCT user_id FROM events)), s AS (SELECT user_id AS awakeable_id, event_id AS seq, props AS payload FROM events WHERE event_type = 'purchase'), f AS (SELECT awakeable_id, min(seq) AS first, min_by(payload, seq) AS won FROM s GROUP BY 1)
SELECT awakeable_id, seq, status = 'pending' AND seq = first AS accepted, CASE status WHEN 'cancelled' THEN '' WHEN 'completed' THEN stored ELSE won END AS journaled FROM s JOIN a USING (awakeable_id) JOIN f USING (awakeable_id)""")
def awakeable_signal(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("awakeable_id")
    a = e.select(F.col("user_id").alias("awakeable_id")).distinct().select("awakeable_id", F.when(k % 3 == 0, "cancelled").when(k % 3 == 1, "completed").otherwise("pending").alias("status"), F.concat(F.lit("stored"), k.cast("string")).alias("payload"))
    s = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("awakeable_id"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return workflows.signal(a, s).withColumn("journaled", F.coalesce("journaled", F.lit("")))


@query("""WITH a AS (SELECT o_orderkey AS awakeable_id, o_custkey AS owner, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status FROM orders), i AS (SELECT c_custkey AS workflow_id, (['running', 'suspended', 'completed', 'failed'])[1 + c_custkey % 4] AS status, c_custkey % 3 AS generation FROM customer),
w AS (SELECT DISTINCT owner FROM a WHERE status = 'pending' AND awakeable_id % 2 = 0)
SELECT workflow_id, CASE WHEN owner IS NOT NULL AND i.status IN ('running', 'suspended') THEN 'running' ELSE i.status END AS status, generation, (SELECT count(*) FROM a WHERE a.owner = i.workflow_id AND a.status = 'pending' AND awakeable_id % 2 = 0) AS cancelled FROM i LEFT JOIN w ON w.owner = i.workflow_id""")
def awakeable_cancel(spark: SparkSession, sf: str) -> DataFrame:
    """Every second pending awakeable is cancelled, and its owner woken to see it."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    a = table(spark, sf, "orders").select(k.alias("awakeable_id"), F.col("o_custkey").alias("owner"), F.when(s == "O", "pending").when(s == "F", "completed").otherwise("cancelled").alias("status"))
    c = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(x) for x in ("running", "suspended", "completed", "failed")]), (c % 4 + 1).cast("int"))
    i = table(spark, sf, "customer").select(c.alias("workflow_id"), status.alias("status"), (c % 3).alias("generation"))
    changed, owners = workflows.cancel_awakeables(a, a.filter("awakeable_id % 2 = 0").select("awakeable_id"), i)
    n = changed.filter("accepted").groupBy(F.col("owner").alias("workflow_id")).agg(F.count(F.lit(1)).alias("cancelled"))
    return owners.join(n, "workflow_id", "left").fillna(0, ["cancelled"])


@query("SELECT b AS buckets, w AS workers, CAST(ceil(b / greatest(w, 1)) AS INT) AS share FROM range(1, 33) x(b), range(0, 9) y(w)")
def shard_fair_share(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.range(32 * 9).select((F.floor(F.col("id") / 9) + 1).alias("buckets"), (F.col("id") % 9).alias("workers"))
    return pairs.withColumn("share", workflows.fair_share(F.col("buckets"), F.col("workers")))


# Ids, expressions, codecs.


@query(f"SELECT c_custkey, {uuid_sql('c_name')} AS id, false AS moved FROM customer")
def uuid5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", ids.uuid5(F.col("c_name")).alias("id"), ids.seed_moved(F.col("c_name")).alias("moved"))


@query("SELECT p_partkey, CASE WHEN b = '' THEN 'q' WHEN regexp_matches(b, '^[a-z]') THEN b ELSE 'q' || b END AS base FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_brand || '--' || p_name || '!'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS b FROM part)")
def queue_base_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", ids.sanitised(F.concat("p_brand", F.lit("--"), "p_name", F.lit("!"))).alias("base"))


def _fnv_sql(units: str) -> str:
    return f"lpad(lower(to_hex(list_reduce(list_prepend({ids.FNV_OFFSET}::HUGEINT, {units}), lambda h, b: (xor(h, b) * {ids.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0')"


@query(f"""WITH t AS (SELECT p_partkey, p_brand || ' / ' || p_type || ' / ' || p_name || ' / ' || CASE WHEN p_partkey % 3 = 0 THEN 'é' ELSE 'work items waiting' END AS name FROM part),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS base, {_fnv_sql("list_transform(string_split(name, ''), lambda c: unicode(c)::HUGEINT)")} AS points, hex(encode(name)) AS raw FROM t)
SELECT p_partkey, CASE WHEN length(base) <= {ids.NAME_MOST} AND NOT ends_with(base, '_dlq') THEN base ELSE regexp_replace(substr(base, 1, {ids.NAME_PREFIX}), '_+$', '') || '_' || points END AS queue, {_fnv_sql("list_transform(range(length(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::HUGEINT)")} AS shape FROM b""")
def queue_names(spark: SparkSession, sf: str) -> DataFrame:
    """Physical names, long ones with a hash of the whole name's code points, and the hash of its bytes."""
    name = F.concat_ws(" / ", "p_brand", "p_type", "p_name", F.when(F.col("p_partkey") % 3 == 0, "é").otherwise("work items waiting"))
    return table(spark, sf, "part").select("p_partkey", ids.queue_name(name).alias("queue"), ids.fnv(name).alias("shape"))


@query("SELECT event_id, sha256('{\"k\":' || (props ->> '$.k') || '}') AS digest FROM events")
def replay_digests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", ids.replay_digest(F.col("props")).alias("digest"))


@query("SELECT event_id, k * 3 + user_id AS total, k * 3 + user_id > 150 AND event_type <> 'error' AS guard, CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'new' ELSE 'none' END AS label FROM (SELECT *, CAST(props ->> '$.k' AS BIGINT) AS k FROM events)")
def typed_expressions(spark: SparkSession, sf: str) -> DataFrame:
    scope = expr.Scope({"reg": {"user": "Integer", "total": "Integer"}, "cmd": {"k": "Integer", "kind": "Enum:kind"}}, {"reg": "reg", "cmd": "cmd"})
    total = expr.Op("+", expr.Op("*", expr.Ref("cmd.k"), expr.Lit(3, "Integer")), expr.Ref("user"))
    keep = expr.Op("and", expr.Op(">", total, expr.Lit(150, "Integer")), expr.Op("!=", expr.Ref("kind"), expr.Lit("error", "Enum:kind")))
    rows = table(spark, sf, "events").select("event_id", F.struct(F.col("user_id").alias("user"), F.lit(0).alias("total")).alias("reg"), F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind")).alias("cmd"))
    kinds = ("purchase", "signup", "view", "click", "error")
    label = expr.rule("label", kinds, {"purchase": "paid", "signup": "new", "view": "none", "click": "none", "error": "none"}, F.col("cmd.kind"))
    return rows.select("event_id", expr.write("total", total, scope).cast("bigint").alias("total"), expr.guard(keep, scope).alias("guard"), label.alias("label"))


_VERSION = "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3' WHEN 4 THEN '0' ELSE 'x' END"


@query(f"""WITH e AS (SELECT event_id, event_type, {_VERSION} AS v, CASE WHEN event_id % 17 = 0 THEN 'broken' ELSE props END AS payload, CAST(props ->> '$.k' AS BIGINT) AS k FROM events),
x AS (SELECT *, CASE WHEN event_type = 'error' THEN 'unknown-type' WHEN v = 'x' THEN 'malformed-version' WHEN v = '3' THEN 'version-ahead' WHEN v = '0' THEN 'unknown-version' WHEN payload = 'broken' THEN 'malformed-payload' END AS error FROM e)
SELECT event_id, coalesce(error, '') AS error, CASE WHEN event_type = 'error' THEN 'irrelevant' WHEN error IS NULL THEN 'relevant' ELSE 'failed' END AS outcome, CASE WHEN error IS NULL THEN CASE WHEN v = '2' THEN k ELSE k + 1000 END ELSE -1 END AS k FROM x""")
def codec_upcast(spark: SparkSession, sf: str) -> DataFrame:
    """Version 1 payloads are lifted to 2 by adding 1000 to a field."""
    up = lambda p: F.concat(F.lit('{"k": '), (F.get_json_object(p, "$.k").try_cast("bigint") + 1000).cast("string"), F.lit("}"))
    made = codec.Codec(2, ("signup", "view", "click", "purchase"), {1: up})
    k = F.col("event_id") % 6
    version = F.when(k == 1, "1").when(k == 2, "2").when(k == 3, "3").when(k == 4, "0").when(k == 5, '"x"')
    meta = F.when(k == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit('{"schemaVersion": '), version, F.lit("}")))
    rows = table(spark, sf, "events").select("event_id", "event_type", meta.alias("metadata"), F.when(F.col("event_id") % 17 == 0, "broken").otherwise(F.col("props")).alias("payload"))
    out = made.decode(rows, "k bigint", relevant_only=True)
    return out.select("event_id", F.coalesce("error", F.lit("")).alias("error"), "outcome", F.coalesce("decoded.k", F.lit(-1)).alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing:source' WHEN event_id % 11 = 0 THEN 'missing:event-type' WHEN event_id % 13 = 0 THEN 'invalid-int:schema-version' WHEN event_id % 17 = 0 THEN 'missing:message-id' WHEN event_id % 19 = 0 THEN 'invalid-uuid:causation-id' ELSE '' END AS error, CASE WHEN event_id % 2 = 0 THEN ts ELSE TIMESTAMP '2024-01-01' END AS occurred_at FROM events""")
def kafka_decode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    text = lambda s: F.lit(s)
    pairs = [
        ("x-source", F.when(k % 7 != 0, text("shop"))), ("x-destination", text("mail")), ("x-event-type", F.when(k % 11 != 0, F.col("event_type"))),
        ("x-schema-version", F.when(k % 13 == 0, text("two")).otherwise("2")), ("content-type", text("application/json")), ("x-message-id", F.when(k % 17 != 0, k.cast("string"))),
        ("x-causation-id", F.when(k % 19 == 0, text("no-uuid")).otherwise(ids.uuid5(k.cast("string")))), ("x-occurred-at", F.when(k % 2 == 0, F.col("ts").cast("string"))),
    ]
    heads = F.map_filter(F.create_map(*[x for name, v in pairs for x in (F.lit(name), v.cast("string"))]), lambda _, v: v.isNotNull())
    records = table(spark, sf, "events").select(
        "event_id", F.lit("t").alias("topic"), F.lit(0).alias("partition"), k.alias("offset"), k.cast("string").alias("key"), heads.alias("headers"), F.lit("2024-01-01").cast("timestamp_ntz").alias("received_at"),
    )
    return codec.kafka_decode(records).select(F.col("offset").alias("event_id"), F.coalesce("error", F.lit("")).alias("error"), "occurred_at")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown-type' WHEN event_id % 5 = 1 THEN 'metadata-not-object' ELSE '' END AS error,
CASE WHEN event_type <> 'error' AND event_id % 5 <> 1 THEN CASE event_id % 5 WHEN 0 THEN '{"schemaVersion":"2"}' WHEN 2 THEN '{"by":"u' || user_id || '","schemaVersion":"2"}' WHEN 3 THEN '{"schemaVersion":"2"}' ELSE '{"a":"1","b":"2","schemaVersion":"2"}' END ELSE '' END AS metadata FROM events""")
def codec_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of events as they are written: the version is put in, whatever was there under its name."""
    made = codec.Codec(2, ("signup", "view", "click", "purchase"), {1: lambda p: p})
    k = F.col("event_id") % 5
    given = F.when(k == 1, "[1]").when(k == 2, F.concat(F.lit('{"by": "u'), F.col("user_id").cast("string"), F.lit('"}'))).when(k == 3, '{"schemaVersion": 1}').when(k == 4, '{"a": 1, "b": "2"}')
    metadata, error = made.encode(F.col("event_type"), given)
    return table(spark, sf, "events").select("event_id", F.coalesce(error, F.lit("")).alias("error"), F.coalesce(metadata, F.lit("")).alias("metadata"))


@query("""SELECT event_id, 'mail' AS topic, 'u' || user_id AS key, octet_length(encode(props))::INT AS value_bytes, 'x-source=shop,x-destination=mail,x-event-type=' || event_type || ',x-schema-version=2,content-type=application/json,x-message-id=' || event_id || CASE WHEN event_id % 3 = 0 THEN ',traceparent=00-' || event_id ELSE '' END AS headers FROM events""")
def kafka_encode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.lit("shop").alias("source"), F.lit("mail").alias("destination"), F.col("event_type"), F.lit(2).alias("schema_version"), F.lit("application/json").alias("content_type"), k.alias("message_id"),
        F.when(k % 3 == 0, F.concat(F.lit("00-"), k.cast("string"))).alias("traceparent"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("payload"),
    )
    sent = codec.kafka_encode(rows.withColumn("key", F.struct("event_id", "key")))
    headers = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ",")
    return sent.select("key.event_id", "topic", "key.key", F.octet_length("value").alias("value_bytes"), headers.alias("headers"))


@query("""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'part_' || '01h455vb4pex5vsknk084sn02q' WHEN 1 THEN 'part_' || '81h455vb4pex5vsknk084sn02q' WHEN 2 THEN 'item_' || '01h455vb4pex5vsknk084sn02q' WHEN 3 THEN 'part_' || '01h455vb4p4x5vsknk084sn02q' WHEN 4 THEN 'part_' || '01h455vb4pex5vsknk084sn02' ELSE 'part_' || '01h455vb4pex5fsknk084sn02q' END AS id FROM part)
SELECT p_partkey, id, regexp_matches(id, '^part_[0-7][0-9abcdefghjkmnpqrstvwxyz]{25}$') AND (position(substr(id, 16, 1) IN '0123456789abcdefghjkmnpqrstvwxyz') - 1) >> 1 = 7 AND ((position(substr(id, 19, 1) IN '0123456789abcdefghjkmnpqrstvwxyz') - 1) >> 2) % 4 = 2 AS ok FROM t""")
def type_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with a type before them: the type, the alphabet, the length, the version and the variant are checked."""
    good = "01h455vb4pex5vsknk084sn02q"
    forms = ("part_" + good, "part_8" + good[1:], "item_" + good, "part_" + good[:10] + "4" + good[11:], "part_" + good[:-1], "part_" + good[:13] + "f" + good[14:])
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in forms]), (k % 6 + 1).cast("int")).alias("id"))
    return rows.withColumn("ok", ids.type_id_ok(F.col("id"), "part"))


@query("""WITH s AS (SELECT c_custkey AS id, (['absent', 'candidate', 'active', 'pending-retirement', 'retired'])[1 + c_custkey % 5] AS state, (['declare', 'activate', 'retire', 'finish'])[1 + c_nationkey % 4] AS event, c_custkey % 3 AS generation, c_nationkey % 3 AS wanted FROM customer),
r AS (SELECT * FROM (VALUES ('absent', 'declare', 'candidate'), ('candidate', 'activate', 'active'), ('active', 'activate', 'active'), ('active', 'retire', 'pending-retirement'), ('pending-retirement', 'activate', 'active'), ('pending-retirement', 'finish', 'retired'), ('candidate', 'retire', 'retired')) v(state, event, next))
SELECT id, coalesce(CASE WHEN wanted >= generation THEN next END, 'refused') AS next, CASE WHEN wanted >= generation AND next IS NOT NULL THEN wanted ELSE generation END AS generation FROM s LEFT JOIN r USING (state, event)""")
def contract_steps(spark: SparkSession, sf: str) -> DataFrame:
    """External read contracts: a step out of turn or to an earlier generation is refused."""
    from ..operators.declarations import CONTRACT
    from ..operators.readmodels import lookup

    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), pick(["absent", "candidate", "active", "pending-retirement", "retired"], k).alias("state"), pick(["declare", "activate", "retire", "finish"], n).alias("event"), (k % 3).alias("generation"), (n % 3).alias("wanted"))
    after = F.when(F.col("wanted") >= F.col("generation"), lookup(CONTRACT, F.col("state"), F.col("event"), default=F.lit(None).cast("string")))
    return rows.select("id", F.coalesce(after, F.lit("refused")).alias("next"), F.when(after.isNotNull(), F.col("wanted")).otherwise(F.col("generation")).alias("generation"))
