"""Operators that act on several tables at once: rebuilds, promotions, typed dispatch, children and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import Nominal, Structural
from ..operators import catalog, fold, messaging, routing, workflows
from ..operators import readmodels as r
from ..sources import lift
from ..sources.lift import table, with_
from .flows import _INST, _instances
from .registry import query

NOW = "1997-06-01"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def one_of(names: tuple[str | None, ...], place) -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (place + 1).cast("int"))


@query("""WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT e.* FROM events e JOIN f USING (user_id) WHERE event_id >= first)
SELECT user_id AS stream, max(event_id) FILTER (event_type = 'purchase') AS value, max_by(event_type, event_id) AS status, max(event_id) AS last_seen FROM a GROUP BY 1""")
def order_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase makes the row of its user, other events set its status."""
    k = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("stream"), k.alias("position"), (F.col("event_type") == "purchase").alias("made"), F.col("event_type").alias("status"), k.alias("value"))
    return r.summary(rows, "stream")


@query(with_("event_log") + """, q AS (SELECT DISTINCT stream_name, stream_id FROM event_log), s AS (SELECT stream_name, max(stream_version) AS version FROM event_log GROUP BY 1), e AS (SELECT * FROM event_log WHERE event_id % 199 <> 0),
c AS (SELECT stream_name, count(*) AS n, min(stream_version) FILTER (event_id % 97 = 0) AS bad FROM e GROUP BY 1)
SELECT q.stream_name AS stream, CASE WHEN stream_id % 41 = 0 THEN 'history-unavailable' WHEN stream_id % 37 = 0 THEN 'soft-deleted' WHEN stream_id % 31 = 0 THEN 'truncated' WHEN version > 70 THEN 'event-limit' WHEN bad IS NOT NULL THEN 'foreign-event' WHEN coalesce(n, 0) < version THEN 'history-incomplete' ELSE 'ok' END AS refusal
FROM q JOIN s USING (stream_name) LEFT JOIN c USING (stream_name)""")
def reproject_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Every stream asked for, against a log with holes and foreign events."""
    log, k = lift.event_log(spark, sf), F.col("stream_id")
    heads = log.groupBy(F.col("stream_name").alias("stream"), "stream_id").agg(F.max("stream_version").alias("version"))
    streams = heads.filter(k % 41 != 0).select("stream", F.when(k % 37 == 0, now()).alias("deleted"), F.when(k % 31 == 0, 5).otherwise(0).alias("truncate_before"), "version")
    events = log.filter("event_id % 199 <> 0").select(F.col("stream_name").alias("stream"), "stream_version", (F.col("event_id") % 97 == 0).alias("foreign"))
    out = r.reproject_refusal(heads.select("stream"), streams, events, 70)
    return out.select("stream", F.coalesce("refusal", F.lit("ok")).alias("refusal"))


def _promotions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows and outcomes of a run a customer, whose orders are staged and verified."""
    c, o, k = table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("run")
    each = c.select(F.col("c_custkey").alias("run"))
    runs = each.select("run", (k % 31 != 0).alias("ready"), F.lit(8).alias("dedup_limit"), F.when(k % 29 != 0, "r1").alias("serving"), (k % 23 != 0).alias("checkpoints_ok"))
    staged = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("s"), (F.col("o_orderkey") % 2).cast("string")).alias("subscription"), F.col("o_orderkey").alias("position"), F.concat(F.lit("p"), (F.col("o_orderkey") % 2).cast("string")).alias("projection"), F.col("o_orderkey").alias("event_id"))
    left = r.pruned(staged, each.select("run", F.lit("s0").alias("subscription"), (k * 20).alias("position")))
    sides = F.explode(F.array(F.lit("serving"), F.lit("candidate")))
    declared = each.select("run", sides.alias("side")).select("run", "side", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("target"))
    t, candidate = F.col("target"), F.col("side") == "candidate"
    life = F.when((k % 17 == 0) & (t == 1), "retired").when(candidate, "staging").otherwise("serving")
    made = declared.filter(~((k % 19 == 0) & candidate & (t == 2))).select("run", "side", "target", life.alias("lifecycle"), (~((k % 13 == 0) & (t == 1))).alias("identity_ok"), (~((k % 11 == 0) & candidate)).alias("shape_ok"))
    checks = o.select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 53 != 0).alias("passed"))
    return left, r.prepare(runs, left, declared, made, checks)


_PROMOTIONS = """st AS (SELECT o_custkey AS run, 'p' || o_orderkey % 2 AS projection, o_orderkey AS event_id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey <= o_custkey * 20)),
d AS (SELECT c_custkey AS run, side, target FROM customer, (VALUES ('serving'), ('candidate')) s(side), range(3) t(target)),
g AS (SELECT *, CASE WHEN run % 17 = 0 AND target = 1 THEN 'retired' WHEN side = 'candidate' THEN 'staging' ELSE 'serving' END AS lifecycle, NOT (run % 13 = 0 AND target = 1) AS identity_ok, NOT (run % 11 = 0 AND side = 'candidate') AS shape_ok FROM d WHERE NOT (run % 19 = 0 AND side = 'candidate' AND target = 2)),
differ AS (SELECT DISTINCT run FROM (SELECT run, side, target FROM d EXCEPT SELECT run, side, target FROM g)),
out AS (SELECT c_custkey AS run, coalesce(n, 0) AS staged, CASE WHEN c_custkey % 31 = 0 THEN 'not-ready' WHEN n > 8 THEN 'dedup-limit' WHEN c_custkey % 29 = 0 THEN 'no-serving-revision' WHEN c_custkey IN (SELECT run FROM differ) THEN 'targets-differ'
 WHEN EXISTS (SELECT 1 FROM g WHERE run = c_custkey AND lifecycle = 'retired') THEN 'wrong-lifecycle' WHEN EXISTS (SELECT 1 FROM g WHERE run = c_custkey AND NOT identity_ok) THEN 'identity-changed' WHEN EXISTS (SELECT 1 FROM g WHERE run = c_custkey AND NOT shape_ok) THEN 'shape-changed'
 WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 53 = 0) THEN 'verification-failed' WHEN c_custkey % 23 = 0 THEN 'missing-checkpoint' ELSE 'prepared' END AS outcome
 FROM customer LEFT JOIN (SELECT run, count(*) AS n FROM st GROUP BY 1) x ON x.run = c_custkey)"""


@query(f"WITH {_PROMOTIONS} SELECT run, staged, outcome FROM out")
def promotion_prepared(spark: SparkSession, sf: str) -> DataFrame:
    return _promotions(spark, sf)[1]


@query(f"WITH {_PROMOTIONS} SELECT projection, event_id FROM st JOIN out USING (run) WHERE outcome = 'prepared' UNION SELECT 'p' || o_orderkey % 2, o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def promotion_installed(spark: SparkSession, sf: str) -> DataFrame:
    staged, outcomes = _promotions(spark, sf)
    k = F.col("o_orderkey")
    applied = table(spark, sf, "orders").filter(k % 3 == 0).select(F.concat(F.lit("p"), (k % 2).cast("string")).alias("projection"), k.alias("event_id"))
    return r.installed(applied, staged, outcomes)


@query(with_("event_log") + "SELECT event_id, false AS never, false AS every_0, stream_version % 10 = 0 AS every_10, event_type = 'error' AS on_terminal, (event_type = 'purchase' AND stream_version > 5) AS custom FROM event_log")
def snapshot_policies(spark: SparkSession, sf: str) -> DataFrame:
    before, after, terminal = F.col("stream_version") - 1, F.col("stream_version"), F.col("event_type") == "error"
    is_due = lambda policy, **more: fold.should_snapshot(policy, before, after, terminal, **more)
    return lift.event_log(spark, sf).select(
        "event_id", is_due("never").alias("never"), is_due("every", every=0).alias("every_0"), is_due("every", every=10).alias("every_10"), is_due("on-terminal").alias("on_terminal"),
        is_due("custom", custom=(F.col("event_type") == "purchase") & (after > 5)).alias("custom"),
    )


def _domain(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as commands of their orders to suppliers; those of some parts were done before."""
    l, key = table(spark, sf, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber")
    flag = F.col("l_returnflag")
    commands = l.select(
        F.col("l_orderkey").alias("source_event"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("target"), key.alias("command_id"),
        F.when(flag == "A", "accepted").when(flag == "N", "no-op").otherwise("rejected").alias("decision"), F.col("l_partkey").alias("payload"), F.when(F.col("l_quantity") > 40, "store-failed").alias("error"),
    )
    return routing.domain_results(commands, l.filter("l_partkey % 7 = 0").select(key.alias("command_id")))


_DOMAIN = "c AS (SELECT *, l_orderkey * 8 + l_linenumber AS id FROM lineitem), x AS (SELECT l_orderkey AS source_event, l_linenumber AS idx, l_suppkey AS target, CASE WHEN id IN (SELECT id FROM c WHERE l_partkey % 7 = 0) THEN 'duplicate' WHEN l_quantity > 40 THEN 'failed' ELSE 'handled' END AS result, l_returnflag AS flag, l_partkey AS part FROM c)"


@query(f"WITH {_DOMAIN} SELECT source_event, idx, target, result, CASE WHEN result <> 'handled' THEN '' WHEN flag = 'A' THEN 'accepted' WHEN flag = 'N' THEN 'no-op' ELSE 'rejected' END AS decision, CASE WHEN result = 'handled' THEN part ELSE -1 END AS payload FROM x")
def domain_results(spark: SparkSession, sf: str) -> DataFrame:
    return _domain(spark, sf).select("source_event", "idx", "target", "result", F.coalesce("decision", F.lit("")).alias("decision"), F.coalesce("payload", F.lit(-1)).alias("payload"))


@query(f"WITH {_DOMAIN}, f AS (SELECT source_event, target FROM x WHERE result = 'failed' QUALIFY row_number() OVER (PARTITION BY source_event ORDER BY idx, target) = 1) SELECT source_event, count(*) FILTER (result = 'duplicate') AS duplicates, count(*) FILTER (result = 'failed') AS failures, coalesce(max(f.target), -1) AS first_target FROM x LEFT JOIN f USING (source_event) GROUP BY 1")
def domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return routing.domain_summary(_domain(spark, sf)).select("source_event", "duplicates", "failures", F.coalesce("first_target", F.lit(-1)).alias("first_target"))


@query("WITH g AS (SELECT DISTINCT p_size % 5 AS grp, p_brand AS target FROM part WHERE p_partkey % 16 = 0) SELECT DISTINCT p_name AS model, p_size % 5 AS grp FROM part WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.grp = p_size % 5 AND g.target = p_brand)")
def catalog_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as models that observe their brand; the group of their size covers the brands of some."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_name").alias("model"), (F.col("p_size") % 5).alias("grp"), F.col("p_brand").alias("target"), "p_partkey")
    return catalog.outside(rows.drop("p_partkey"), rows.filter("p_partkey % 16 = 0").select("grp", "target").distinct())


@query(with_("queue") + """, d AS (SELECT msg_id, CAST(payload ->> '$.k' AS BIGINT) > 10 AS readable FROM queue WHERE read_ct > 5), m AS (SELECT msg_id FROM d WHERE readable ORDER BY 1 LIMIT 300), k AS (SELECT msg_id FROM d WHERE msg_id NOT IN (SELECT msg_id FROM m) ORDER BY 1 LIMIT 500)
SELECT msg_id, CASE WHEN msg_id IN (SELECT msg_id FROM m) THEN 'redriven' WHEN msg_id IN (SELECT msg_id FROM k) THEN 'archived' ELSE 'kept' END AS fate FROM d""")
def dlq_fates(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 300 dead letters are driven again, up to 500 of the rest archived, as their batches are."""
    dead = lift.queue(spark, sf).filter("read_ct > 5")
    again, rest = messaging.redrive(dead, F.coalesce(F.from_json("payload", "k bigint")["k"] > 10, F.lit(False)), 300)
    archived, kept = messaging.archive(rest, now(), 500)
    part = lambda df, fate: df.select("msg_id", F.lit(fate).alias("fate"))
    return part(again, "redriven").unionByName(part(archived, "archived")).unionByName(part(kept, "kept"))


def _ended(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as children of customers; their lines end them."""
    k, flag = F.col("o_orderkey"), F.col("flag")
    status = one_of(("running", "running", "running", "completed", "failed"), k % 5)
    children = table(spark, sf, "orders").select(k.alias("child_id"), F.col("o_custkey").alias("parent_id"), F.concat(F.lit("child-"), k.cast("string")).alias("await_step"), status.alias("status"), F.when(k % 5 == 3, "stored").alias("result"))
    ends = lift.inbox(spark, sf).select(F.col("source").alias("child_id"), "seq", F.when(flag == "N", "completed").when(flag == "A", "cancelled").otherwise("failed").alias("status"), flag.alias("result"))
    c = F.col("c_custkey")
    parents = table(spark, sf, "customer").select(c.alias("workflow_id"), one_of(("running", "suspended", "completed"), c % 3).alias("status"))
    return workflows.end_children(children, ends, parents)


_ENDED = "WITH " + f"inbox AS ({lift.CTE['inbox']})" + """, ch AS (SELECT o_orderkey AS child_id, o_custkey AS parent_id, (['running', 'running', 'running', 'completed', 'failed'])[1 + o_orderkey % 5] AS status FROM orders),
e AS (SELECT source AS child_id, CASE flag WHEN 'N' THEN 'completed' WHEN 'A' THEN 'cancelled' ELSE 'failed' END AS status, flag FROM inbox QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) = 1), done AS (SELECT DISTINCT source AS child_id FROM inbox WHERE flag = 'N'),
out AS (SELECT ch.child_id, parent_id, CASE WHEN ch.status = 'running' AND e.child_id IS NOT NULL THEN e.status ELSE ch.status END AS status, CASE WHEN ch.status = 'completed' THEN 'stored' WHEN ch.status = 'running' AND e.status = 'completed' THEN 'N' ELSE '' END AS result, (ch.status = 'running' AND e.child_id IS NOT NULL) OR (ch.status = 'completed' AND ch.child_id IN (SELECT child_id FROM done)) AS told FROM ch LEFT JOIN e USING (child_id))"""


@query(f"{_ENDED} SELECT child_id, parent_id, status, result FROM out")
def children_ended(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf)[0].select("child_id", "parent_id", "status", F.coalesce("result", F.lit("")).alias("result"))


@query(f"{_ENDED} SELECT parent_id, 'child-' || child_id AS step_name, status AS kind, result FROM out WHERE told AND parent_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 2)")
def children_told(spark: SparkSession, sf: str) -> DataFrame:
    return _ended(spark, sf)[1].withColumn("result", F.coalesce("result", F.lit("")))


@query("SELECT o_orderkey AS child_id, o_custkey AS parent_id, 'completed' AS status FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, arg_min(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)), 'running' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def children_spawned(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    there = table(spark, sf, "orders").filter(k % 3 == 0).select(k.alias("child_id"), F.col("o_custkey").alias("parent_id"), F.lit("a").alias("await_step"), F.lit("completed").alias("status"), F.lit("x").alias("result"))
    asked = lift.inbox(spark, sf).select(F.col("source").alias("child_id"), F.col("seq.l_suppkey").alias("parent_id"), F.lit("a").alias("await_step"), "seq")
    return workflows.spawned(there, asked).select("child_id", "parent_id", "status")


@query(f"""WITH i AS ({_INST}), c AS (SELECT workflow_id AS child_id, workflow_id // 4 AS parent_id FROM i WHERE workflow_id % 4 = 1),
g AS (SELECT workflow_id AS id FROM i WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at <= TIMESTAMP '{NOW}' AND NOT EXISTS (SELECT 1 FROM c JOIN i p ON p.workflow_id = c.parent_id WHERE c.child_id = i.workflow_id AND p.status NOT IN ('completed', 'failed', 'cancelled')))
SELECT 'instances' AS part, count(*) AS n FROM i WHERE workflow_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'steps', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)
UNION ALL SELECT 'children', count(*) FROM c WHERE child_id NOT IN (SELECT id FROM g) AND parent_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'timers', count(*) FROM lineitem WHERE l_returnflag <> 'N' OR l_orderkey NOT IN (SELECT id FROM g)""")
def wf_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each table when the workflows that may go are gone."""
    i, l = _instances(spark, sf), table(spark, sf, "lineitem")
    children = i.filter("workflow_id % 4 = 1").select(F.col("workflow_id").alias("child_id"), F.floor(F.col("workflow_id") / 4).alias("parent_id"))
    gone = workflows.collectable(i, children, now())
    kind = F.when(F.col("l_returnflag") == "N", "sleep").otherwise("reminder")
    parts = workflows.without(gone, {"instances": i, "steps": l.select(F.col("l_orderkey").alias("workflow_id")), "children": children, "timers": l.select(F.col("l_orderkey").alias("owner_id"), kind.alias("kind"))})
    counts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT o_orderkey AS workflow_id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 THEN '' ELSE 'w' || o_orderkey % 4 END AS leased_by, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AS freed FROM orders")
def wf_lease_release(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("workflow_id")
    rows = _instances(spark, sf).withColumn("leased_by", F.when(k % 3 != 0, F.concat(F.lit("w"), (k % 4).cast("string"))))
    return workflows.released(rows, rows.filter(k % 2 == 0)).select("workflow_id", F.coalesce("leased_by", F.lit("")).alias("leased_by"), "freed")


@query(f"""WITH s AS (SELECT s_nationkey AS subscription, s_suppkey AS bucket, CASE WHEN s_suppkey % 7 < s_nationkey % 7 THEN 'a' WHEN s_suppkey % 3 = 0 THEN 'b' WHEN s_suppkey % 3 = 1 THEN 'c' END AS owner, TIMESTAMP '{NOW}' + to_days((s_suppkey % 5 - 2)::INT) AS lease FROM supplier),
w AS (SELECT subscription, count(*) AS n, count(DISTINCT owner) FILTER (lease > TIMESTAMP '{NOW}' AND owner <> 'a') + 1 AS workers, count(*) FILTER (owner = 'a') AS held, min(bucket) FILTER (owner IS NULL OR (owner <> 'a' AND lease < TIMESTAMP '{NOW}')) AS free FROM s GROUP BY 1),
o AS (SELECT s.*, workers, ceil(n / workers) AS share, coalesce(owner = 'a', false) OR (held < ceil(n / workers) AND coalesce(bucket = free, false)) AS owned FROM s JOIN w USING (subscription)),
p AS (SELECT *, count(*) FILTER (owned) OVER (PARTITION BY subscription ORDER BY bucket) AS place FROM o)
SELECT subscription, bucket, CASE WHEN owned AND (workers = 1 OR place <= share) THEN 'a' WHEN owned THEN '' ELSE coalesce(owner, '') END AS owner FROM p""")
def shard_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Worker a's pass over buckets that it, b and c own, some by leases that have run out."""
    k = F.col("s_suppkey")
    owner = F.when(k % 7 < F.col("s_nationkey") % 7, "a").when(k % 3 == 0, "b").when(k % 3 == 1, "c")
    shards = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("subscription"), k.alias("bucket"), owner.alias("owner"), (now() + F.make_dt_interval((k % 5 - 2).cast("int"))).alias("lease_expires_at"))
    return workflows.shard_pass(shards, "a", now()).withColumn("owner", F.coalesce("owner", F.lit("")))


ORDER = Structural({"id": ("orderId", "bigint"), "total": ("totalCents", "bigint"), "note": ("note", "string")})
STATUS = Nominal({"finished": "F", "open": "O", "partial": "P"})


@query("""SELECT o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS total, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS note, '{"orderId":' || o_orderkey || ',"totalCents":' || round(o_totalprice * 100)::BIGINT || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',"note":"' || o_orderpriority || '"' END || '}' AS wire,
CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS status, true AS same FROM orders""")
def codec_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written to the wire and read back, by shape and by name."""
    domain = F.struct(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("total"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))
    rows = table(spark, sf, "orders").select(domain.alias("domain"), STATUS.decode(F.col("o_orderstatus")).alias("status"), "o_orderstatus").withColumn("wire", ORDER.encode(F.col("domain")))
    back = ORDER.decode(F.col("wire"))
    same = ORDER.law(F.col("domain")) & STATUS.law(F.col("status")) & (STATUS.encode(F.col("status")) == F.col("o_orderstatus"))
    return rows.select(back["id"].alias("id"), back["total"].alias("total"), F.coalesce(back["note"], F.lit("")).alias("note"), "wire", "status", same.alias("same"))


_RESUMED = """r AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 17 <> 0 THEN c_custkey // 2 END AS grp, (['running', 'failed', 'promoted'])[1 + c_custkey % 3] AS status, c_custkey % 10 = 0 AS drifted, c_custkey % 13 <> 0 AS kept FROM customer WHERE c_custkey % 19 <> 0),
out AS (SELECT c_custkey AS run, CASE WHEN r.run IS NULL THEN 'not-found' WHEN NOT kept THEN 'pre-canonical' WHEN r.grp IS NULL THEN 'group-missing' WHEN drifted THEN 'contract-mismatch' WHEN r.status = 'promoted' OR c_custkey % 2 = 1 OR (c_custkey // 2) % 7 = 0 THEN 'not-active' ELSE 'resumed' END AS outcome FROM customer LEFT JOIN r ON r.run = c_custkey)"""


def _resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A run a customer, two to a group, of which the even one is active."""
    k = F.col("run")
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("run"))
    half = F.floor(k / 2)
    runs = asked.filter(k % 19 != 0).select("run", F.when(k % 17 != 0, half).alias("grp"), one_of(("running", "failed", "promoted"), k % 3).alias("status"), F.when(k % 10 == 0, "old").otherwise("new").alias("contract"), F.when(k % 13 != 0, "s").alias("slice"))
    all_groups = asked.select(half.alias("grp")).distinct()
    groups = all_groups.select("grp", F.when(F.col("grp") % 7 == 0, "live").otherwise("rebuilding").alias("status"), (F.col("grp") * 2).alias("active_run"), F.lit("s").alias("slice"))
    return r.resume(asked, runs, groups, all_groups.select("grp", F.lit("new").alias("contract")))


@query(f"WITH {_RESUMED} SELECT run, outcome FROM out")
def rebuild_resumed(spark: SparkSession, sf: str) -> DataFrame:
    return _resumed(spark, sf).select("run", "outcome")


@query(f"WITH {_RESUMED} SELECT o_custkey AS run, count(*) AS events, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders JOIN out ON run = o_custkey WHERE outcome = 'resumed' AND o_orderkey > run * 3 AND o_orderkey <= run * 40 GROUP BY 1")
def rebuild_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's category is its customer's orders, read up to a cursor and captured up to a head."""
    o, k = table(spark, sf, "orders"), F.col("c_custkey")
    sources = table(spark, sf, "customer").select(k.alias("run"), k.alias("category"), (k * 3).alias("cursor"), (k * 40).alias("captured_head"))
    left = r.remaining(_resumed(spark, sf), sources, o.select(F.col("o_custkey").alias("category"), F.col("o_orderkey").alias("global_position")))
    return left.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.min("global_position").alias("first"), F.max("global_position").alias("last"))


@query(with_("timers", "inbox") + f""", i AS ({_INST}) SELECT 'due-timers' AS gauge, count(*) AS n FROM timers WHERE status = 'scheduled' AND fire_at <= TIMESTAMP '{NOW}' UNION ALL SELECT 'stuck-timers', count(*) FROM timers WHERE status = 'firing' AND updated_at <= TIMESTAMP '{NOW}' AND attempts >= 3
UNION ALL SELECT 'outbox-backlog', count(*) FROM orders WHERE NOT (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderkey % 11 = 0)) UNION ALL SELECT 'inbox-backlog', count(*) FROM inbox WHERE flag <> 'N' UNION ALL SELECT 'pending-awakeables', count(*) FROM i WHERE status = 'suspended'
UNION ALL SELECT 'active-children', count(*) FROM i WHERE workflow_id % 4 = 1 AND status = 'running' UNION ALL SELECT 'dedup-before', count(*) FROM lineitem WHERE l_suppkey % 4 = 1 AND l_shipdate < TIMESTAMP '{NOW}'""")
def gauges(spark: SparkSession, sf: str) -> DataFrame:
    """What an operator watches, each a filter and a count over one scan."""
    i, t = _instances(spark, sf), lift.timers(spark, sf)
    watched = {
        "due-timers": t.filter((F.col("status") == "scheduled") & (F.col("fire_at") <= now())), "stuck-timers": messaging.stuck(t, now(), 3),
        "outbox-backlog": lift.outbox(spark, sf).filter("status in ('pending', 'failed')"), "inbox-backlog": lift.inbox(spark, sf).filter("flag <> 'N'"),
        "pending-awakeables": i.filter("status = 'suspended'"), "active-children": i.filter("workflow_id % 4 = 1 and status = 'running'"),
        "dedup-before": table(spark, sf, "lineitem").filter((F.col("l_suppkey") % 4 == 1) & (F.col("l_shipdate") < now())),
    }
    counts = [df.agg(F.lit(name).alias("gauge"), F.count(F.lit(1)).alias("n")) for name, df in watched.items()]
    out = counts[0]
    for df in counts[1:]:
        out = out.unionByName(df)
    return out
