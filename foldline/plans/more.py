"""Listings, gauges and smaller transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import declarations, inverse, workflows
from ..operators import readmodels as r
from ..sources import lift
from ..sources.lift import table, with_
from .flows import uuid_sql
from .registry import query

ALL_ROWS = 100


@query(f"SELECT l_suppkey AS grp, count(*) AS n, CASE WHEN count(*) > {ALL_ROWS} THEN 'KR004' ELSE 'ok' END AS code FROM lineitem GROUP BY 1")
def all_rows_bound(spark: SparkSession, sf: str) -> DataFrame:
    """A read that returns all rows of a contract fails beyond the bound; it isn't cut."""
    n = F.count(F.lit(1))
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("grp")).agg(n.alias("n"), F.when(n > ALL_ROWS, "KR004").otherwise("ok").alias("code"))


@query("SELECT s_nationkey AS service, s_suppkey AS responder, (s_suppkey % 3)::INT AS tier, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3, s_suppkey)::INT AS place FROM supplier")
def ordered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    tier = (F.col("s_suppkey") % 3).cast("int")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(tier, "s_suppkey"))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("service"), F.col("s_suppkey").alias("responder"), tier.alias("tier"), place.alias("place"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '1-URGENT' AND (o_orderdate, o_orderkey) > (TIMESTAMP '1997-06-01', 0) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def instance_page(spark: SparkSession, sf: str) -> DataFrame:
    after = F.struct("o_orderdate", "o_orderkey") > F.struct(F.lit("1997-06-01").cast("timestamp_ntz").alias("o_orderdate"), F.lit(0).cast("long").alias("o_orderkey"))
    found = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderpriority") == "1-URGENT") & after)
    return found.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("SELECT DISTINCT l_orderkey AS source_event, l_linenumber AS emit_index, first_value(l_suppkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS target FROM lineitem WHERE l_returnflag = 'R'")
def dead_letter_insert(spark: SparkSession, sf: str) -> DataFrame:
    """First record of each (source event, emit index) stays."""
    rows = lift.inbox(spark, sf).filter("flag = 'R'")
    return rows.groupBy(F.col("source").alias("source_event"), F.col("dedupe_key").alias("emit_index")).agg(F.min("seq")["l_suppkey"].alias("target"))


@query("SELECT side, id FROM (SELECT 'missing' AS side, n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey + 2 FROM customer) UNION ALL SELECT DISTINCT 'surplus', c_nationkey + 2 FROM customer WHERE c_nationkey + 2 NOT IN (SELECT n_nationkey FROM nation))")
def target_map_check(spark: SparkSession, sf: str) -> DataFrame:
    want = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    have = table(spark, sf, "customer").select((F.col("c_nationkey") + 2).alias("id"))
    return want.subtract(have).select(F.lit("missing").alias("side"), "id").unionByName(have.subtract(want).select(F.lit("surplus").alias("side"), "id"))


@query("SELECT * FROM (SELECT 'start' AS action, s_suppkey AS bucket FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 UNION ALL SELECT 'stop', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 <> 0)")
def shard_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("bucket"))
    owned, running = s.filter("bucket % 2 = 0"), s.filter("bucket % 3 = 0")
    return owned.subtract(running).select(F.lit("start").alias("action"), "bucket").unionByName(running.subtract(owned).select(F.lit("stop").alias("action"), "bucket"))


@query("SELECT s_suppkey % 10 AS subscription, s_nationkey % 4 AS size, count(*) AS n FROM supplier GROUP BY ALL")
def shard_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 10).alias("subscription"), (F.col("s_nationkey") % 4).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o.o_orderkey AS run, c.c_custkey AS grp FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderkey % 25 = c.c_nationkey")
def runs_of_same_slice(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, (o["o_custkey"] == c["c_custkey"]) & (o["o_orderkey"] % 25 == c["c_nationkey"])).select(F.col("o_orderkey").alias("run"), F.col("c_custkey").alias("grp"))


@query("SELECT r_regionkey AS grp, r_name AS name, coalesce(string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 2 = 0), '') AS generations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def group_generations(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))), ",").alias("generations"))
    g = table(spark, sf, "region")
    return g.join(n, g["r_regionkey"] == n["n_regionkey"], "left").select(F.col("r_regionkey").alias("grp"), F.col("r_name").alias("name"), F.coalesce("generations", F.lit("")).alias("generations"))


@query(with_("inbox") + "SELECT source, dedupe_key, max(quantity) AS quantity, '' AS payload FROM inbox WHERE flag = 'N' GROUP BY ALL")
def inbox_slim(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplication alone is kept: no payload."""
    return lift.inbox(spark, sf).filter("flag = 'N'").groupBy("source", "dedupe_key").agg(F.max("quantity").alias("quantity")).withColumn("payload", F.lit(""))


@query("SELECT l_returnflag AS status, count(*) AS backlog, count(*) FILTER (l_shipdate < TIMESTAMP '1997-01-01') AS collectable FROM lineitem GROUP BY 1")
def inbox_gauges(spark: SparkSession, sf: str) -> DataFrame:
    old = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("status")).agg(F.count(F.lit(1)).alias("backlog"), F.count_if(old).alias("collectable"))


@query(with_("outbox") + "SELECT outbox_id, created_at FROM outbox WHERE status = 'sent' AND created_at < TIMESTAMP '1996-01-01'")
def outbox_gc(spark: SparkSession, sf: str) -> DataFrame:
    return lift.outbox(spark, sf).filter((F.col("status") == "sent") & (F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"))).select("outbox_id", "created_at")


@query(f"SELECT o_orderkey, {uuid_sql("'orders:' || o_custkey || ':' || o_orderkey")} AS message_id, 'orders' AS source, 'customer-' || o_custkey AS message_key FROM orders")
def producer_drafts(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", ids.uuid5(F.concat_ws(":", F.lit("orders"), c, k)).alias("message_id"), F.lit("orders").alias("source"), F.concat(F.lit("customer-"), c).alias("message_key"))


@query(with_("queue") + "SELECT msg_id, CAST(payload ->> '$.k' AS BIGINT) AS k, 0 AS read_ct FROM queue WHERE read_ct > 5 AND CAST(payload ->> '$.k' AS BIGINT) > 10")
def dlq_redrive(spark: SparkSession, sf: str) -> DataFrame:
    """Dead letters whose envelope can be read go back with a fresh count."""
    k = F.from_json("payload", "k bigint")["k"]
    return lift.queue(spark, sf).filter("read_ct > 5").select("msg_id", k.alias("k"), F.lit(0).alias("read_ct")).filter("k > 10")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'retry' WHEN event_id % 4 = 1 THEN 'dead-letter' WHEN CAST(props ->> '$.k' AS BIGINT) IS NULL THEN 'dead-letter' ELSE 'decoded' END AS outcome FROM events")
def job_codec(spark: SparkSession, sf: str) -> DataFrame:
    """A payload from a later version is retried, a malformed one is dead."""
    k = F.col("event_id") % 4
    value = F.from_json(F.when(k == 1, "{broken").otherwise(F.col("props")), "k bigint")["k"]
    return table(spark, sf, "events").select("event_id", F.when(k == 0, "retry").when(value.isNull(), "dead-letter").otherwise("decoded").alias("outcome"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(props ->> '$.k' AS BIGINT) ELSE -1 END AS k, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'content-type' END AS error FROM events")
def integration_json(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "application/json; charset=utf-8").otherwise("text/plain")
    ok = F.substring_index(kind, ";", 1) == "application/json"
    return table(spark, sf, "events").select("event_id", F.when(ok, F.from_json("props", "k bigint")["k"]).otherwise(-1).alias("k"), F.when(ok, "").otherwise("content-type").alias("error"))


@query(f"SELECT l_orderkey, l_linenumber, i AS place, CASE WHEN i < 2 THEN {uuid_sql("l_orderkey || ':' || l_linenumber || ':' || i")} ELSE 'generated' END AS event_id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45), range(3) r(i)")
def event_ids_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Given ids go to events in order; events beyond them keep ids of their own."""
    rows = table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber").distinct()
    rows = rows.select("l_orderkey", "l_linenumber", F.posexplode(F.array(*[F.lit(x) for x in "abc"])).alias("place", "event"))
    made = ids.uuid5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "place")]))
    return rows.select("l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"), F.when(F.col("place") < 2, made).otherwise("generated").alias("event_id"))


@query("SELECT s_suppkey AS run, s_nationkey * 10 + 7 * (s_suppkey % 5) <= 150 AS admitted, least(150, s_nationkey * 10 + 7 * (s_suppkey % 5)) AS reserved FROM supplier")
def cutover_admission(spark: SparkSession, sf: str) -> DataFrame:
    staged, specs = F.col("s_nationkey") * 10, F.col("s_suppkey") % 5
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run"), r.admission(staged, 7, specs, 150).alias("admitted"), F.least(F.lit(150), staged + 7 * specs).alias("reserved"))


@query("SELECT o_orderstatus AS status, count(*) AS attempts, count(*) FILTER (o_totalprice > 200000) AS done, count(*) FILTER (o_totalprice <= 200000 AND o_orderkey % 2 = 0) AS suspended, count(*) FILTER (o_totalprice <= 200000 AND o_orderkey % 2 = 1) AS failed FROM orders GROUP BY 1")
def resume_summary(spark: SparkSession, sf: str) -> DataFrame:
    done, even = F.col("o_totalprice") > 200000, F.col("o_orderkey") % 2 == 0
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(done).alias("done"), F.count_if(~done & even).alias("suspended"), F.count_if(~done & ~even).alias("failed"))


@query("SELECT c_mktsegment AS projection, count(*) FILTER (c_custkey % 6 = 0) AS deleted, count(*) FILTER (c_custkey % 6 <> 0) AS kept FROM customer GROUP BY 1")
def deletion_counts(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.col("c_custkey") % 6 == 0
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("projection")).agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


@query("SELECT s_suppkey AS grp, CASE WHEN s_suppkey % 9 = 0 THEN 'unregistered' WHEN s_suppkey % 7 IN (3, 4, 5, 6) THEN 'fenced' WHEN s_nationkey % 4 = 0 THEN 'mismatch' ELSE 'applied' END AS outcome FROM supplier")
def fenced_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Writes of a projection by the status of its group and the revision that is bound."""
    k = F.col("s_suppkey")
    status = F.element_at(F.array(*[F.lit(s) for s in r.AVAILABILITY]), (k % 7 + 1).cast("int"))
    _, writes = r.availability(status)
    return table(spark, sf, "supplier").select(k.alias("grp"), F.when(k % 9 == 0, "unregistered").when(~writes, "fenced").when(F.col("s_nationkey") % 4 == 0, "mismatch").otherwise("applied").alias("outcome"))


@query("SELECT c_custkey AS grp, 'versioned:' || c_nationkey || ':' || c_mktsegment AS identity, 'versioned:' || c_nationkey || ':' || c_mktsegment = 'versioned:3:BUILDING' AS may_resume FROM customer")
def contract_identity(spark: SparkSession, sf: str) -> DataFrame:
    identity = F.concat_ws(":", F.lit("versioned"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("grp"), identity.alias("identity"), (identity == "versioned:3:BUILDING").alias("may_resume"))


@query("SELECT grp, generation, CASE WHEN NOT ok THEN state WHEN state = 'serving' THEN 'retired' WHEN state = 'candidate' THEN 'serving' ELSE state END AS state, CASE WHEN ok THEN epoch + 1 ELSE epoch END AS epoch FROM (SELECT s_nationkey AS grp, s_suppkey AS generation, CASE s_suppkey % 3 WHEN 0 THEN 'serving' WHEN 1 THEN 'candidate' ELSE 'retired' END AS state, s_nationkey % 5 AS epoch, bool_and(s_acctbal > -900) OVER (PARTITION BY s_nationkey) AS ok FROM supplier)")
def promote_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Serving becomes retired and candidate serving, for a group all of whose checks hold; otherwise nothing moves."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("grp"), k.alias("generation"), F.when(k % 3 == 0, "serving").when(k % 3 == 1, "candidate").otherwise("retired").alias("state"), (F.col("s_nationkey") % 5).alias("epoch"), "s_acctbal")
    ok = rows.groupBy("grp").agg(F.bool_and(F.col("s_acctbal") > -900).alias("ok"))
    state = F.when(~F.col("ok"), F.col("state")).when(F.col("state") == "serving", "retired").when(F.col("state") == "candidate", "serving").otherwise(F.col("state"))
    return rows.join(ok, "grp").select("grp", "generation", state.alias("state"), F.when(F.col("ok"), F.col("epoch") + 1).otherwise(F.col("epoch")).alias("epoch"))


@query("SELECT n_nationkey AS generation, count(s_suppkey) AS blockers, count(s_suppkey) = 0 AS droppable FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY 1")
def drop_preview(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier").filter("s_acctbal > 9000")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy(F.col("n_nationkey").alias("generation")).agg(F.count("s_suppkey").alias("blockers"), (F.count("s_suppkey") == 0).alias("droppable"))


@query("SELECT coalesce(a, b) AS model, CASE WHEN b IS NULL THEN 'adopt' WHEN a IS NULL THEN 'orphan' ELSE 'known' END AS plan FROM (SELECT c_custkey AS a FROM customer WHERE c_custkey % 2 = 0) x FULL JOIN (SELECT c_custkey AS b FROM customer WHERE c_custkey % 3 = 0) y ON a = b")
def adoption_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a, b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("a")), c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("b"))
    plan = F.when(F.col("b").isNull(), "adopt").when(F.col("a").isNull(), "orphan").otherwise("known")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("model"), plan.alias("plan"))


@query(with_("journal") + "SELECT workflow_id, max(generation) + 1 AS generation, 'wf-' || workflow_id || '#' || (max(generation) + 1) AS stream, max_by(result, ordinal) AS seed FROM journal GROUP BY 1")
def wf_continue_as_new(spark: SparkSession, sf: str) -> DataFrame:
    g = lift.journal(spark, sf).groupBy("workflow_id").agg((F.max("generation") + 1).alias("generation"), F.max_by("result", "ordinal").alias("seed"))
    return g.select("workflow_id", "generation", F.concat(F.lit("wf-"), F.col("workflow_id").cast("string"), F.lit("#"), F.col("generation").cast("string")).alias("stream"), "seed")


@query("SELECT conv_id AS workflow_id, 'p' || turn AS patch, CASE WHEN conv_id % 4 = 0 THEN turn % 2 = 0 ELSE turn IN (0, 3) END AS decision FROM conversations")
def wf_patches(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded decisions are frozen; others are whether the patch is in the recorded set."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("workflow_id"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("patch"), "turn")
    old = c.filter("workflow_id % 4 = 0").select("workflow_id", "patch", (F.col("turn") % 2 == 0).alias("decision"))
    return workflows.patched(c.withColumn("patches", F.array(F.lit("p0"), F.lit("p3"))), old).select("workflow_id", "patch", "decision")


@query("SELECT conv_id AS workflow_id, role AS namespace, turn, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INT AS ordinal FROM conversations")
def wf_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("workflow_id"), F.col("role").alias("namespace"), "turn", (F.row_number().over(w) - 1).cast("int").alias("ordinal"))


@query(with_("timers") + "SELECT timer_id AS workflow_id, CASE WHEN fire_at <= TIMESTAMP '1998-06-01' AND status IN ('scheduled', 'firing', 'fired') THEN 'woken' WHEN status = 'cancelled' THEN 'cancelled' ELSE 'asleep' END AS sleep FROM timers")
def wf_sleep(spark: SparkSession, sf: str) -> DataFrame:
    due = (F.col("fire_at") <= F.lit("1998-06-01").cast("timestamp_ntz")) & F.col("status").isin("scheduled", "firing", "fired")
    return lift.timers(spark, sf).select(F.col("timer_id").alias("workflow_id"), F.when(due, "woken").when(F.col("status") == "cancelled", "cancelled").otherwise("asleep").alias("sleep"))


@query("SELECT o_orderkey AS workflow_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus = 'F' THEN 'running' WHEN o_orderkey % 2 = 1 AND o_orderstatus IN ('O', 'P') THEN 'cancelled' ELSE 'refused' END AS next, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'running' ELSE 'suspended' END AS arbitrated FROM orders")
def wf_transitions(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", "failed").when(s == "O", "running").otherwise("suspended")
    action = F.when(k % 2 == 0, "resurrect").otherwise("cancel")
    return table(spark, sf, "orders").select(k.alias("workflow_id"), F.coalesce(workflows.transition(status, action), F.lit("refused")).alias("next"), workflows.arbitrate(k % 3 == 0, k % 5 == 0).alias("arbitrated"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(code, '^[a-z][a-z0-9._-]{0,63}$') AND octet_length(encode(detail)) <= 20 THEN 'ok' ELSE 'bad' END AS verdict, substr(detail, 1, 12) AS shown FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'no-stock' WHEN 1 THEN 'Bad Code' ELSE 'x.' || s_suppkey END AS code, repeat('é', (s_suppkey % 14)::INT) || s_name AS detail FROM supplier)")
def rejection_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    code = F.when(k % 3 == 0, "no-stock").when(k % 3 == 1, "Bad Code").otherwise(F.concat(F.lit("x."), k.cast("string")))
    detail = F.concat(F.repeat(F.lit("é"), (k % 14).cast("int")), "s_name")
    return table(spark, sf, "supplier").select("s_suppkey", F.when(ids.rejection_code_ok(code, detail, 20), "ok").otherwise("bad").alias("verdict"), F.substring(detail, 1, 12).alias("shown"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'open' WHEN 'error' THEN 'broken' END IS NOT NULL AS mapped, coalesce(CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'signup' THEN 'open' WHEN 'error' THEN 'broken' END, 'none') AS status FROM events")
def status_map(spark: SparkSession, sf: str) -> DataFrame:
    """A partial map of event types to statuses."""
    status = r.lookup({"purchase": "paid", "signup": "open", "error": "broken"}, F.col("event_type"), default=F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", status.isNotNull().alias("mapped"), F.coalesce(status, F.lit("none")).alias("status"))


CHAINS = (
    inverse.Chain("Idle", "start", "Busy", ("signup", "view")), inverse.Chain("Idle", "look", "Idle", ("view",)), inverse.Chain("Idle", "fail", "Idle", ("error",)),
    inverse.Chain("Busy", "buy", "Idle", ("purchase",)), inverse.Chain("Busy", "look", "Busy", ("click",)), inverse.Chain("Busy", "look", "Busy", ("view",)), inverse.Chain("Busy", "see", "Idle", ("view",)),
)


_STEP = " ".join(f"WHEN r.rest = '' AND r.vertex = '{v}' AND e.event_type = '{k}' THEN '{x}'" for v, k, x in [("Idle", "signup", "Idle|view|Busy"), ("Idle", "view", "Idle||"), ("Idle", "error", "Idle||"), ("Busy", "purchase", "Idle||"), ("Busy", "click", "Busy||"), ("Busy", "view", "ambiguous")])


@query(
    "WITH RECURSIVE event_log AS (" + lift.CTE["event_log"] + f"""), r AS (SELECT DISTINCT stream_name, 0::BIGINT AS v, 'Idle' AS vertex, '' AS rest, '' AS goal, 'ok' AS outcome, 0::BIGINT AS fail FROM event_log
UNION ALL SELECT stream_name, v, CASE WHEN step IN ('none', 'ambiguous', 'mismatch') THEN vertex ELSE split_part(step, '|', 1) END, CASE WHEN step IN ('none', 'ambiguous', 'mismatch') THEN '' ELSE split_part(step, '|', 2) END, CASE WHEN step IN ('none', 'ambiguous', 'mismatch') THEN '' ELSE split_part(step, '|', 3) END, CASE WHEN step IN ('none', 'ambiguous', 'mismatch') THEN step ELSE 'ok' END, CASE WHEN step IN ('none', 'ambiguous', 'mismatch') THEN v ELSE 0 END
FROM (SELECT r.stream_name, e.stream_version AS v, r.vertex, CASE WHEN r.rest <> '' THEN CASE WHEN r.rest = e.event_type THEN r.goal || '||' ELSE 'mismatch' END {_STEP} ELSE 'none' END AS step FROM r JOIN event_log e ON e.stream_name = r.stream_name AND e.stream_version = r.v + 1 WHERE r.outcome = 'ok')),
l AS (SELECT stream_name, max_by(vertex, v) AS vertex, max_by(CASE WHEN outcome = 'ok' AND rest <> '' THEN 'truncated' ELSE outcome END, v) AS outcome, max_by(CASE WHEN outcome = 'ok' AND rest <> '' THEN v ELSE fail END, v) AS fail FROM r GROUP BY 1)
SELECT stream_name, vertex, outcome, fail AS at_version FROM l"""
)
def inverse_replay(spark: SparkSession, sf: str) -> DataFrame:
    out = inverse.replay(lift.event_log(spark, sf), "Idle", CHAINS)
    return out.select("stream_name", "vertex", "outcome", F.coalesce("at", F.lit(0)).alias("at_version"))


_S = lambda x: f"'s' || octet_length(encode({x})) || ':' || {x}"
_FACT = lambda *xs: f"'l{len(xs)}:' || " + " || ".join(map(_S, xs))


@query(f"""WITH f AS (SELECT n_regionkey AS k, 1 AS part, {_FACT("'target'", "n_name", "'clear'")} AS fact, n_name AS ranked FROM nation
UNION ALL SELECT n_regionkey, 2, {_FACT("'projection'", "'p' || n_name", "'log'", "''", "''", "'True'", "'beginning'", "n_name")}, n_name FROM nation UNION ALL SELECT DISTINCT n_regionkey, 3, {_FACT("'source'", "'log'", "'all'")}, '' FROM nation),
g AS (SELECT n_regionkey AS k, 'l' || (2 + count(*)) || ':' || {_S("'group'")} || {_S("'r' || n_regionkey")} || string_agg({_S("n_name")}, '' ORDER BY n_nationkey) AS own FROM nation GROUP BY 1)
SELECT 'r' || g.k AS grp, 'slice:' || sha256('l2:' || {_S("'slice'")} || 'l' || (1 + count(*)) || ':' || own || string_agg(fact, '' ORDER BY part, ranked)) AS fingerprint, 0 AS findings FROM g JOIN f USING (k) GROUP BY g.k, own""")
def catalog_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Slice fingerprints of a catalog declared from the nations, one group a region."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name").orderBy("n_nationkey").collect()
    targets = tuple(declarations.Target(x["n_name"]) for x in n)
    projections = tuple(declarations.Projection("p" + x["n_name"], (x["n_name"],), "log") for x in n)
    groups = tuple(declarations.Group(f"r{k}", tuple(x["n_name"] for x in n if x["n_regionkey"] == k)) for k in sorted({x["n_regionkey"] for x in n}))
    c = declarations.Catalog((declarations.Source("log", "all"),), targets, projections, groups)
    rows = [(g.name, declarations.slice_fingerprint(c, g.name), len(declarations.validate(c))) for g in groups]
    return spark.createDataFrame(rows, "grp string, fingerprint string, findings int")
