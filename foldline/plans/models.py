"""Read models, rebuilds and catalog rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import readmodels as r
from ..sources import lift, scans
from ..sources.lift import table, with_
from .registry import query

_STATUSES = list(r.AVAILABILITY)


def _sql_case(column: str, pairs: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in pairs.items()) + " END"


_STATUS_SQL = "(['" + "','".join(_STATUSES) + "'])[1 + s_suppkey % 7]"


def _status(key: str):
    return F.element_at(F.array(*[F.lit(s) for s in _STATUSES]), (F.col(key) % 7 + 1).cast("int"))


@query(f"SELECT s_suppkey AS grp, {_STATUS_SQL} AS status, s_suppkey % 7 IN (0, 1, 2, 3, 4) AS reads, s_suppkey % 7 IN (0, 1, 2) AS writes FROM supplier")
def group_availability(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), _status("s_suppkey").alias("status"))
    reads, writes = r.availability(F.col("status"))
    return rows.withColumn("reads", reads).withColumn("writes", writes)


@query("""WITH w AS (SELECT user_id AS name, event_id AS seq, ts AS at, (['register', 'rebuild', 'finish', 'abandon'])[1 + (event_id * 7) % 4] AS action, event_id % 3 AS version, 'shape-' || event_id % 2 AS shape FROM events WHERE event_id % 4 <> 1 OR user_id % 3 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq) AS place FROM w), f AS (SELECT * FROM o WHERE place = 1),
t AS (SELECT name, action, version, shape FROM w WHERE action <> 'register' QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1), b AS (SELECT name, max(seq) AS seq FROM w WHERE action = 'finish' GROUP BY 1)
SELECT f.name, CASE t.action WHEN 'rebuild' THEN 'rebuilding' WHEN 'abandon' THEN 'abandoned' ELSE 'live' END AS status, CASE WHEN t.name IS NULL THEN f.version ELSE t.version END AS version, CASE WHEN t.name IS NULL THEN f.shape ELSE t.shape END AS shape, coalesce((SELECT w.at FROM w WHERE w.name = b.name AND w.seq = b.seq), f.at) AS last_built_at
FROM f LEFT JOIN t ON t.name = f.name LEFT JOIN b ON b.name = f.name""")
def registry_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Registrations and transitions of models in the order of events."""
    k = F.col("event_id")
    action = F.element_at(F.array(*[F.lit(x) for x in ("register", "rebuild", "finish", "abandon")]), (k * 7 % 4 + 1).cast("int"))
    rows = table(spark, sf, "events").filter("event_id % 4 <> 1 or user_id % 3 <> 0")
    return r.registry(rows.select(F.col("user_id").alias("name"), k.alias("seq"), F.col("ts").alias("at"), action.alias("action"), (k % 3).alias("version"), F.concat(F.lit("shape-"), (k % 2).cast("string")).alias("shape")))


@query(with_("inbox") + ", k AS (SELECT source * 8 + dedupe_key AS key, seq, flag FROM inbox), f AS (SELECT key, min(seq) AS first FROM k GROUP BY 1) SELECT CASE WHEN flag = 'R' THEN 'fenced' WHEN key % 9 = 0 OR seq > first THEN 'duplicate' ELSE 'applied' END AS outcome, count(*) AS n, min(key) AS low, max(key) AS high FROM k JOIN f USING (key) GROUP BY 1")
def async_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = lift.inbox(spark, sf).select((F.col("source") * 8 + F.col("dedupe_key")).alias("key"), "seq", "flag")
    applied = rows.filter("key % 9 = 0").select("key")
    out = r.apply_async(rows, applied, "key", F.col("flag") == "R")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))


@query("SELECT 'p' || l_suppkey % 4 AS projection, count(*) AS pruned, min(l_shipdate) AS first FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-06-01' GROUP BY 1")
def dedup_prune(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "lineitem").filter(F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp_ntz"))
    return old.groupBy(F.concat(F.lit("p"), (F.col("l_suppkey") % 4).cast("string")).alias("projection")).agg(F.count(F.lit(1)).alias("pruned"), F.min("l_shipdate").alias("first"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 6 = 0 THEN 'unregistered' WHEN c_nationkey % 3 = 1 THEN 'stale-version' WHEN c_nationkey % 4 = 1 THEN 'stale-shape' WHEN c_mktsegment = 'BUILDING' THEN 'not-live' END, 'ok') AS verdict FROM customer")
def model_validation(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    version = F.when(F.col("c_custkey") % 6 != 0, F.when(n % 3 == 1, 1).otherwise(2))
    shape, status = F.when(n % 4 == 1, "old").otherwise("new"), F.when(F.col("c_mktsegment") == "BUILDING", "rebuilding").otherwise("live")
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(r.query_error(version, shape, status, F.lit(2), F.lit("new")), F.lit("ok")).alias("verdict"))


@query("SELECT event_id, (['immediate', 'head', 'position'])[1 + event_id % 3] AS mode, CASE WHEN event_id % 3 = 0 THEN 'fresh' WHEN event_id % 3 = 2 AND event_id % 11 = 0 THEN 'no-position' WHEN event_id % 13 = 0 THEN 'no-cursor' WHEN event_id >= CASE WHEN event_id % 3 = 1 THEN 6000 ELSE user_id * 50 END THEN 'fresh' ELSE 'waiting' END AS verdict FROM events")
def read_freshness(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    mode = F.element_at(F.array(F.lit("immediate"), F.lit("head"), F.lit("position")), (k % 3 + 1).cast("int"))
    verdict = r.freshness(mode, F.when(k % 13 != 0, k), F.lit(6000), F.when(k % 11 != 0, F.col("user_id") * 50))
    # a position that is asked for is missing in every eleventh row
    return table(spark, sf, "events").select("event_id", mode.alias("mode"), verdict.alias("verdict"))


@query("""WITH g AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'retired' WHEN 2 THEN 'candidate' ELSE 'active' END AS contract, CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey END AS grp, (['""" + "','".join(_STATUSES) + """'])[1 + c_custkey % 7] AS status, c_custkey % 3 AS epoch, c_nationkey % 3 AS want_epoch, c_custkey % 19 <> 0 AS ok FROM customer), n AS (SELECT o_custkey AS id, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT id, coalesce(CASE WHEN contract IS NULL OR grp IS NULL OR contract = 'retired' THEN 'KR002' WHEN epoch <> want_epoch OR status IN ('rebuilding', 'failed') THEN 'KR001' WHEN contract <> 'active' OR NOT ok THEN 'KR003' WHEN coalesce(n_rows, 0) > 10 THEN 'KR004' END, 'ok') AS code FROM g LEFT JOIN n USING (id)""")
def read_guard(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    contract = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, "retired").when(k % 5 == 2, "candidate").otherwise("active")
    g = table(spark, sf, "customer").select(
        k.alias("id"), contract.alias("contract"), F.when(k % 17 != 0, F.col("c_nationkey")).alias("grp"), _status("c_custkey").alias("status"), (k % 3).alias("epoch"),
        (F.col("c_nationkey") % 3).alias("want_epoch"), (k % 19 != 0).alias("revision_ok"), F.lit(True).alias("shape_ok"),
    )
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return r.read_guard(g.join(n, "id", "left").fillna(0, ["n_rows"]), 10).select("id", F.coalesce("code", F.lit("ok")).alias("code"))


_GROUPS = """g AS (SELECT c_custkey AS grp, (['""" + "','".join(_STATUSES) + """'])[1 + c_custkey % 7] AS status, c_custkey % 7 < 5 AS reads, run AS active_run FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS run FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey),
cu AS (SELECT c_custkey AS grp, CASE WHEN c_custkey % 3 = 0 THEN 'inline' ELSE 'checkpoint' END AS basis, [c_nationkey, c_nationkey + c_custkey % 4] AS names FROM customer WHERE c_custkey % 5 <> 0),
ck AS (SELECT s_nationkey AS name, s_suppkey AS member, s_suppkey * 10 AS position FROM supplier), ru AS (SELECT o_orderkey AS run, o_orderkey * 4 AS captured_head FROM orders WHERE o_orderkey % 11 <> 0), so AS (SELECT l_orderkey AS run, l_partkey AS position FROM lineitem), mo AS (SELECT 'm' || o_orderkey AS name, o_custkey AS grp FROM orders)"""


@query(f"""WITH {_GROUPS}, need AS (SELECT DISTINCT grp, unnest(names) AS name FROM cu), low AS (SELECT need.grp, need.name, min(position) AS low FROM need LEFT JOIN ck USING (name) GROUP BY ALL),
floor AS (SELECT grp, CASE WHEN bool_and(low IS NOT NULL) THEN min(low) END AS floor FROM low GROUP BY 1)
SELECT g.grp, g.status, g.reads, coalesce(cu.basis, 'unmanaged') AS basis, coalesce(CASE WHEN g.reads AND cu.basis = 'checkpoint' THEN floor.floor END, -1) AS applied_position, coalesce(g.active_run, -1) AS active_run,
coalesce((SELECT min(so.position) FROM so WHERE so.run = ru.run), -1) AS rebuild_position, coalesce(ru.captured_head, -1) AS rebuild_head, coalesce((SELECT string_agg(mo.name, ',' ORDER BY mo.name) FROM mo WHERE mo.grp = g.grp), '') AS models
FROM g LEFT JOIN cu ON cu.grp = g.grp LEFT JOIN floor ON floor.grp = g.grp LEFT JOIN ru ON ru.run = g.active_run""")
def group_status(spark: SparkSession, sf: str) -> DataFrame:
    """A group a customer: its cursor names subscriptions that suppliers hold, its run is its last open order, whose
    lines are the sources, and its models are its orders."""
    c, o, k = table(spark, sf, "customer"), table(spark, sf, "orders"), F.col("c_custkey")
    runs = o.filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("active_run"))
    reads, _ = r.availability(_status("c_custkey"))
    groups = c.join(runs, "c_custkey", "left").select(k.alias("grp"), _status("c_custkey").alias("status"), reads.alias("reads"), "active_run")
    names = F.array_distinct(F.array(F.col("c_nationkey"), F.col("c_nationkey") + k % 4))
    cursors = c.filter("c_custkey % 5 <> 0").select(k.alias("grp"), F.when(k % 3 == 0, "inline").otherwise("checkpoint").alias("basis"), names.alias("names"))
    checkpoints = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("member"), (F.col("s_suppkey") * 10).alias("position"))
    known = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") * 4).alias("captured_head"))
    sources = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("source"), F.col("l_partkey").alias("position"))
    models = o.select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("grp"))
    out = r.group_status(groups, cursors, checkpoints, known, sources, models)
    return out.fillna(-1, ["applied_position", "active_run", "rebuild_position", "rebuild_head"]).withColumn("models", F.array_join("models", ","))


@query("""WITH x AS (SELECT o_custkey % 50 AS run, o_orderkey % 3 AS kind, o_totalprice > 1200 AS ok FROM orders),
w AS (SELECT run, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, bool_and(ok) AS ok FROM x GROUP BY 1)
SELECT run, a > 0 AND b > 0 AND c > 0 AND ok AND run % 4 <> 0 AS proven FROM w""")
def completion_proof(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("run"), (F.col("o_orderkey") % 3).alias("kind"), (F.col("o_totalprice") > 1200).alias("ok"))
    want = x.groupBy("run").agg((F.count_if(F.col("kind") == 0) + (F.col("run") % 4 == 0).cast("int")).alias("want_sources"), F.count_if(F.col("kind") == 1).alias("want_adapters"), F.count_if(F.col("kind") == 2).alias("want_verifications"))
    part = lambda k, name: x.filter(F.col("kind") == k).select("run", F.col("ok").alias(name))
    return r.completion(part(0, "complete"), part(1, "complete"), part(2, "passed"), want)


@query(with_("all_log") + ", f AS (SELECT 'sub-' || category AS subscription, category, max(global_position) // 2 AS floor FROM all_log GROUP BY ALL) SELECT subscription, count(*) AS n, min(global_position) AS first, max(global_position) AS last FROM all_log JOIN f USING (category) WHERE global_position > floor GROUP BY 1")
def dedup_backfill(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.all_log(spark, sf)
    floors = log.groupBy("category").agg(F.floor(F.max("global_position") / 2).alias("floor")).select(F.concat(F.lit("sub-"), "category").alias("subscription"), "category", "floor")
    return r.dedup_backfill(log, floors, scans.captured(log)).groupBy("subscription").agg(F.count(F.lit(1)).alias("n"), F.min("global_position").alias("first"), F.max("global_position").alias("last"))


@query("SELECT o_custkey AS stream, count(*) FILTER (o_custkey % 10 <> 0 OR o_orderkey % 2 = 0) AS n, max(o_orderkey) FILTER (o_custkey % 10 <> 0 OR o_orderkey % 2 = 0) AS last FROM orders GROUP BY 1 HAVING count(*) FILTER (o_custkey % 10 <> 0 OR o_orderkey % 2 = 0) > 0")
def stream_reproject(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "stream")
    project = lambda df: df.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    broken = o.filter("stream % 10 = 0")
    return r.reproject(project(o), "stream", project(broken.filter("o_orderkey % 2 = 0")), broken.select("stream").distinct())


@query("SELECT s_suppkey AS run, CASE WHEN s_suppkey % 11 = 0 THEN 'report' WHEN s_suppkey % 11 = 1 THEN 'refuse' WHEN s_suppkey % 3 = 0 THEN 'replay' WHEN s_suppkey % 8 = 0 THEN 'prepare-and-promote' WHEN s_nationkey > 15 THEN 'extend-head' WHEN s_nationkey * 10 + 5 * (s_suppkey % 4) <= 100 THEN 'fence' ELSE 'wait-for-admission' END AS step FROM supplier")
def versioned_step(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    status = F.when(k % 11 == 0, "promoted").when(k % 11 == 1, "failed").otherwise("running")
    step = r.next_phase(k % 3 != 0, n + 100, F.lit(100), 15, r.admission(n * 10, 5, k % 4, 100), k % 8 == 0, status)
    return table(spark, sf, "supplier").select(k.alias("run"), step.alias("step"))


_BEGUN = "b AS (SELECT s_suppkey AS grp, CASE WHEN s_suppkey % 7 = 6 THEN 'unregistered' WHEN s_nationkey % 2 <> 0 THEN 'slice-drift' WHEN s_suppkey % 4 >= 2 THEN 'not-live' WHEN s_acctbal < 0 THEN 'missing-checkpoint' ELSE 'begun' END AS outcome, s_suppkey % 4 AS k FROM supplier)"


@query(f"WITH {_BEGUN} SELECT grp, outcome, CASE outcome WHEN 'unregistered' THEN '' WHEN 'begun' THEN 'rebuilding' ELSE (['live', 'failed', 'rebuilding', 'cutover'])[1 + k] END AS status FROM b")
def begin_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    status = F.when(k % 4 == 0, "live").when(k % 4 == 1, "failed").when(k % 4 == 2, "rebuilding").otherwise("cutover")
    groups = s.filter(k % 7 != 6).select(k.alias("grp"), status.alias("status"), (F.col("s_nationkey") % 2).alias("slice"), (F.col("s_acctbal") >= 0).alias("checkpoints_ok"))
    return r.begin_rebuild(groups, s.select(k.alias("grp"), F.lit(0).alias("want_slice"))).fillna("", ["status"])


@query(with_("all_log") + ", s AS (SELECT * FROM (VALUES ('mail', 'order'), ('stats', 'order'), ('stats2', 'event')) v(projection, category)) SELECT projection, count(*) AS staged, min(global_position) AS first, max(global_position) AS last FROM all_log JOIN s USING (category) GROUP BY 1")
def dedup_stage(spark: SparkSession, sf: str) -> DataFrame:
    specs = spark.createDataFrame([("mail", "order"), ("stats", "order"), ("stats2", "event")], "projection string, category string")
    staged = lift.all_log(spark, sf).join(F.broadcast(specs), "category")
    return staged.groupBy("projection").agg(F.count(F.lit(1)).alias("staged"), F.min("global_position").alias("first"), F.max("global_position").alias("last"))


@query("""WITH """ + _BEGUN + """, g AS (SELECT grp, outcome = 'begun' AS go FROM b),
t AS (SELECT 'targets' AS part, l_suppkey AS grp, 0 AS position FROM lineitem UNION ALL SELECT 'dedup', l_suppkey, 0 FROM lineitem WHERE l_returnflag = 'R')
SELECT part, count(*) AS n, 0::BIGINT AS positions FROM t JOIN g USING (grp) WHERE NOT go GROUP BY 1 UNION ALL SELECT 'checkpoints', count(*), sum(CASE WHEN go THEN 0 ELSE grp * 10 END)::BIGINT FROM g""")
def begin_rebuild_effects(spark: SparkSession, sf: str) -> DataFrame:
    """What beginning leaves in the targets, in what was applied, and in the checkpoints."""
    l, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    grp = l.select(F.col("l_suppkey").alias("grp"), "l_returnflag")
    checkpoints = s.select(F.col("s_suppkey").alias("grp"), (F.col("s_suppkey") * 10).alias("position"))
    targets, dedup, reset = r.begun(begin_rebuild(spark, sf), grp, grp.filter("l_returnflag = 'R'"), checkpoints)
    count = lambda df, name, total: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), total.cast("long").alias("positions"))
    return count(targets, "targets", F.lit(0)).unionByName(count(dedup, "dedup", F.lit(0))).unionByName(count(reset, "checkpoints", F.sum("position")))


# Catalog rules over declarations made of the dimension tables.


@query("SELECT p_name AS name, p_brand AS family, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def catalog_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return c.duplicates(table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("family")), "name", "family")


@query("SELECT s_suppkey, s_nationkey + 5 AS ref FROM supplier WHERE s_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)")
def catalog_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return c.dangling(table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") + 5).alias("ref")), "ref", table(spark, sf, "nation"), "n_nationkey").select("s_suppkey", "ref")


@query("SELECT n_nationkey AS target, count(DISTINCT s_suppkey) AS owners FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT s_suppkey) <> 1")
def catalog_ownership(spark: SparkSession, sf: str) -> DataFrame:
    owners = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("projection"), F.col("s_nationkey").alias("target"))
    return c.ownership(table(spark, sf, "nation").select(F.col("n_nationkey").alias("target")), owners)


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier depends on one whose place among all of them is given by its key."""
    s = table(spark, sf, "supplier")
    k, n = F.col("s_suppkey"), s.agg(F.count(F.lit(1)).alias("n"))
    return s.crossJoin(F.broadcast(n)).select(k.alias("name"), ((k * k + 3) % F.col("n")).alias("depends_on"))


_EDGES = "e AS (SELECT s_suppkey AS name, (s_suppkey * s_suppkey + 3) % (SELECT count(*) FROM supplier) AS depends_on FROM supplier)"


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT name AS a, depends_on AS b FROM e UNION SELECT r.a, e.depends_on FROM r JOIN e ON r.b = e.name) SELECT x.a AS name, min(x.b) AS cycle FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1")
def catalog_cycle(spark: SparkSession, sf: str) -> DataFrame:
    return c.cycles(_edges(spark, sf))


@query(f"WITH {_EDGES} SELECT (a.s_suppkey % 3)::INT AS grp, e.name, e.depends_on FROM e JOIN supplier a ON a.s_suppkey = e.name JOIN supplier b ON b.s_suppkey = e.depends_on AND b.s_suppkey % 3 = a.s_suppkey % 3 WHERE b.s_suppkey >= a.s_suppkey")
def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    order = table(spark, sf, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("grp"), F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("position"))
    return c.out_of_order(order, _edges(spark, sf))


@query("SELECT 'removed' AS finding, c_custkey AS name FROM customer WHERE c_custkey % 12 = 0 UNION ALL SELECT 'moved', c_custkey FROM customer WHERE c_custkey % 12 <> 0 AND c_custkey % 10 = 1")
def catalog_evolution(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("owner"))
    now = base.filter("name % 12 <> 0").withColumn("owner", F.when(F.col("name") % 10 == 1, F.col("owner") + 1).otherwise(F.col("owner")))
    return c.removed(base, now, "name").select(F.lit("removed").alias("finding"), "name").unionByName(c.moved(base, now, "name", "owner").select(F.lit("moved").alias("finding"), "name"))


@query("SELECT 'several-groups' AS finding, p_size AS name FROM part GROUP BY p_size HAVING count(DISTINCT p_type) > 1 UNION ALL SELECT 'empty-group', n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def catalog_membership(spark: SparkSession, sf: str) -> DataFrame:
    many = c.members(table(spark, sf, "part").select(F.col("p_type").alias("grp"), F.col("p_size").alias("target"))).filter("finding = 'several-groups'")
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    none = c.members(n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").select(F.col("n_nationkey").alias("grp"), F.col("s_suppkey").alias("target"))).filter("finding = 'empty-group'")
    return many.unionByName(none)


@query("SELECT n_regionkey AS grp FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING bool_or(s_suppkey % 2 = 0) AND bool_or(s_suppkey % 2 = 1)")
def catalog_sources(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return c.mixed_sources(n.join(s, n["n_nationkey"] == s["s_nationkey"]).select(F.col("n_regionkey").alias("grp"), F.when(F.col("s_suppkey") % 2 == 0, "all").otherwise("category").alias("scope")))


@query("""WITH q AS (SELECT n_nationkey AS model, (['immediate', 'log', 'category'])[1 + n_nationkey % 3] AS wait, n_regionkey AS category FROM nation), s AS (SELECT s_nationkey AS model, CASE WHEN s_suppkey % 5 = 0 THEN 'all' ELSE 'category' END AS scope, s_suppkey % 5 AS sub FROM supplier)
SELECT model, wait, count(*) FILTER (scope = 'all' OR (wait = 'category' AND category = sub)) AS fit FROM q LEFT JOIN s USING (model) WHERE wait <> 'immediate' GROUP BY ALL HAVING count(*) FILTER (scope = 'all' OR (wait = 'category' AND category = sub)) <> 1""")
def catalog_cursor(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    q = table(spark, sf, "nation").select(k.alias("model"), F.when(k % 3 == 0, "immediate").when(k % 3 == 1, "log").otherwise("category").alias("wait"), F.col("n_regionkey").alias("category"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("model"), F.when(F.col("s_suppkey") % 5 == 0, "all").otherwise("category").alias("scope"), (F.col("s_suppkey") % 5).alias("sub_category"))
    return c.cursors(q, s)


@query("SELECT p_partkey AS target, CASE WHEN p_size % 3 = 0 THEN 'needs-replayable-owner' ELSE 'starts-at-head' END AS finding FROM part WHERE p_partkey % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0)")
def catalog_clear(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    targets = p.select(F.col("p_partkey").alias("target"), F.when(F.col("p_partkey") % 2 == 0, "clear").otherwise("preserve").alias("policy"))
    owners = p.select(F.col("p_partkey").alias("target"), (F.col("p_size") % 3 != 0).alias("replayable"), F.when(F.col("p_size") % 5 == 0, "current-head").otherwise("beginning").alias("start"))
    return c.clear_needs_replay(targets, owners)


@query("SELECT s_suppkey AS projection, CASE WHEN s_suppkey % 6 = 0 THEN 'no-subscription' WHEN s_suppkey % 6 = 1 THEN 'other-name' ELSE 'other-source' END AS finding FROM supplier WHERE s_suppkey % 6 <= 2")
def catalog_wiring(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    declared = s.select(k.alias("projection"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("source"))
    live = s.filter("s_suppkey % 6 <> 0").select(k.alias("projection"), F.when(k % 6 == 1, "x").otherwise(F.col("s_name")).alias("live_name"), F.when(k % 6 == 2, -1).otherwise(F.col("s_nationkey")).alias("live_source"))
    return c.wiring(declared, live)


@query("SELECT n_nationkey AS model, count(DISTINCT s_suppkey % 2) AS owners FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT s_suppkey % 2) <> 1")
def catalog_supplier(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    models = s.select(F.col("s_nationkey").alias("model"), F.col("s_suppkey").alias("target"))
    return c.suppliers(models, s.select(F.col("s_suppkey").alias("target"), (F.col("s_suppkey") % 2).alias("projection")))


_REBUILD = "w AS (SELECT o_custkey AS key, 'f-' || o_orderkey AS value, o_orderkey * 4 + 2 AS place, 0 AS ordinal FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'u-' || o_orderkey, o_orderkey * 4 + 2, 1 FROM orders WHERE o_orderpriority = '1-URGENT'), m AS (SELECT key, max_by(value, place * 10 + ordinal) AS value FROM w GROUP BY 1)"


def _rebuilt(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    """Up to the head that the log has when the rebuild begins."""
    o = table(spark, sf, "orders").withColumn("global_position", F.col("o_orderkey") * 4 + 2)
    rows = lambda prefix, condition: lambda e: e.filter(condition).select(F.col("o_custkey").alias("key"), F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")).alias("value"), "global_position")
    targets = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("old").alias("value"))
    return r.rebuild(targets, o, scans.captured(o), [rows("f-", "o_orderstatus = 'F'"), rows("u-", "o_orderpriority = '1-URGENT'")], policy)


@query(f"WITH {_REBUILD} SELECT key, value FROM m")
def rebuild_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return _rebuilt(spark, sf, "clear")


@query(f"WITH {_REBUILD} SELECT key, value FROM m UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT key FROM m)")
def rebuild_preserved(spark: SparkSession, sf: str) -> DataFrame:
    return _rebuilt(spark, sf, "preserve")


@query(with_("all_log") + "SELECT unnest(['orders', 'even']) AS adapter, count(*) AS events, unnest([count(*) FILTER (category = 'order'), count(*) FILTER (source_id % 2 = 0)]) AS applied FROM all_log")
def replay_progress(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.all_log(spark, sf)
    return r.progress(log, scans.captured(log), {"orders": F.col("category") == "order", "even": F.col("source_id") % 2 == 0})
