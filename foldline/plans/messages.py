"""Outbox, inbox, timer and queue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import messaging as m
from ..sources import lift
from ..sources.lift import table, with_
from .registry import query

NOW = "1998-06-01 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"
NOT_DUE = f"NOT (b.status IN ('pending', 'failed') AND b.next_attempt_at <= {NOW_SQL})"
DUE = f"a.status IN ('pending', 'failed') AND a.next_attempt_at <= {NOW_SQL}"
OPEN = "b.status NOT IN ('sent', 'rejected', 'dead')"


def now(text: str = NOW):
    return F.lit(text).cast("timestamp_ntz")


CLAIMED = ["outbox_id", "source", "message_key", "status", "attempts"]


def _claimed(df: DataFrame) -> DataFrame:
    return df.select("outbox_id", "source", F.coalesce("message_key", F.lit(-1)).alias("message_key"), "status", "attempts")


_SELECT = "SELECT a.outbox_id, a.source, coalesce(a.message_key, -1) AS message_key, 'publishing' AS status, a.attempts + 1 AS attempts FROM outbox a"


@query(with_("outbox") + f"{_SELECT} WHERE {DUE} AND NOT EXISTS (SELECT 1 FROM outbox b WHERE b.source = a.source AND b.message_key = a.message_key AND (b.created_at, b.outbox_id) < (a.created_at, a.outbox_id) AND {OPEN} AND {NOT_DUE})")
def outbox_claim_key(spark: SparkSession, sf: str) -> DataFrame:
    return _claimed(m.claim(lift.outbox(spark, sf), now(), "per-key"))


@query(with_("outbox") + f", w AS (SELECT source, min((created_at, outbox_id)) AS first FROM outbox b WHERE {OPEN} AND {NOT_DUE} GROUP BY 1) {_SELECT} LEFT JOIN w USING (source) WHERE {DUE} AND (w.first IS NULL OR (a.created_at, a.outbox_id) < w.first)")
def outbox_claim_source(spark: SparkSession, sf: str) -> DataFrame:
    return _claimed(m.claim(lift.outbox(spark, sf), now(), "per-source"))


@query(with_("outbox") + f", w AS (SELECT source, message_key, min((created_at, outbox_id)) AS first FROM outbox b WHERE {OPEN} AND {NOT_DUE} AND message_key IS NOT NULL GROUP BY ALL) {_SELECT} LEFT JOIN w USING (source, message_key) WHERE {DUE} AND (w.first IS NULL OR (a.created_at, a.outbox_id) < w.first)")
def outbox_claim_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Stop-the-line claims wait behind the same rows as those by key; they differ in what a failure stops."""
    return _claimed(m.claim(lift.outbox(spark, sf), now(), "stop-the-line"))


@query(with_("outbox") + f"{_SELECT} WHERE {DUE} ORDER BY a.created_at, a.outbox_id LIMIT 200")
def outbox_claim_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _claimed(m.claim(lift.outbox(spark, sf), now(), "best-effort", 200))


_OUTCOME = "CASE outbox_id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' WHEN 2 THEN NULL ELSE 'ok' END"
_RESULT = f""", c AS (SELECT outbox_id, source, message_key, created_at, attempts + 1 AS attempts, coalesce({_OUTCOME}, 'failed') AS told FROM outbox a WHERE message_key IS NOT NULL AND {DUE}),
p AS (SELECT *, CASE WHEN coalesce(max((told = 'failed')::INT) OVER (PARTITION BY source, message_key ORDER BY created_at, outbox_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' ELSE told END AS result FROM c) """


def _published(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("outbox_id") % 10
    outcome = F.when(k == 0, "failed").when(k == 1, "rejected").when(k == 2, F.lit(None).cast("string")).otherwise("ok")
    claimed = m.claim(lift.outbox(spark, sf), now(), "best-effort").filter("message_key is not null")
    return m.publish(claimed, outcome, ["source", "message_key"])


@query(with_("outbox") + _RESULT + "SELECT result, count(*) AS n, min(outbox_id) AS first, max(outbox_id) AS last FROM p GROUP BY 1")
def outbox_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _published(spark, sf).groupBy("result").agg(F.count(F.lit(1)).alias("n"), F.min("outbox_id").alias("first"), F.max("outbox_id").alias("last"))


@query(with_("outbox") + _RESULT + "SELECT outbox_id, CASE WHEN result = 'ok' THEN 'sent' WHEN result = 'rejected' THEN 'rejected' WHEN result = 'skipped' THEN 'failed' WHEN attempts >= 10 THEN 'dead' ELSE 'failed' END AS status, CASE WHEN result = 'skipped' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN result = 'failed' AND attempts < 10 THEN least(60.0, 2.0 * power(2, attempts - 1)) ELSE 0 END::DOUBLE AS wait_s FROM p")
def outbox_marks(spark: SparkSession, sf: str) -> DataFrame:
    return m.mark(_published(spark, sf), 10, now(), 2, 2, 60).select("outbox_id", "status", "attempts", "wait_s")


@query(with_("outbox") + "SELECT outbox_id, CASE WHEN status = 'publishing' AND created_at < TIMESTAMP '1997-01-01' THEN CASE WHEN attempts >= 8 THEN 'dead' ELSE 'failed' END ELSE status END AS status FROM outbox")
def outbox_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    return m.reclaim(lift.outbox(spark, sf), now("1997-01-01 00:00:00"), 8).select("outbox_id", "status")


@query(with_("outbox") + "SELECT status, count(*) AS n, count(*) FILTER (created_at < TIMESTAMP '1996-01-01') AS collectable FROM outbox GROUP BY 1")
def outbox_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return lift.outbox(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at") < now("1996-01-01 00:00:00")).alias("collectable"))


@query("SELECT k AS attempt, least(300.0, 1.5 * power(2.0, k - 1))::DOUBLE AS exponential, 5.0::DOUBLE AS constant FROM range(1, 16) r(k)")
def backoff_schedule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    return spark.range(1, 16).select(k.alias("attempt"), m.delay(k, 1.5, 2, 300).alias("exponential"), m.delay(k, 5, 1, 300).alias("constant"))


@query(with_("inbox") + ", f AS (SELECT *, row_number() OVER (PARTITION BY source, dedupe_key ORDER BY seq) AS k FROM inbox) SELECT source, dedupe_key, quantity, CASE WHEN k > 1 THEN 'batch-duplicate' WHEN source % 10 = 0 THEN 'duplicate' WHEN source % 10 = 1 THEN 'in-progress' WHEN source % 10 = 2 AND dedupe_key >= 3 THEN 'previously-failed' ELSE 'work' END AS plan, CASE WHEN k > 1 THEN 'batch-duplicate' WHEN source % 10 = 0 THEN 'duplicate' WHEN source % 10 = 1 THEN 'in-progress' WHEN source % 10 = 2 THEN 'previously-failed' ELSE 'work' END AS plan_once FROM f")
def inbox_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = lift.inbox(spark, sf)
    k = F.col("source") % 10
    stored = rows.filter(k <= 2).select("source", "dedupe_key").distinct().select("source", "dedupe_key", F.when(k == 0, "completed").when(k == 1, "processing").otherwise("failed").alias("status"), F.col("dedupe_key").alias("attempts"))
    once = m.plan_batch(rows, stored).withColumnRenamed("plan", "plan_once")
    return m.plan_batch(once, stored, 3).select("source", "dedupe_key", "quantity", "plan", "plan_once")


@query(with_("inbox") + "SELECT source, dedupe_key, count(*) FILTER (flag <> 'A') AS attempt_count, CASE WHEN bool_or(flag = 'A') THEN 'completed' WHEN count(*) FILTER (flag <> 'A') >= 2 THEN 'poison' ELSE 'failed' END AS status FROM inbox GROUP BY ALL")
def inbox_failures(spark: SparkSession, sf: str) -> DataFrame:
    return m.failed_attempts(lift.inbox(spark, sf).withColumn("ok", F.col("flag") == "A"), 2)


@query("""WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'm' || event_id END AS mid, CASE WHEN event_id % 4 <> 0 THEN 's' || user_id END AS sid, CASE WHEN event_id % 8 <> 0 THEN event_id + 1 END AS pos, user_id % 8 AS part, CASE WHEN event_id % 5 <> 0 THEN event_id END AS place, repeat('k', (event_id % 4)::INT) AS own FROM events)
SELECT event_id, mid AS message_id, nullif(mid, '') AS by_message, ifnull(sid, pos::VARCHAR) AS by_event, 'events:' || part || ':' || place AS by_position, nullif(own, '') AS by_custom FROM d""")
def inbox_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Null where the policy can't be satisfied."""
    k, user = F.col("event_id"), F.col("user_id")
    message = F.when(k % 3 == 0, "").when(k % 3 == 1, " ").otherwise(F.concat(F.lit("m"), k.cast("string")))
    event = F.when(k % 4 != 0, F.concat(F.lit("s"), user.cast("string")))
    at = (message, event, F.when(k % 8 != 0, k + 1), F.lit("events"), user % 8, F.when(k % 5 != 0, k), F.repeat(F.lit("k"), (k % 4).cast("int")))
    policies = {"message-id": "by_message", "source-event": "by_event", "position": "by_position", "custom": "by_custom"}
    return table(spark, sf, "events").select("event_id", message.alias("message_id"), *[m.dedupe_key(p, *at).alias(name) for p, name in policies.items()])


@query(with_("timers") + f"SELECT timer_id, correlation_id, CASE WHEN attempts + 1 > 6 THEN 'dead' ELSE 'firing' END AS status, attempts + 1 AS attempts, date_diff('second', fire_at, {NOW_SQL})::BIGINT * 1000 AS lag_ms FROM timers WHERE status = 'scheduled' AND fire_at <= {NOW_SQL}")
def timer_claim(spark: SparkSession, sf: str) -> DataFrame:
    found = m.claim_timers(lift.timers(spark, sf), now(), 6)
    return found.select("timer_id", "correlation_id", "status", "attempts", (F.timestamp_diff("SECOND", F.col("fire_at"), now()) * 1000).alias("lag_ms"))


@query(with_("timers") + f"SELECT timer_id, fire_at, attempts + 1 AS attempts FROM timers WHERE status = 'scheduled' AND fire_at <= {NOW_SQL} ORDER BY fire_at, timer_id LIMIT 100")
def timer_drain(spark: SparkSession, sf: str) -> DataFrame:
    return m.claim_timers(lift.timers(spark, sf), now(), 100, 100).select("timer_id", "fire_at", "attempts")


@query(with_("timers") + ", s AS (SELECT timer_id, attempts, CASE WHEN status = 'firing' AND updated_at <= TIMESTAMP '1997-01-01' THEN 'scheduled' ELSE status END AS status FROM timers) SELECT timer_id, status, CASE WHEN status NOT IN ('scheduled', 'firing') THEN status WHEN attempts % 3 = 0 THEN 'cancelled' WHEN attempts % 3 = 2 THEN 'dead' WHEN status = 'firing' THEN 'fired' ELSE status END AS next_status FROM s")
def timer_transitions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("attempts") % 3
    rows = m.requeue_stuck(lift.timers(spark, sf), now("1997-01-01 00:00:00"))
    return m.timer_transition(rows, F.when(k == 0, "cancel").when(k == 1, "fired").otherwise("dead")).select("timer_id", "status", "next_status")


@query("""WITH RECURSIVE w AS (SELECT user_id AS timer_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type, ts FROM events WHERE event_type IN ('view', 'error')),
r AS (SELECT timer_id, 0::BIGINT AS k, NULL::VARCHAR AS status, NULL::TIMESTAMP AS fire_at FROM (SELECT DISTINCT timer_id FROM w)
  UNION ALL SELECT r.timer_id, w.k, CASE WHEN w.event_type = 'view' AND r.status IS NULL THEN 'scheduled' WHEN w.event_type = 'error' AND r.status = 'scheduled' THEN 'fired' ELSE r.status END,
  CASE WHEN w.event_type = 'view' AND (r.status IS NULL OR r.status = 'scheduled') THEN w.ts ELSE r.fire_at END FROM r JOIN w ON w.timer_id = r.timer_id AND w.k = r.k + 1)
SELECT timer_id, max_by(fire_at, k) AS fire_at, max_by(status, k) AS status FROM r GROUP BY 1 HAVING max_by(status, k) IS NOT NULL""")
def timer_rearm(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("event_type in ('view', 'error')")
    # A firing before anything is scheduled does nothing.
    sets = e.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first"))
    writes = e.join(sets, "user_id").filter("event_id >= first")
    return m.schedule(writes.select(F.col("user_id").alias("timer_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "schedule").otherwise("fire").alias("action"), F.col("ts").alias("fire_at")))


@query(with_("timers") + "SELECT timer_id, updated_at, attempts, row_number() OVER (ORDER BY updated_at, timer_id)::INT AS place FROM timers WHERE status = 'firing' AND updated_at <= TIMESTAMP '1997-06-01' AND attempts >= 5 ORDER BY place LIMIT 100")
def timers_stuck(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred longest waiting."""
    page = m.stuck(lift.timers(spark, sf), now("1997-06-01 00:00:00"), 5).limit(100)
    place = F.row_number().over(Window.orderBy("updated_at", "timer_id"))  # a page of a hundred
    return page.select("timer_id", "updated_at", "attempts", place.alias("place"))


Q_NOW = "2024-01-10 00:00:00"


@query(with_("queue") + f"SELECT msg_id, group_key FROM queue WHERE visible_at <= TIMESTAMP '{Q_NOW}' ORDER BY msg_id LIMIT 300")
def queue_read(spark: SparkSession, sf: str) -> DataFrame:
    return m.read_batch(lift.queue(spark, sf), now(Q_NOW), "plain", 300).select("msg_id", "group_key")


@query(with_("queue") + f", v AS (SELECT *, min(msg_id) OVER (PARTITION BY group_key) AS group_head FROM queue WHERE visible_at <= TIMESTAMP '{Q_NOW}') SELECT msg_id, group_key, group_head FROM v ORDER BY group_head, msg_id LIMIT 300")
def queue_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return m.read_batch(lift.queue(spark, sf), now(Q_NOW), "fill", 300).select("msg_id", "group_key", "group_head")


@query(with_("queue") + f", v AS (SELECT *, min(msg_id) OVER (PARTITION BY group_key) AS group_head, row_number() OVER (PARTITION BY group_key ORDER BY msg_id) AS turn FROM queue WHERE visible_at <= TIMESTAMP '{Q_NOW}') SELECT msg_id, group_key, turn::INT AS turn FROM v ORDER BY turn, group_head LIMIT 300")
def queue_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return m.read_batch(lift.queue(spark, sf), now(Q_NOW), "robin", 300).select("msg_id", "group_key", "turn")


@query(with_("queue") + "SELECT msg_id, CASE WHEN read_ct > 5 THEN 'dead-letter' WHEN schema_version > 2 THEN 'retry' WHEN schema_version < 1 THEN 'dead-letter' WHEN kind = 'purchase' THEN 'archive' WHEN kind = 'view' THEN 'retry' WHEN kind = 'error' THEN 'dead-letter' ELSE 'invisible' END AS disposition, CAST(ceil(read_ct * 1.5) AS INT) AS delay_s FROM queue")
def queue_disposition(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.when(F.col("kind") == "purchase", "ok").when(F.col("kind") == "view", "retry").when(F.col("kind") == "error", "poison")
    return lift.queue(spark, sf).select("msg_id", m.disposition(F.col("read_ct"), 5, F.col("schema_version"), 2, outcome).alias("disposition"), m.whole_seconds(F.col("read_ct") * 1.5).alias("delay_s"))


@query(with_("queue") + f"SELECT count(*) AS depth, count(*) FILTER (visible_at <= TIMESTAMP '{Q_NOW}') AS visible, min(enqueued_at) AS oldest, max(read_ct) AS most_reads FROM queue")
def queue_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return lift.queue(spark, sf).agg(F.count(F.lit(1)).alias("depth"), F.count_if(F.col("visible_at") <= now(Q_NOW)).alias("visible"), F.min("enqueued_at").alias("oldest"), F.max("read_ct").alias("most_reads"))


@query(f"SELECT 500000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS msg_id, l_orderkey, l_partkey, {NOW_SQL} + to_seconds(l_linenumber * 60) AS visible_at, 's' || l_suppkey AS group_key FROM lineitem")
def queue_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """One id a payload, in order, with a delay and a FIFO group."""
    order = ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    group = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    sent = m.enqueue(table(spark, sf, "lineitem").select(*order), order, now(), 500_000, (F.col("l_linenumber") * 60).cast("decimal(18,6)"), group)
    return sent.select("msg_id", "l_orderkey", "l_partkey", "visible_at", "group_key")
