"""Outbox, inbox, timers and queues as next-state transforms. ``now`` is always a parameter.

Ordering rules come down to the first row of a key that blocks or fails: an aggregate and an equi-join, neither a
theta join nor a window that would put a hot key into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due(now: Column) -> Column:
    return F.col("status").isin("pending", "failed") & (F.col("next_attempt_at") <= now)


def _before(at: str) -> Column:
    """Whether a row comes before the place ``at`` (created_at, outbox_id), if there is one."""
    return F.col(at).isNull() | (F.struct("created_at", "outbox_id") < F.col(at))


def _with_first(rows: DataFrame, keys: list[str], which: Column, name: str) -> DataFrame:
    """Adds the first place among the rows of each key for which a condition holds.

    An aggregate that combines on the map side and a join that can be split: unlike a window, it holds for a key
    of any size.
    """
    first = rows.filter(which).groupBy(*keys).agg(F.min(F.struct("created_at", "outbox_id")).alias(name))
    return rows.join(first, keys, "left")


def claim(outbox: DataFrame, now: Column, policy: str, limit: int | None = None) -> DataFrame:
    """Rows that a publisher may claim at ``now``, oldest first.

    Under key and stop-the-line order a row waits while an earlier row of its (source, key) isn't finished and isn't
    itself due, that is, only what comes before the key's first such row goes; under source order the same by source;
    best effort blocks nothing, and neither does a row without a key.
    """
    if policy not in ("per-key", "stop-the-line", "per-source", "best-effort"):
        raise ValueError(policy)
    rows = outbox.filter(~F.col("status").isin("sent", "rejected", "dead"))
    if policy == "best-effort":
        found = rows.filter(due(now))
    else:
        keys = ["source"] if policy == "per-source" else ["source", "message_key"]
        found = _with_first(rows, keys, ~due(now), "_block").filter(due(now))
        free = _before("_block") if policy == "per-source" else F.col("message_key").isNull() | _before("_block")
        found = found.filter(free).drop("_block").select(*outbox.columns)
    found = found.withColumn("status", F.lit("publishing")).withColumn("attempts", F.col("attempts") + 1)
    return found.orderBy("created_at", "outbox_id") if limit is None else found.orderBy("created_at", "outbox_id").limit(limit)


def publish(claimed: DataFrame, outcome: Column, group: list[str]) -> DataFrame:
    """Results of a publish pass: after the first failure in a group the rest of it is skipped; a missing outcome is
    a failure; a rejection stops nothing."""
    rows = _with_first(claimed.withColumn("_told", F.coalesce(outcome, F.lit("failed"))), group, F.col("_told") == "failed", "_stop")
    after = F.col("_stop").isNotNull() & (F.struct("created_at", "outbox_id") > F.col("_stop"))
    return rows.select(*claimed.columns, F.when(after, "skipped").otherwise(F.col("_told")).alias("result"))


def mark(published: DataFrame, most: int, now: Column, base: float, factor: float, ceiling: float) -> DataFrame:
    """Next state after a pass; a skipped row gets its attempt back, a failed one waits or is dead."""
    r, a = F.col("result"), F.col("attempts")
    failed = r == "failed"
    status = F.when(r == "ok", "sent").when(r == "rejected", "rejected").when(r == "skipped", "failed").when(failed & (a >= most), "dead").otherwise("failed")
    wait = delay(a, base, factor, ceiling)
    return published.withColumn("status", status).withColumn("attempts", F.when(r == "skipped", F.greatest(a - 1, F.lit(0))).otherwise(a)).withColumn("wait_s", F.when(failed & (a < most), wait).otherwise(F.lit(0.0)))


def delay(attempt: Column, base: float, factor: float, ceiling: float) -> Column:
    """Exponential backoff in seconds; factor 1 is constant."""
    return F.least(F.lit(float(ceiling)), F.lit(float(base)) * F.pow(F.lit(float(factor)), attempt - 1))


def reclaim(outbox: DataFrame, stale_before: Column, most: int) -> DataFrame:
    """Maintenance: rows stuck in publishing become dead or failed."""
    stale = (F.col("status") == "publishing") & (F.col("created_at") < stale_before)
    return outbox.withColumn("status", F.when(stale & (F.col("attempts") >= most), "dead").when(stale, "failed").otherwise(F.col("status")))


def plan_batch(deliveries: DataFrame, existing: DataFrame | None = None, ceiling: int | None = None) -> DataFrame:
    """Of deliveries (source, dedupe_key, seq) the plan: key-error, duplicate within the batch (the first works),
    duplicate of something stored, or work. Stored rows: source, dedupe_key, status, attempts. ceiling: attempts up to
    which a failed row is tried again; without one it never is."""
    first = deliveries.filter("dedupe_key is not null").groupBy("source", "dedupe_key").agg(F.min("seq").alias("first"))
    rows = deliveries.join(first, ["source", "dedupe_key"], "left")
    plan = F.when(F.col("dedupe_key").isNull(), "key-error").when(F.col("seq") != F.col("first"), "batch-duplicate")
    if existing is not None:
        rows = rows.join(existing.select("source", "dedupe_key", F.col("status").alias("have"), F.col("attempts").alias("tries")), ["source", "dedupe_key"], "left")
        plan = plan.when(F.col("have") == "completed", "duplicate").when(F.col("have") == "processing", "in-progress").when((F.col("have") == "failed") & (F.lit(True) if ceiling is None else F.col("tries") >= ceiling), "previously-failed")
    return rows.withColumn("plan", plan.otherwise("work")).drop("first", "have", "tries")


def dedupe_key(
    policy: str, message_id: Column, source_event: Column, source_position: Column, topic: Column, part: Column, offset: Column, custom: Column | None = None
) -> Column:
    """Key of a delivery under a policy; null if it can't be told.

    message-id: the id, unless it is empty; source-event: the source's event id, else its global position; position:
    where it was delivered; custom: a key that the caller makes, unless it is empty. Nothing is trimmed.
    """
    given = lambda c: F.when(F.length(c) > 0, c)
    if policy == "message-id":
        return given(message_id)
    if policy == "source-event":
        return F.coalesce(source_event, source_position.cast("string"))
    if policy == "position":
        return F.concat(topic, F.lit(":"), part.cast("string"), F.lit(":"), offset.cast("string"))
    if policy == "custom" and custom is not None:
        return given(custom)
    raise ValueError(policy)


def failed_attempts(attempts: DataFrame, ceiling: int) -> DataFrame:
    """Attempts (source, dedupe_key, ok, seq) folded: status and count; poison at the ceiling. A success completes."""
    n = attempts.groupBy("source", "dedupe_key").agg(F.count_if(~F.col("ok")).alias("attempt_count"), F.bool_or("ok").alias("done"))
    status = F.when(F.col("done"), "completed").when(F.col("attempt_count") >= ceiling, "poison").otherwise("failed")
    return n.select("source", "dedupe_key", "attempt_count", status.alias("status"))


def claim_timers(timers: DataFrame, now: Column, ceiling: int, limit: int | None = None) -> DataFrame:
    """Due scheduled timers, claimed; one that was tried too often is dead instead."""
    found = timers.filter((F.col("status") == "scheduled") & (F.col("fire_at") <= now)).withColumn("attempts", F.col("attempts") + 1)
    found = found.withColumn("status", F.when(F.col("attempts") > ceiling, "dead").otherwise("firing"))
    found = found.orderBy("fire_at", "timer_id")
    return found if limit is None else found.limit(limit)


def requeue_stuck(timers: DataFrame, stuck_before: Column) -> DataFrame:
    stuck = (F.col("status") == "firing") & (F.col("updated_at") <= stuck_before)
    return timers.withColumn("status", F.when(stuck, "scheduled").otherwise(F.col("status")))


def stuck(timers: DataFrame, since: Column | None = None, attempts: int | None = None) -> DataFrame:
    """Timers that were claimed and not finished, the longest waiting first; each condition only where it is given."""
    found = timers.filter(F.col("status") == "firing")
    if since is not None:
        found = found.filter(F.col("updated_at") <= since)
    if attempts is not None:
        found = found.filter(F.col("attempts") >= attempts)
    return found.orderBy("updated_at", "timer_id")


def timer_transition(timers: DataFrame, action: Column) -> DataFrame:
    """cancel and dead: scheduled or firing; fired: firing only; anything else changes nothing."""
    s = F.col("status")
    new = F.when((action == "cancel") & s.isin("scheduled", "firing"), "cancelled").when((action == "fired") & (s == "firing"), "fired").when((action == "dead") & s.isin("scheduled", "firing"), "dead").otherwise(s)
    return timers.withColumn("next_status", new)


def schedule(writes: DataFrame) -> DataFrame:
    """Schedule and fire commands (timer_id, seq, action, fire_at) in order: a schedule re-arms only while the timer
    is scheduled, so what counts is the last schedule before the first firing."""
    fired = writes.filter("action = 'fire'").groupBy("timer_id").agg(F.min("seq").alias("fired"))
    sets = writes.filter("action = 'schedule'").join(fired, "timer_id", "left")
    first = sets.groupBy("timer_id").agg(F.min("seq").alias("first"))
    sets = sets.join(first, "timer_id").filter("fired is null or seq < fired or (seq = first and fired < first)")
    last = sets.groupBy("timer_id", "fired", "first").agg(F.max_by("fire_at", "seq").alias("fire_at"))
    return last.select("timer_id", "fire_at", F.when(F.col("fired") > F.col("first"), "fired").otherwise("scheduled").alias("status"))


def read_batch(queue: DataFrame, now: Column, mode: str, size: int) -> DataFrame:
    """Visible messages: plain by id; ``fill`` from the oldest group first; ``robin`` one of each group by turns."""
    seen = queue.filter(F.col("visible_at") <= now)
    if mode == "plain":
        return seen.orderBy("msg_id").limit(size)
    heads = seen.groupBy("group_key").agg(F.min("msg_id").alias("group_head"))
    if mode == "fill":
        # the oldest groups that hold ``size`` messages between them: at most ``size`` groups matter
        return seen.join(F.broadcast(heads.orderBy("group_head").limit(size)), "group_key").orderBy("group_head", "msg_id").limit(size)
    turn = F.row_number().over(Window.partitionBy("group_key").orderBy("msg_id"))
    return seen.withColumn("turn", turn).join(heads, "group_key").orderBy("turn", "group_head").limit(size)


def redrive(dead: DataFrame, readable: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Up to ``most`` of the oldest dead letters whose envelope can be read, as messages that begin anew, and what stays.
    One that can't be read stays, and is no reason to stop."""
    moved = dead.filter(readable).orderBy("msg_id").limit(most)
    return moved.withColumn("read_ct", F.lit(0)), dead.join(moved.select("msg_id"), "msg_id", "left_anti")


def archive(dead: DataFrame, now: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Up to ``most`` of the oldest dead letters, kept as they are with the time of archiving, and what stays."""
    moved = dead.orderBy("msg_id").limit(most)
    return moved.withColumn("archived_at", now), dead.join(moved.select("msg_id"), "msg_id", "left_anti")


def purge(dead: DataFrame) -> DataFrame:
    return dead.limit(0)


def disposition(read_ct: Column, most: int, version: Column, known: int, outcome: Column) -> Column:
    """Too many reads go to the dead letters before anything is decoded; a payload from the future is retried."""
    return F.when(read_ct > most, "dead-letter").when(version > known, "retry").when(version < 1, "dead-letter").when(outcome == "ok", "archive").when(outcome == "retry", "retry").when(outcome == "poison", "dead-letter").otherwise("invisible")


def whole_seconds(delay_s: Column) -> Column:
    """A retry delay as the queue takes it: rounded up, within int32."""
    return F.least(F.greatest(F.ceil(delay_s), F.lit(0)), F.lit(2147483647)).cast("int")


def enqueue(payloads: DataFrame, order: list[str], now: Column, head: int = 0, delay_s: Column | None = None, group: Column | None = None) -> DataFrame:
    """New messages in the order of the input, one id each after the queue's head; visible after a delay, with a group
    for FIFO reads if one is given."""
    from ..sources.numbering import numbered

    rows = numbered(payloads, "msg_id", *order, first=head + 1)
    visible = now if delay_s is None else now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay_s)
    return rows.withColumn("enqueued_at", now).withColumn("visible_at", visible).withColumn("read_ct", F.lit(0)).withColumn("group_key", F.lit(None).cast("string") if group is None else group)
