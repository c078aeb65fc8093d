"""Durable workflows over a journal of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "cancelled", "failed")


def results(journal: DataFrame) -> DataFrame:
    """Result of each step of each workflow: a later record overwrites. journal: workflow_id, seq, step_name, result."""
    return journal.groupBy("workflow_id", "step_name").agg(F.max_by("result", "seq").alias("result"))


def plan(steps: DataFrame, journal: DataFrame) -> DataFrame:
    """Planned steps against the journal: a recorded one is replayed; an await without a record suspends."""
    rows = steps.join(results(journal), ["workflow_id", "step_name"], "left")
    verdict = F.when(F.col("result").isNotNull(), "replayed").when(F.col("kind") == "await", "suspended").otherwise("executed")
    return rows.withColumn("verdict", verdict)


def status(markers: DataFrame) -> DataFrame:
    """Status at the highest generation: completed, then cancelled, then failed, else running.
    markers: workflow_id, generation, marker (null for an ordinary step)."""
    top = markers.groupBy("workflow_id").agg(F.coalesce(F.max("generation"), F.lit(0)).alias("generation"))
    last = markers.join(top, ["workflow_id", "generation"])
    has = lambda m: F.coalesce(F.bool_or(F.col("marker") == m), F.lit(False))
    value = F.when(has("completed"), "completed").when(has("cancelled"), "cancelled").when(has("failed"), "failed").otherwise("running")
    return last.groupBy("workflow_id", "generation").agg(value.alias("status"))


def append(writes: DataFrame) -> DataFrame:
    """Outcome of journal writes in order (workflow_id, generation, seq, step_name, marker). Each generation has a journal
    of its own; without that column there is one. In it the first marker wins, the same one again is present already, another is refused; a step again is
    present if it was taken, and after a cancellation or failure no new step is."""
    marker = F.min(F.when(F.col("marker").isNotNull(), F.struct("seq", "marker")))
    journal = ["workflow_id", *(["generation"] if "generation" in writes.columns else [])]
    ends = writes.groupBy(*journal).agg(marker.alias("_end"))
    firsts = writes.groupBy(*journal, "step_name").agg(F.min("seq").alias("_first"))
    rows = writes.join(ends, journal).join(firsts, [*journal, "step_name"])
    closed = F.coalesce(F.col("_end.marker").isin("cancelled", "failed") & (F.col("_end.seq") < F.col("_first")), F.lit(False))
    lifecycle = F.when(F.col("seq") == F.col("_end.seq"), "appended").when(F.col("marker") == F.col("_end.marker"), "already-present").otherwise("refused")
    step = F.when(closed, "refused").when(F.col("seq") == F.col("_first"), "appended").otherwise("already-present")
    return rows.withColumn("outcome", F.when(F.col("marker").isNotNull(), lifecycle).otherwise(step)).drop("_end", "_first")


def discover(instances: DataFrame, now: Column) -> DataFrame:
    """Running ones, and suspended ones whose wake time has come."""
    return instances.filter((F.col("status") == "running") | ((F.col("status") == "suspended") & (F.col("wake_after") <= now)))


def claim(instances: DataFrame, now: Column) -> DataFrame:
    """Whether each instance may be claimed, or which refusal holds."""
    refusal = (
        F.when(F.col("status").isin(*TERMINAL), "unavailable").when((F.col("status") == "suspended") & ~F.coalesce(F.col("wake_after") <= now, F.lit(False)), "unavailable")
        .when(F.col("lease_expires_at") > now, "lease-held").when(F.col("next_attempt_at") > now, "paced").otherwise("claimed")
    )
    return instances.withColumn("claim", refusal)


def crash_delay(attempts: Column) -> Column:
    """Seconds before a crashed workflow is tried again, from the attempts before this one."""
    return F.least(F.pow(F.lit(2.0), attempts + 1), F.lit(64.0))


def upsert_instances(writes: DataFrame) -> DataFrame:
    """Instance rows after writes in order (workflow_id, seq, generation, status): frozen at the first terminal one,
    until then the last status and the highest generation."""
    done = writes.filter(F.col("status").isin(*TERMINAL)).groupBy("workflow_id").agg(F.min("seq").alias("_done"))
    live = writes.join(done, "workflow_id", "left").filter("_done is null or seq <= _done")
    return live.groupBy("workflow_id").agg(F.max("generation").alias("generation"), F.max_by("status", "seq").alias("status"), F.max("_done").alias("completed_seq"))


def collectable(instances: DataFrame, children: DataFrame, before: Column, limit: int | None = None) -> DataFrame:
    """Terminal workflows finished by a cutoff of which no parent is still at work, oldest first."""
    busy = instances.filter(~F.col("status").isin(*TERMINAL)).select(F.col("workflow_id").alias("parent_id"))
    held = children.join(busy, "parent_id").select(F.col("child_id").alias("workflow_id"))
    found = instances.filter(F.col("status").isin(*TERMINAL) & (F.col("completed_at") <= before)).join(held, "workflow_id", "left_anti").orderBy("completed_at", "workflow_id")
    return found if limit is None else found.limit(limit)


def without(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after workflows (workflow_id) are deleted with all that depends on them.

    A row goes with the workflow named by ``workflow_id``; of ``children`` with either end, child_id or parent_id; of
    ``timers`` by owner_id, and only timers of sleeping (``kind`` sleep), since others are not the workflow's own.
    """
    ids, out = gone.select("workflow_id").distinct(), {}
    off = lambda df, key: df.join(ids.withColumnRenamed("workflow_id", key), key, "left_anti")
    for name, df in tables.items():
        if name == "children":
            out[name] = off(off(df, "child_id"), "parent_id").select(*df.columns)
        elif name == "timers":
            asleep = df.join(ids.select(F.col("workflow_id").alias("owner_id"), F.lit(True).alias("_gone")), "owner_id", "left")
            out[name] = asleep.filter(~(F.coalesce("_gone", F.lit(False)) & F.col("kind").eqNullSafe(F.lit("sleep")))).select(*df.columns)
        else:
            out[name] = off(df, "workflow_id").select(*df.columns)
    return out


def released(instances: DataFrame, forced: DataFrame) -> DataFrame:
    """Instances after leases are taken away by force; ``freed`` tells where there was one."""
    rows = instances.join(forced.select("workflow_id").distinct().withColumn("_forced", F.lit(True)), "workflow_id", "left")
    freed = F.coalesce(F.col("_forced") & F.col("leased_by").isNotNull(), F.lit(False))
    rows = rows.withColumn("freed", freed).drop("_forced")
    return rows.withColumns({c: F.when(~F.col("freed"), F.col(c)) for c in ("leased_by", "lease_expires_at")})


def spawned(children: DataFrame, requests: DataFrame) -> DataFrame:
    """Children after requests (child_id, parent_id, await_step, seq): the first registers a running child, and one that
    is there already stays what it is."""
    first = requests.groupBy("child_id").agg(F.min_by(F.struct("parent_id", "await_step"), "seq").alias("_r"))
    new = first.join(children.select("child_id"), "child_id", "left_anti").select("child_id", "_r.parent_id", "_r.await_step", F.lit("running").alias("status"), F.lit(None).cast("string").alias("result"))
    return children.select(*new.columns).unionByName(new)


def end_children(children: DataFrame, ends: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children after ends (child_id, seq, status, result), and what goes to the journals of their parents.

    The first end of a running child is its end. It is written as the step that its parent awaits, unless the parent
    (workflow_id, status) has ended, which keeps the child's end but takes no step. A child that had completed before
    gives its stored result again; failed and cancelled ones give nothing more. journal: parent_id, step_name, kind, result.
    """
    first = ends.groupBy("child_id").agg(F.min_by(F.struct("status", "result"), "seq").alias("_end"), F.bool_or(F.col("status") == "completed").alias("_again"))
    rows = children.join(first, "child_id", "left")
    won = (F.col("status") == "running") & F.col("_end").isNotNull()
    rows = rows.withColumn("_won", won).withColumn("_stored", (F.col("status") == "completed") & F.coalesce("_again", F.lit(False)))
    rows = rows.withColumn("result", F.when(won, F.when(F.col("_end.status") == "completed", F.col("_end.result"))).otherwise(F.col("result")))
    rows = rows.withColumn("status", F.when(F.col("_won"), F.col("_end.status")).otherwise(F.col("status")))
    open_ = parents.filter(~F.col("status").isin(*TERMINAL)).select(F.col("workflow_id").alias("parent_id"))
    told = rows.filter("_won or _stored").join(open_, "parent_id", "left_semi")
    return rows.drop("_end", "_again", "_won", "_stored"), told.select("parent_id", F.col("await_step").alias("step_name"), F.col("status").alias("kind"), "result")


def shard_pass(shards: DataFrame, worker: str, now: Column) -> DataFrame:
    """Owners after one worker's pass over the buckets of each subscription: shards (subscription, bucket, owner,
    lease_expires_at).

    It keeps what it owns, even if its lease has run out; below its fair share it claims the lowest bucket that nobody
    holds; above it, unless it is alone, it gives up its highest ones. Live are the owners with a lease beyond ``now``
    and the worker itself. Windows by subscription: its buckets are as many as were configured.
    """
    mine = F.col("owner").eqNullSafe(F.lit(worker))
    live = F.size(F.array_distinct(F.array_append(F.coalesce("_live", F.array().cast("array<string>")), F.lit(worker))))
    per = shards.groupBy("subscription").agg(
        F.collect_set(F.when(F.col("lease_expires_at") > now, F.col("owner"))).alias("_live"), F.count(F.lit(1)).alias("_n"), F.count_if(mine).alias("_held"),
        F.min(F.when(F.col("owner").isNull() | (~mine & (F.col("lease_expires_at") < now)), F.col("bucket"))).alias("_free"),
    )
    per = per.withColumn("_workers", live).withColumn("_share", fair_share(F.col("_n"), F.col("_workers")))
    rows = shards.join(per, "subscription")
    owned = mine | ((F.col("_held") < F.col("_share")) & (F.col("bucket") == F.col("_free")))
    rows = rows.withColumn("_owned", F.coalesce(owned, F.lit(False)))
    place = F.count_if("_owned").over(Window.partitionBy("subscription").orderBy("bucket"))
    kept = F.col("_owned") & ((F.col("_workers") <= 1) | (place <= F.col("_share")))
    return rows.select("subscription", "bucket", F.when(kept, worker).when(~F.col("_owned"), F.col("owner")).alias("owner"))


def child_outcomes(children: DataFrame, instances: DataFrame) -> DataFrame:
    """What each parent's await of a child gives: its result, a failure, a cancellation, or nothing yet."""
    rows = children.join(instances.select(F.col("workflow_id").alias("child_id"), F.col("status").alias("child_status")), "child_id", "left")
    gives = F.when(F.col("child_status") == "completed", "result").when(F.col("child_status") == "failed", "failure").when(F.col("child_status") == "cancelled", "cancellation").otherwise("pending")
    return rows.withColumn("gives", gives)


def signal(awakeables: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals against awakeables: cancelled ones answer false; completed ones journal the stored payload again and
    answer false; pending ones complete, journal and answer true. The first signal in order wins."""
    first = signals.groupBy("awakeable_id").agg(F.min("seq").alias("_first"), F.min_by("payload", "seq").alias("_won"))
    rows = signals.join(awakeables.select("awakeable_id", "status", F.col("payload").alias("stored")), "awakeable_id").join(first, "awakeable_id")
    won = (F.col("status") == "pending") & (F.col("seq") == F.col("_first"))
    journaled = F.when(F.col("status") == "cancelled", F.lit(None).cast("string")).when(F.col("status") == "completed", F.col("stored")).otherwise(F.col("_won"))
    return rows.select("awakeable_id", "seq", won.alias("accepted"), journaled.alias("journaled"))


def cancel_awakeables(awakeables: DataFrame, wanted: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cancellations (awakeable_id) against awakeables (awakeable_id, owner, status): only a pending one is cancelled, once;
    ``accepted`` tells. Its owner runs again to see it, at the generation it is in, unless it has ended."""
    asked = wanted.select("awakeable_id").distinct().withColumn("_asked", F.lit(True))
    accepted = F.coalesce(F.col("_asked") & (F.col("status") == "pending"), F.lit(False))
    rows = awakeables.join(asked, "awakeable_id", "left").withColumn("accepted", accepted).drop("_asked")
    rows = rows.withColumn("status", F.when(F.col("accepted"), "cancelled").otherwise(F.col("status")))
    woken = rows.filter("accepted").select(F.col("owner").alias("workflow_id")).distinct().withColumn("_woken", F.lit(True))
    status = F.when(F.col("_woken") & ~F.col("status").isin(*TERMINAL), "running").otherwise(F.col("status"))
    return rows, instances.join(woken, "workflow_id", "left").withColumn("status", status).drop("_woken")


def patched(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patch decisions: a recorded one is frozen, else whether the id is in the recorded set."""
    rows = requests.join(decisions.select("workflow_id", "patch", F.col("decision").alias("_old")), ["workflow_id", "patch"], "left")
    return rows.withColumn("decision", F.coalesce("_old", F.array_contains("patches", F.col("patch")))).drop("_old")


def fair_share(buckets: Column, workers: Column) -> Column:
    """Buckets that each of the live workers should own."""
    return F.ceil(buckets / F.greatest(workers, F.lit(1))).cast("int")


def transition(status: Column, action: Column) -> Column:
    """Operator actions: resurrect a failed one, cancel one at work; anything else is refused (null)."""
    return F.when((action == "resurrect") & (status == "failed"), "running").when((action == "cancel") & status.isin("running", "suspended"), "cancelled")


def arbitrate(resolved: Column, abandoned: Column) -> Column:
    return F.when(resolved | abandoned, "running").otherwise("suspended")
