"""Read models: projections with deduplication and fences, freshness, registry lifecycle, guarded reads, rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a group in a status allows: (reads, writes); fixed values.
AVAILABILITY = {
    "live": (True, True), "serving-versioned": (True, True), "rebuilding-versioned": (True, True), "cutover": (True, False),
    "failed-versioned": (True, False), "rebuilding": (False, False), "failed": (False, False),
}
#: Status that a transition puts a registered model in, whatever it was in before; fixed values.
TRANSITIONS = {"rebuild": "rebuilding", "finish": "live", "abandon": "abandoned"}


def lookup(pairs: dict, *columns: Column, default: Column | None = None) -> Column:
    """A finite total map as a CASE."""
    out = default if default is not None else F.lit(None)
    for key, value in pairs.items():
        parts = key if isinstance(key, tuple) else (key,)
        hit = F.lit(True)
        for c, part in zip(columns, parts, strict=True):
            hit = hit & (c == part)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def availability(status: Column) -> tuple[Column, Column]:
    return lookup({k: v[0] for k, v in AVAILABILITY.items()}, status, default=F.lit(False)), lookup({k: v[1] for k, v in AVAILABILITY.items()}, status, default=F.lit(False))


def registry(writes: DataFrame) -> DataFrame:
    """Registry rows after writes in order (name, seq, at, action, version, shape).

    A registration inserts a live row and leaves one that is there alone; a transition puts its status, version and
    shape in, whatever they were before, and inserts the row where there is none. What counts is the last transition,
    or else the first registration. A row is stamped as built when it is inserted and whenever it becomes live.
    """
    moves = writes.filter(F.col("action").isin(*TRANSITIONS))
    last = moves.groupBy("name").agg(F.max_by(F.struct("action", "version", "shape"), "seq").alias("_last"))
    first = writes.groupBy("name").agg(F.min_by(F.struct("action", "version", "shape", "at"), "seq").alias("_first"))
    live = moves.filter(F.col("action") == "finish").groupBy("name").agg(F.max_by("at", "seq").alias("_live"))
    rows = first.join(last, "name", "left").join(live, "name", "left")
    status = F.coalesce(lookup(TRANSITIONS, F.col("_last.action"), default=F.lit(None).cast("string")), F.lit("live"))
    return rows.select(
        "name", status.alias("status"), F.coalesce("_last.version", "_first.version").alias("version"), F.coalesce("_last.shape", "_first.shape").alias("shape"),
        F.coalesce("_live", "_first.at").alias("last_built_at"),
    )


def apply_async(events: DataFrame, applied: DataFrame, key: str, fenced: Column) -> DataFrame:
    """Outcome of each delivery of an at-least-once source: duplicate of an applied or earlier one, fenced, or applied.
    events: key, seq; applied: key."""
    first = events.groupBy(key).agg(F.min("seq").alias("_first"))
    seen = applied.select(key).distinct().withColumn("_seen", F.lit(True))
    rows = events.join(seen, key, "left").join(first, key)
    outcome = F.when(fenced, "fenced").when(F.col("_seen") | (F.col("seq") > F.col("_first")), "duplicate").otherwise("applied")
    return rows.withColumn("outcome", outcome).drop("_seen", "_first")


def query_error(version: Column, shape: Column, status: Column, want_version: Column, want_shape: Column) -> Column:
    """Why a model's query is refused, checked in this order; null if it may run."""
    return F.when(version.isNull(), "unregistered").when(version != want_version, "stale-version").when(shape != want_shape, "stale-shape").when(status != "live", "not-live")


def freshness(mode: Column, floor: Column, head: Column, target: Column) -> Column:
    """Whether a reader need not wait any longer, or what is missing."""
    wait = F.when(floor.isNull(), "no-cursor").when(floor >= F.when(mode == "head", head).otherwise(target), "fresh").otherwise("waiting")
    return F.when(mode == "immediate", "fresh").when((mode == "position") & target.isNull(), "no-position").otherwise(wait)


def read_guard(rows: DataFrame, most: int) -> DataFrame:
    """Error code of a guarded external read, checked in the contract's order; null if it may run.
    rows: contract, grp, status, epoch, want_epoch, revision_ok, shape_ok, n_rows."""
    reads, _ = availability(F.col("status"))
    code = (
        F.when(F.col("contract").isNull(), "KR002").when(F.col("grp").isNull(), "KR002").when(F.col("contract") == "retired", "KR002")
        .when(F.col("epoch") != F.col("want_epoch"), "KR001").when(~reads, "KR001").when(F.col("contract") != "active", "KR003")
        .when(~F.col("revision_ok") | ~F.col("shape_ok"), "KR003").when(F.col("n_rows") > most, "KR004")
    )
    return rows.withColumn("code", code)


def group_floor(groups: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Conservative floor of each group over the subscriptions it names, null while one of them has no checkpoint.
    groups: grp, names (array); checkpoints: name, member, position."""
    wanted = groups.select("grp", F.size("names").alias("n_names"), F.explode_outer("names").alias("name"))
    low = checkpoints.groupBy("name").agg(F.min("position").alias("low"))
    per = wanted.join(low, "name", "left").groupBy("grp", "n_names").agg(F.count_distinct(F.when(F.col("low").isNotNull(), F.col("name"))).alias("have"), F.min("low").alias("low"))
    return per.select("grp", F.when((F.col("have") == F.col("n_names")) & (F.col("n_names") > 0), F.col("low")).alias("floor"))


def group_status(groups: DataFrame, cursors: DataFrame, checkpoints: DataFrame, runs: DataFrame, sources: DataFrame, models: DataFrame) -> DataFrame:
    """What a reader from outside may know of each group; a group is there whatever else is missing.

    groups: grp, status, reads, active_run; cursors: grp, basis, names (array); checkpoints: name, member, position;
    runs: run, captured_head; sources: run, source, position; models: name, grp. The served position is the floor of
    the subscriptions named, where reads are allowed and the group has checkpoints; a run is as far as its last source.
    """
    floors = group_floor(cursors.select("grp", "names"), checkpoints)
    progress = sources.groupBy("run").agg(F.min("position").alias("rebuild_position"))
    per = models.groupBy("grp").agg(F.sort_array(F.collect_list("name")).alias("models"))
    rows = groups.join(cursors.select("grp", "basis"), "grp", "left").join(floors, "grp", "left")
    rows = rows.join(runs.withColumnRenamed("run", "active_run"), "active_run", "left").join(progress.withColumnRenamed("run", "active_run"), "active_run", "left")
    rows = rows.join(per, "grp", "left")
    served = F.when(F.col("reads") & (F.col("basis") == "checkpoint"), F.col("floor"))
    # Progress belongs to a run that is known.
    position = F.when(F.col("captured_head").isNotNull(), F.col("rebuild_position"))
    return rows.select(
        "grp", "status", "reads", F.coalesce("basis", F.lit("unmanaged")).alias("basis"), served.alias("applied_position"), "active_run",
        position.alias("rebuild_position"), F.col("captured_head").alias("rebuild_head"), F.coalesce("models", F.array().cast("array<string>")).alias("models"),
    )


def completion(sources: DataFrame, adapters: DataFrame, verifications: DataFrame, expected: DataFrame) -> DataFrame:
    """Proof that a run may be promoted: as many rows as expected, and none unfinished."""
    s = sources.groupBy("run").agg(F.count(F.lit(1)).alias("sources"), F.bool_and("complete").alias("s_ok"))
    a = adapters.groupBy("run").agg(F.count(F.lit(1)).alias("adapters"), F.bool_and("complete").alias("a_ok"))
    v = verifications.groupBy("run").agg(F.count(F.lit(1)).alias("verifications"), F.bool_and("passed").alias("v_ok"))
    all_ = expected.join(s, "run", "left").join(a, "run", "left").join(v, "run", "left")
    proof = F.coalesce((F.col("sources") == F.col("want_sources")) & (F.col("adapters") == F.col("want_adapters")) & (F.col("verifications") == F.col("want_verifications")) & F.col("s_ok") & F.col("a_ok") & F.col("v_ok"), F.lit(False))
    return all_.select("run", proof.alias("proven"))


def dedup_backfill(log: DataFrame, floors: DataFrame, head: int) -> DataFrame:
    """Events in (floor, head] of each subscription's category, so that a redelivery after promotion is a duplicate.
    floors: subscription, category, floor."""
    near = log.filter(F.col("global_position") <= head).join(F.broadcast(floors), "category")  # a row a subscription of the catalog
    return near.filter(F.col("global_position") > F.col("floor")).select("subscription", "stream_name", "global_position")


def reproject(targets: DataFrame, key: str, fresh: DataFrame, streams: list[str] | DataFrame) -> DataFrame:
    """Targets with the rows of some streams cleared and put anew."""
    if isinstance(streams, DataFrame):
        rest = targets.join(streams, key, "left_anti")
    else:
        rest = targets.filter(~F.col(key).isin(streams))
    return rest.unionByName(fresh)


def admission(staged: Column, threshold: int, specs: Column, limit: int) -> Column:
    """Whether a cutover may begin: what is staged plus the most that may still arrive fits the limit."""
    return staged + F.lit(threshold) * specs <= limit


def next_phase(complete: Column, visible: Column, captured: Column, threshold: int, admitted: Column, fenced: Column, status: Column) -> Column:
    """The one step that a versioned rebuild takes next."""
    return (
        F.when(status == "promoted", "report").when(status.isin("failed", "abandoned"), "refuse").when(~complete, "replay")
        .when(fenced, "prepare-and-promote").when(visible - captured > threshold, "extend-head").when(admitted, "fence").otherwise("wait-for-admission")
    )


def begin_rebuild(groups: DataFrame, want: DataFrame) -> DataFrame:
    """Whether a group's rebuild may begin, and its status then: its slice is the one wanted, and it is live or failed.
    groups: grp, status, slice, checkpoints_ok; want: grp, want_slice."""
    rows = want.join(groups.withColumn("_there", F.lit(True)), "grp", "left")
    outcome = (
        F.when(F.col("_there").isNull(), "unregistered").when(~F.col("slice").eqNullSafe(F.col("want_slice")), "slice-drift")
        .when(~F.col("status").isin("live", "failed"), "not-live").when(~F.col("checkpoints_ok"), "missing-checkpoint").otherwise("begun")
    )
    return rows.select("grp", outcome.alias("outcome"), F.when(outcome == "begun", "rebuilding").otherwise(F.col("status")).alias("status"))


def begun(outcomes: DataFrame, targets: DataFrame, dedup: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables after ``begin_rebuild``: of each group that has begun the targets are cleared, what its projections
    have applied is forgotten, and their checkpoints go back to 0. All tables: grp; checkpoints: position too."""
    go = outcomes.filter("outcome = 'begun'").select("grp")
    reset = checkpoints.join(go.withColumn("_go", F.lit(True)), "grp", "left")
    position = F.when(F.col("_go"), F.lit(0)).otherwise(F.col("position"))
    return targets.join(go, "grp", "left_anti"), dedup.join(go, "grp", "left_anti"), reset.withColumn("position", position).drop("_go")


def resume(asked: DataFrame, runs: DataFrame, groups: DataFrame, contracts: DataFrame) -> DataFrame:
    """Whether a run that stopped goes on, or why not, in the order of the checks.

    asked: run; runs: run, grp, status, contract, slice (null for one from before slices were kept); groups: grp, status,
    active_run, slice; contracts: grp, contract, as the catalog has it now. Only a running or failed run resumes, that
    its group, still rebuilding, takes for the active one with the slice that the run began with.
    """
    now_ = contracts.select("grp", F.col("contract").alias("_now"))
    state = groups.select("grp", F.col("status").alias("_group"), F.col("active_run").alias("_active"), F.col("slice").alias("_slice"))
    rows = asked.join(runs.withColumn("_there", F.lit(True)), "run", "left").join(now_, "grp", "left").join(state, "grp", "left")
    holds = F.col("status").isin("running", "failed") & (F.col("_group") == "rebuilding") & (F.col("_active") == F.col("run")) & (F.col("_slice") == F.col("slice"))
    outcome = (
        F.when(F.col("_there").isNull(), "not-found").when(F.col("slice").isNull(), "pre-canonical").when(F.col("_now").isNull(), "group-missing")
        .when(F.col("_now") != F.col("contract"), "contract-mismatch").when(F.coalesce(holds, F.lit(False)), "resumed").otherwise("not-active")
    )
    return rows.select("run", "grp", outcome.alias("outcome"))


def remaining(resumed: DataFrame, sources: DataFrame, log: DataFrame) -> DataFrame:
    """Events that resumed runs have still to replay: of each source (run, category, cursor, captured_head) what lies
    beyond its cursor, up to the head captured when the run began."""
    go = sources.join(resumed.filter("outcome = 'resumed'").select("run"), "run", "left_semi").filter("cursor < captured_head")
    return log.join(go, "category").filter("global_position > cursor and global_position <= captured_head").select("run", "category", "global_position")


def rebuild(targets: DataFrame, log: DataFrame, head: int, adapters: list, policy: str) -> DataFrame:
    """Targets (key, value) rebuilt from the events up to a captured head, which is never extended.

    adapters: functions from events to rows (key, value, global_position), applied in the order given; on one event a
    later adapter writes after an earlier one. ``clear`` starts from nothing, ``preserve`` from what is there, so a row
    without history stays. Last writers by an aggregate, so that a key of any size combines on the map side.
    """
    if policy not in ("clear", "preserve"):
        raise ValueError(policy)
    events = log.filter(F.col("global_position") <= head)
    writes = None
    for ordinal, adapter in enumerate(adapters):
        rows = adapter(events).select("key", "value", F.struct(F.col("global_position"), F.lit(ordinal).alias("ordinal")).alias("at"))
        writes = rows if writes is None else writes.unionByName(rows)
    made = writes.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    if policy == "clear":
        return made
    return targets.select("key", "value").join(made.select("key"), "key", "left_anti").unionByName(made)


def summary(events: DataFrame, key: str) -> DataFrame:
    """Rows made and changed by events (key, position, made, status, value): one that makes puts a row with its value in,
    whatever was there; any other sets the status of a row that is there and does nothing where there is none. So
    there is a row for each key that was made once, with the value of the last making and the status of the last event:
    what comes after a making never misses the row."""
    at = F.max_by(F.struct("status", "position"), "position")
    rows = events.groupBy(key).agg(F.max_by("value", F.when(F.col("made"), F.col("position"))).alias("value"), at.alias("_last"), F.bool_or("made").alias("_made"))
    return rows.filter("_made").select(key, "value", "_last.status", F.col("_last.position").alias("last_seen"))


def reproject_refusal(requests: DataFrame, streams: DataFrame, events: DataFrame, most: int) -> DataFrame:
    """Why a stream can't be projected anew, in the order of the checks; null if it can.

    requests: stream; streams: stream, deleted (null where it isn't), truncate_before, version; events: stream,
    stream_version, foreign. A stream without a row has no history; one with holes is incomplete.
    """
    seen = events.groupBy("stream").agg(F.count_distinct("stream_version").alias("_n"), F.max("stream_version").alias("_last"), F.min(F.when(F.col("foreign"), F.col("stream_version"))).alias("_foreign"))
    rows = requests.join(streams.withColumn("_there", F.lit(True)), "stream", "left").join(seen, "stream", "left")
    n, last = F.coalesce("_n", F.lit(0)), F.coalesce("_last", F.lit(0))
    refusal = (
        F.when(F.col("_there").isNull(), "history-unavailable").when(F.col("deleted").isNotNull(), "soft-deleted").when(F.col("truncate_before") > 0, "truncated")
        .when(F.col("version") > most, "event-limit").when(F.col("_foreign").isNotNull(), "foreign-event").when((last != F.col("version")) | (n != F.col("version")), "history-incomplete")
    )
    return rows.select("stream", refusal.alias("refusal"), F.col("_foreign").alias("foreign_version"))


def pruned(staged: DataFrame, floors: DataFrame) -> DataFrame:
    """Staged rows (run, subscription, position, ...) beyond the floor of their subscription, or of one without a floor."""
    low = floors.groupBy("run", "subscription").agg(F.max("position").alias("_floor"))
    return staged.join(low, ["run", "subscription"], "left").filter("_floor is null or position > _floor").drop("_floor")


def prepare(runs: DataFrame, staged: DataFrame, declared: DataFrame, generations: DataFrame, verifications: DataFrame) -> DataFrame:
    """Whether each run may be promoted, or the first of the checks that it fails.

    runs: run, ready, dedup_limit, serving, checkpoints_ok; staged: run (already ``pruned``); declared: run, side, target,
    as the two revisions name them; generations: run, side, target, lifecycle, identity_ok, shape_ok; verifications:
    run, passed. side is serving or candidate. Both revisions name the same targets, and each has its generations.
    """
    count = staged.groupBy("run").agg(F.count(F.lit(1)).alias("_staged"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    life = F.when(F.col("side") == "serving", "serving").otherwise("staging")
    of = declared.select("run", "target", "side", F.lit(True).alias("_declared"), *[F.lit(None).cast("boolean").alias(c) for c in ("_made", "_life", "identity_ok", "shape_ok")])
    have = generations.select("run", "target", "side", F.lit(False).alias("_declared"), F.lit(True).alias("_made"), (F.col("lifecycle") == life).alias("_life"), "identity_ok", "shape_ok")
    flags = [some((F.col("side") == s) & F.coalesce(F.col(c), F.lit(False))).alias(f"{s}{c}") for s in ("serving", "candidate") for c in ("_declared", "_made")]
    every = lambda c: F.coalesce(F.bool_and(c), F.lit(True)).alias(c)
    per = of.unionByName(have).groupBy("run", "target").agg(*flags, every("_life"), every("identity_ok"), every("shape_ok"))
    paired = (F.col("serving_declared") == F.col("candidate_declared")) & (F.col("serving_made") == F.col("serving_declared")) & (F.col("candidate_made") == F.col("candidate_declared"))
    per = per.withColumn("_paired", paired).groupBy("run").agg(every("_paired"), every("_life"), every("identity_ok"), every("shape_ok"))
    proof = verifications.groupBy("run").agg(every("passed"))
    rows = runs.join(count, "run", "left").join(per, "run", "left").join(proof, "run", "left")
    fails = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    outcome = (
        F.when(~F.col("ready"), "not-ready").when(F.coalesce("_staged", F.lit(0)) > F.col("dedup_limit"), "dedup-limit").when(F.col("serving").isNull(), "no-serving-revision")
        .when(fails("_paired"), "targets-differ").when(fails("_life"), "wrong-lifecycle").when(fails("identity_ok"), "identity-changed").when(fails("shape_ok"), "shape-changed")
        .when(fails("passed"), "verification-failed").when(~F.col("checkpoints_ok"), "missing-checkpoint").otherwise("prepared")
    )
    return rows.select("run", F.coalesce("_staged", F.lit(0)).alias("staged"), outcome.alias("outcome"))


def installed(applied: DataFrame, staged: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What projections have applied (projection, event_id) after the prepared runs put in what they staged, each once."""
    go = staged.join(outcomes.filter("outcome = 'prepared'").select("run"), "run", "left_semi")
    return applied.select("projection", "event_id").unionByName(go.select("projection", "event_id")).distinct()


def progress(log: DataFrame, head: int, adapters: dict[str, object]) -> DataFrame:
    """Events seen and applied by each adapter's condition, in one scan: adapter, events, applied."""
    events = log.filter(F.col("global_position") <= head)
    counts = events.agg(F.count(F.lit(1)).alias("events"), *[F.count_if(c).alias(n) for n, c in adapters.items()])
    return counts.select("events", F.explode(F.create_map(*[x for n in adapters for x in (F.lit(n), F.col(n))])).alias("adapter", "applied")).select("adapter", "events", "applied")
