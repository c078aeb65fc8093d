"""Process managers, routers and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def select_recipients(candidates: DataFrame, limit: int) -> DataFrame:
    """Recipients of each source event: equal (target, command) collapse to one, two commands for one target conflict,
    and a cap after that is an overflow. candidates: source_event, target, command. Adds ``outcome``."""
    unique = candidates.select("source_event", "target", "command").distinct()
    per = unique.groupBy("source_event", "target").agg(F.count(F.lit(1)).alias("n"), F.min("command").alias("command"))
    whole = per.groupBy("source_event").agg(F.bool_or(F.col("n") > 1).alias("conflict"), F.count(F.lit(1)).alias("targets"))
    outcome = F.when(F.col("conflict"), "conflict").when(F.col("targets") > limit, "overflow").otherwise("selected")
    return per.join(whole, "source_event").select("source_event", "target", "command", "targets", outcome.alias("outcome"))


def occurrences(commands: DataFrame) -> DataFrame:
    """Index of each command among those of one source event to the same target: source_event, target, idx."""
    w = Window.partitionBy("source_event", "target").orderBy("idx")
    return commands.withColumn("occurrence", (F.row_number().over(w) - 1).cast("int"))


def dispatch(commands: DataFrame, done: DataFrame, prefix: str, router: str) -> DataFrame:
    """Outcome of each command by its deterministic id: duplicate if the log has the id, else appended."""
    numbered = occurrences(commands)
    made = numbered.withColumn("command_id", ids.router_id(prefix, F.lit(router), F.col("correlation"), F.col("source_event"), F.col("target"), F.col("occurrence")))
    seen = done.select("command_id").distinct().withColumn("_seen", F.lit(True))
    return made.join(seen, "command_id", "left").withColumn("outcome", F.when(F.col("_seen"), "duplicate").otherwise("appended")).drop("_seen")


def fan_out(events: DataFrame, prefix: str, manager: str, commands: Column) -> DataFrame:
    """A manager's reaction: one row for its own append (index -1) and one for each command of an array."""
    own = events.select("source_event", "correlation", F.lit(-1).alias("idx"), F.lit(None).cast("string").alias("command"))
    out = events.select("source_event", "correlation", F.posexplode(commands).alias("idx", "command"))
    both = own.unionByName(out)
    return both.withColumn("command_id", ids.manager_id(prefix, F.lit(manager), F.col("correlation"), F.col("source_event"), F.col("idx")))


def ack(failures: DataFrame, rejected: str) -> DataFrame:
    """Decision per source event over its failures (kind: systemic, transient, rejection; null for none): a systemic
    one halts, else a transient one retries, else rejections follow the policy."""
    if rejected not in ("halt", "dead-letter", "skip"):
        raise ValueError(rejected)
    per = failures.groupBy("source_event").agg(*[F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False)).alias(k) for k in ("systemic", "transient", "rejection")])
    policy = {"halt": "halt", "dead-letter": "ok-dead-lettered", "skip": "ok-skipped"}[rejected]
    decision = F.when(F.col("systemic"), "halt").when(F.col("transient"), "retry").when(F.col("rejection"), policy).otherwise("ok")
    return per.select("source_event", decision.alias("decision"))


def replay_dead_letters(letters: DataFrame, log: DataFrame, done: DataFrame) -> DataFrame:
    """Fate of dead letters (letter_id, event_id, position): the source must be in the log at that position."""
    at = log.select("event_id", F.col("global_position").alias("_at"))
    seen = done.select("event_id").distinct().withColumn("_seen", F.lit(True))
    rows = letters.join(at, "event_id", "left").join(seen, "event_id", "left")
    fate = F.when(F.col("_at").isNull() | (F.col("_at") != F.col("position")), "source-missing").when(F.col("_seen"), "duplicate").otherwise("fresh")
    return rows.withColumn("fate", fate).drop("_at", "_seen")


def undispatched(source: DataFrame, done: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    """Rows neither decided in a read model nor waiting in a queue."""
    return source.join(done.select(key), key, "left_anti").join(queued.select(key), key, "left_anti")


def causation(log: DataFrame, roots: DataFrame) -> DataFrame:
    """Events that roots led to and that led to them along causation_id, at any distance: event_id, root, depth, which is
    0 for the root itself and negative for what is before it.

    An event has one cause, so jumps along causes double from round to round: the rounds are as many as the longest
    chain has binary digits. A chain that runs into itself ends where it does.
    """
    from .tables import written

    jump, step = written(log.filter("causation_id is not null").select("event_id", F.col("causation_id").alias("to")), "causes"), 1
    found = written(roots.select("event_id", F.col("event_id").alias("root"), F.lit(0).cast("long").alias("depth")).distinct(), "caused")
    while True:
        after = jump.join(found.filter("depth >= 0").withColumnRenamed("event_id", "to"), "to").select("event_id", "root", (F.col("depth") + step).alias("depth"))
        before = found.filter("depth <= 0").join(jump, "event_id").select(F.col("to").alias("event_id"), "root", (F.col("depth") - step).alias("depth"))
        side = lambda d: d.withColumn("ahead", F.col("depth") >= 0)
        new = side(after.unionByName(before)).groupBy("event_id", "root", "ahead").agg(F.min_by("depth", F.abs("depth")).alias("depth"))
        new = new.join(side(found).select("event_id", "root", "ahead"), ["event_id", "root", "ahead"], "left_anti").filter("event_id <> root").drop("ahead")
        new = written(new.select("event_id", "root", "depth"), "caused")
        if not new.limit(1).count():
            return found.join(log.select("event_id"), "event_id", "left_semi")
        found = found.unionByName(new)
        jump = written(jump.join(jump.toDF("to", "far"), "to").select("event_id", F.col("far").alias("to")), "causes")
        step *= 2


#: How failures of a command are told apart; fixed values. Those of the store decide for errors that carry one.
TRANSIENT_STORE = ("connection-lost", "pool-timeout", "connection-error", "wrong-expected-version", "stream-already-exists", "history-retention", "transaction-failure")
CARRY_STORE = ("store-failed", "retry-exhausted", "conflict-fixpoint")
REJECTIONS = ("rejected", "ambiguous")


def failure_kind(error: Column, store: Column) -> Column:
    """systemic, transient or rejection; null without an error."""
    transient = error.isin(*CARRY_STORE) & store.isin(*TRANSIENT_STORE)
    return F.when(error.isNotNull(), F.when(error.isin(*REJECTIONS), "rejection").when(F.coalesce(transient, F.lit(False)), "transient").otherwise("systemic"))


def manage(events: DataFrame, prefix: str, manager: str, commands: Column, timers: Column, done: DataFrame) -> DataFrame:
    """A process manager's reaction to each event: its own append (idx -1), its commands, its timers.

    An append or command whose id the log has is a duplicate. An event that comes again is dispatched again all the
    same, command by command; its timers go with the append that it makes, so they aren't set again.
    events: source_event, correlation and what the arrays are made of; done: command_id.
    """
    base = events.withColumn("_timers", timers)
    rows = fan_out(base, prefix, manager, commands).join(done.select("command_id").distinct().withColumn("_seen", F.lit(True)), "command_id", "left")
    kind = F.when(F.col("idx") < 0, "state").otherwise("command")
    rows = rows.select("source_event", "correlation", kind.alias("kind"), "idx", "command", "command_id", F.when(F.col("_seen"), "duplicate").otherwise("appended").alias("outcome"))
    fresh = rows.filter("kind = 'state' and outcome = 'appended'").select("source_event")
    own = base.join(fresh, "source_event", "left_semi").select("source_event", "correlation", F.lit("timer").alias("kind"), F.posexplode("_timers").alias("idx", "command"))
    return rows.unionByName(own.withColumn("command_id", F.lit(None).cast("string")).withColumn("outcome", F.lit("scheduled")))


def domain_results(commands: DataFrame, done: DataFrame) -> DataFrame:
    """Result of each command with a typed decision: duplicate if the log has its id, for then what it did isn't known
    any more; failed with its error; else handled, with the decision (accepted, no-op, rejected) and what came with it.

    commands: source_event, idx, target, command_id, decision, payload, error; done: command_id. A rejection that the
    target's rules decide on is handled and is no failure, unlike a command that no edge takes.
    """
    seen = done.select("command_id").distinct().withColumn("_seen", F.lit(True))
    rows = commands.join(seen, "command_id", "left")
    result = F.when(F.col("_seen"), "duplicate").when(F.col("error").isNotNull(), "failed").otherwise("handled")
    rows = rows.withColumn("result", result).drop("_seen")
    handled = lambda c: F.when(F.col("result") == "handled", F.col(c)).alias(c)
    return rows.select("source_event", "idx", "target", "command_id", "result", handled("decision"), handled("payload"), F.when(F.col("result") == "failed", F.col("error")).alias("error"))


def domain_summary(results: DataFrame) -> DataFrame:
    """What a worker decides from, without payloads: of each source event the number of duplicates and of failures, and
    the first failure by its place. The failures themselves are the rows of ``results``; nothing is collected."""
    failed = F.col("result") == "failed"
    first = F.min(F.when(failed, F.struct("idx", "target", "error")))
    per = results.groupBy("source_event").agg(F.count_if(F.col("result") == "duplicate").alias("duplicates"), F.count_if(failed).alias("failures"), first.alias("_first"))
    return per.select("source_event", "duplicates", "failures", F.col("_first.target").alias("first_target"), F.col("_first.error").alias("first_error"))
