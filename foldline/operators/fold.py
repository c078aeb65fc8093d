"""Folds of event streams into state.

A stream is folded in two levels, so that no stream is ever collected whole: its events are cut into runs of
``run`` versions, each run is folded once for every vertex it could start from, and the short list of run
summaries is folded from the initial vertex. That works because a machine has few vertices and its registers
only add up; the summary of a run is the vertex it ends in and what it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 4096


@dataclass(frozen=True)
class Edge:
    """vertex --event--> to, adding one to each register named."""

    vertex: str
    event: str
    to: str
    adds: tuple[str, ...] = ()


@dataclass(frozen=True)
class Machine:
    initial: str
    vertices: tuple[str, ...]
    registers: tuple[str, ...]
    edges: tuple[Edge, ...]

    def __post_init__(self) -> None:
        seen = [(e.vertex, e.event) for e in self.edges]
        if len(set(seen)) < len(seen):
            raise ValueError("two edges leave one vertex on one event")
        if self.initial not in self.vertices or any(v not in self.vertices for e in self.edges for v in (e.vertex, e.to)):
            raise ValueError("an edge names an unknown vertex")

    def warnings(self) -> list[tuple[str, str]]:
        """Vertices that nothing reaches, and events that change nothing (static checks of the graph)."""
        reach, new = {self.initial}, {self.initial}
        while new:
            new = {e.to for e in self.edges if e.vertex in new} - reach
            reach |= new
        found = [("unreachable-vertex", v) for v in self.vertices if v not in reach]
        found += [("dead-edge", f"{e.vertex}/{e.event}") for e in self.edges if e.vertex not in reach]
        return found + [("silent-edge", f"{e.vertex}/{e.event}") for e in self.edges if e.to == e.vertex and not e.adds]

    def step(self, state: Column, event: Column) -> Column:
        """The state (vertex, registers, rejected) after an event; one without an edge is counted as rejected."""
        to, hit, adds = F.lit(None).cast("string"), F.lit(False), {r: F.lit(False) for r in self.registers}
        for e in self.edges:
            here = (state["vertex"] == e.vertex) & (event == e.event)
            to, hit = F.when(here, e.to).otherwise(to), hit | here
            for r in e.adds:
                adds[r] = adds[r] | here
        return F.struct(
            F.coalesce(to, state["vertex"]).alias("vertex"), *[(state[r] + adds[r].cast("long")).alias(r) for r in self.registers], (state["rejected"] + (~hit).cast("long")).alias("rejected")
        )

    def start(self, vertex: str) -> Column:
        return F.struct(F.lit(vertex).alias("vertex"), *[F.lit(0).cast("long").alias(r) for r in (*self.registers, "rejected")])


#: The machine of the driver's user events.
USERS = Machine(
    "New", ("New", "Active", "Customer"), ("purchases", "errors"),
    (
        Edge("New", "signup", "Active"), Edge("Active", "view", "Active"), Edge("Active", "click", "Active"), Edge("Active", "purchase", "Customer", ("purchases",)),
        Edge("Customer", "purchase", "Customer", ("purchases",)), Edge("Customer", "view", "Customer"), Edge("Customer", "click", "Customer"),
        *[Edge(v, "error", v, ("errors",)) for v in ("New", "Active", "Customer")],
    ),
)


def replay(log: DataFrame, machine: Machine, seed: DataFrame | None = None, run: int = RUN) -> DataFrame:
    """State of every stream: stream_name, vertex, registers, rejected, version, last_position.

    seed: stream_name, version, vertex, registers, rejected; events up to a seed's version are not folded again.
    """
    if seed is not None:
        seed = seed.select("stream_name", F.col("version").alias("_from"), F.struct("vertex", *machine.registers, "rejected").alias("_seed"))
        log = log.join(seed.select("stream_name", "_from"), "stream_name", "left").filter(F.col("stream_version") > F.coalesce("_from", F.lit(0)))
    cut = log.withColumn("_run", F.floor((F.col("stream_version") - 1) / run))
    events = F.transform(F.sort_array(F.collect_list(F.struct("stream_version", "event_type"))), lambda e: e["event_type"])
    runs = cut.groupBy("stream_name", "_run").agg(events.alias("_events"), F.max("stream_version").alias("_version"), F.max("global_position").alias("_position"))
    folded = [F.aggregate("_events", machine.start(v), machine.step).alias(v) for v in machine.vertices]
    runs = runs.select("stream_name", "_run", "_version", "_position", F.struct(*folded).alias("_by"))
    whole = runs.groupBy("stream_name").agg(F.sort_array(F.collect_list(F.struct("_run", "_by"))).alias("_runs"), F.max("_version").alias("version"), F.max("_position").alias("last_position"))
    first = machine.start(machine.initial)
    if seed is not None:
        whole = whole.join(seed, "stream_name", "full")
        first = F.coalesce("_seed", first)
        whole = whole.withColumn("version", F.greatest("version", "_from"))

    def chain(state: Column, one: Column) -> Column:
        pick = one["_by"][machine.vertices[0]]
        for v in machine.vertices[1:]:
            pick = F.when(state["vertex"] == v, one["_by"][v]).otherwise(pick)
        return F.struct(pick["vertex"].alias("vertex"), *[(state[r] + pick[r]).alias(r) for r in (*machine.registers, "rejected")])

    state = F.coalesce(F.aggregate("_runs", first, chain), first)
    return whole.select("stream_name", state.alias("s"), "version", "last_position").select("stream_name", "s.vertex", *[f"s.{r}" for r in machine.registers], "s.rejected", "version", "last_position")


def gaps(log: DataFrame, run: int = RUN) -> DataFrame:
    """First version of each stream that isn't the one before plus one: stream_name, expected, observed.

    Within runs of versions by a window, between runs over one row a run, so that no stream is sorted in one task.
    """
    cut = log.select("stream_name", "stream_version", F.floor((F.col("stream_version") - 1) / run).alias("_run"))
    before = F.lag("stream_version").over(Window.partitionBy("stream_name", "_run").orderBy("stream_version"))
    inside = cut.select("stream_name", (before + 1).alias("expected"), F.col("stream_version").alias("observed"))
    runs = cut.groupBy("stream_name", "_run").agg(F.min("stream_version").alias("observed"), F.max("stream_version").alias("_last"))
    last = F.coalesce(F.lag("_last").over(Window.partitionBy("stream_name").orderBy("_run")), F.lit(0))
    between = runs.select("stream_name", (last + 1).alias("expected"), "observed")
    found = inside.unionByName(between).filter("expected <> observed")
    return found.groupBy("stream_name").agg(F.min(F.struct("observed", "expected")).alias("x")).select("stream_name", "x.expected", "x.observed")


def hydrate(log: DataFrame, machine: Machine, seed: DataFrame) -> DataFrame:
    """State of every stream as a command meets it, and the way there: ``seeded`` where the tail behind its snapshot is
    without a gap, else the ``whole`` stream from the start; ``failed``, with a null state, where that has a gap too.

    seed as in ``replay``; a snapshot ahead of its stream is not used either.
    """
    from .tables import written

    at = seed.select("stream_name", F.col("version").alias("_from"))
    tail = log.join(at, "stream_name").filter("stream_version > _from")
    broken = gaps(tail.withColumn("stream_version", F.col("stream_version") - F.col("_from"))).select("stream_name")
    last = log.groupBy("stream_name").agg(F.max("stream_version").alias("_last"))
    good = written(seed.join(broken, "stream_name", "left_anti").join(last, "stream_name").filter("version <= _last").drop("_last"), "seeds")
    seeded = good.select("stream_name", F.lit("seeded").alias("_way"))
    failed = gaps(log.join(seeded, "stream_name", "left_anti")).select("stream_name", F.lit("failed").alias("_bad"))
    state = replay(log, machine, good).join(seeded, "stream_name", "left").join(failed, "stream_name", "left")
    way = F.coalesce("_way", "_bad", F.lit("whole"))
    kept = [F.when(way != "failed", F.col(c)).alias(c) for c in ("vertex", *machine.registers, "rejected")]
    return state.select("stream_name", *kept, "version", way.alias("way"))


def audit(log: DataFrame, machine: Machine, seed: DataFrame) -> DataFrame:
    """Verdict on every stream: replay-failed where it has a gap, before all else; seed-divergence where the state by
    its snapshot isn't that of the whole stream; else ok. An audit passes if all are ok."""
    columns = ["vertex", *machine.registers, "rejected"]
    whole = replay(log, machine).select("stream_name", "version", F.struct(*columns).alias("_whole"))
    by_seed = replay(log.join(seed.select("stream_name"), "stream_name", "left_semi"), machine, seed).select("stream_name", F.struct(*columns).alias("_seeded"))
    rows = whole.join(by_seed, "stream_name", "left").join(gaps(log).select("stream_name", "expected", "observed"), "stream_name", "left")
    verdict = F.when(F.col("expected").isNotNull(), "replay-failed").when(F.col("_seeded").isNotNull() & (F.col("_seeded") != F.col("_whole")), "seed-divergence").otherwise("ok")
    return rows.select("stream_name", "version", verdict.alias("verdict"), "expected", "observed")


@dataclass(frozen=True)
class Guarded:
    """vertex --command--> to, where a SQL condition on registers and command holds; silent: it changes no register."""

    vertex: str
    command: str
    to: str
    guard: str = "true"
    silent: bool = False


def decide_guarded(rows: DataFrame, edges: tuple[Guarded, ...]) -> DataFrame:
    """Adds matches, outcome and next_vertex to commands joined with their states (vertex, command, registers).

    Guards of one vertex may overlap; a command that several edges take is ambiguous. A null guard doesn't hold.
    """
    taken = [F.when((F.col("vertex") == e.vertex) & (F.col("command") == e.command) & F.expr(e.guard), F.struct(F.lit(e.to).alias("to"), F.lit(e.silent).alias("silent"))) for e in edges]
    rows = rows.withColumn("_taken", F.array_compact(F.array(*taken)))
    n, first = F.size("_taken"), F.get("_taken", F.lit(0))
    outcome = F.when(n == 0, "rejected").when(n > 1, "ambiguous").when((first["to"] == F.col("vertex")) & first["silent"], "no-op").otherwise("accepted")
    return rows.withColumn("matches", n.cast("long")).withColumn("outcome", outcome).withColumn("next_vertex", F.when(n == 1, first["to"])).drop("_taken")


def decide(states: DataFrame, commands: DataFrame, machine: Machine) -> DataFrame:
    """Commands (stream_name, command) against states: how many edges match, the outcome and the state after.

    None matches: rejected; several: ambiguous; one that changes nothing: no-op; else accepted.
    """
    spark = states.sparkSession
    edges = spark.createDataFrame([(e.vertex, e.event, e.to, len(e.adds)) for e in machine.edges], "vertex string, command string, to string, n_adds int")
    now = commands.join(states.select("stream_name", "vertex", "version"), "stream_name", "left")
    now = now.withColumn("vertex", F.coalesce("vertex", F.lit(machine.initial))).withColumn("version", F.coalesce("version", F.lit(0)).cast("long"))
    found = now.join(F.broadcast(edges), ["vertex", "command"], "left")  # the machine's own few edges
    found = found.groupBy("command_id", "stream_name", "command", "vertex", "version").agg(F.count("to").alias("matches"), F.min("to").alias("to"), F.max("n_adds").alias("n_adds"))
    outcome = F.when(F.col("matches") == 0, "rejected").when(F.col("matches") > 1, "ambiguous").when((F.col("to") == F.col("vertex")) & (F.col("n_adds") == 0), "no-op").otherwise("accepted")
    return found.select("command_id", "stream_name", "command", "vertex", "version", "matches", outcome.alias("outcome"), F.when(F.col("matches") == 1, F.col("to")).alias("next_vertex"))


def assign_positions(batch: DataFrame, heads: DataFrame, order: str) -> DataFrame:
    """Versions of an appended batch (stream_name, order): the stream's head plus the place in the batch."""
    place = F.row_number().over(Window.partitionBy("stream_name").orderBy(order))
    return batch.join(heads, "stream_name", "left").withColumn("stream_version", F.coalesce("head", F.lit(0)) + place)


def append_outcome(expected: Column, actual: Column) -> Column:
    """Optimistic check: 0 expects no stream; otherwise exactly that version."""
    return F.when(expected == actual, "appended").when((expected == 0) & (actual > 0), "stream-already-exists").otherwise("wrong-expected-version")


def backoff(base: int, attempt: Column, most: int = 100_000) -> Column:
    """Microseconds before a retry, without jitter."""
    return F.least(F.lit(most).cast("double"), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def snapshot_due(every: int, before: Column, after: Column) -> Column:
    """Whether a span (before, after] of versions crosses a multiple of ``every``; never for 0 or less."""
    return F.lit(False) if every <= 0 else F.floor(after / every) > F.floor(before / every)


def should_snapshot(policy: str, before: Column, after: Column, terminal: Column, every: int = 0, custom: Column | None = None) -> Column:
    """Whether an append of (before, after] is followed by a snapshot: never, every ``every`` versions, on-terminal, or
    where a condition of the caller's over state, version and terminality holds (custom)."""
    if policy == "never":
        return F.lit(False)
    if policy == "every":
        return snapshot_due(every, before, after)
    if policy == "on-terminal":
        return terminal
    if policy == "custom" and custom is not None:
        return F.coalesce(custom, F.lit(False))
    raise ValueError(policy)


def latest_compatible(snapshots: DataFrame, codec: int, registers: str, shape: str) -> DataFrame:
    """Latest snapshot of each stream with all three discriminators."""
    fit = snapshots.filter((F.col("state_codec_version") == codec) & (F.col("regfile_shape_hash") == registers) & (F.col("state_shape_hash") == shape))
    return fit.groupBy("stream_name").agg(F.max_by(F.struct("stream_version", "state"), "stream_version").alias("s")).select("stream_name", "s.stream_version", "s.state")


def snapshot_upsert(writes: DataFrame) -> DataFrame:
    """Writes (stream_name, seq, version, tag) in order: a newer or equal version replaces; so does any other tag, even
    backwards. So what counts are the writes since the last change of tag, and of these the highest version, the
    latest of equals. Aggregates and joins by stream, no window."""
    last = writes.groupBy("stream_name").agg(F.max_by("tag", "seq").alias("_tag"))
    rows = writes.join(last, "stream_name")
    other = rows.filter(~F.col("tag").eqNullSafe(F.col("_tag"))).groupBy("stream_name").agg(F.max("seq").alias("_other"))
    rows = rows.join(other, "stream_name", "left").filter("_other is null or seq > _other")
    return rows.groupBy("stream_name").agg(F.max_by(F.struct("version", "tag", "seq"), F.struct("version", "seq")).alias("x")).select("stream_name", "x.version", "x.tag", "x.seq")
