"""Which edge can have put out an event: replay of edges that emit several events.

Our reading of inverse replay: an edge (vertex, command, to) emits a fixed chain of event types. In a vertex, an event
starts the one edge whose chain begins with it; the following events must be the rest of that chain. None or several
such edges, an event out of the chain, and a log that ends inside a chain are failures, reported with the version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chain:
    vertex: str
    command: str
    to: str
    emits: tuple[str, ...]


def replay(log: DataFrame, initial: str, chains: tuple[Chain, ...]) -> DataFrame:
    """Per stream: stream_name, vertex, outcome (ok, none, ambiguous, mismatch, truncated), at (version of the failure)."""
    if any(not c.emits for c in chains):
        raise ValueError("a chain emits at least one event")
    events = F.sort_array(F.collect_list(F.struct("stream_version", "event_type")))
    start = F.struct(F.lit(initial).alias("vertex"), F.array().cast("array<string>").alias("rest"), F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("failed"), F.lit(None).cast("long").alias("at"))

    def step(s: Column, e: Column) -> Column:
        kind = e["event_type"]
        matches, rest, to = F.lit(0), F.array().cast("array<string>"), F.lit(None).cast("string")
        for c in chains:
            hit = (s["vertex"] == c.vertex) & (kind == c.emits[0])
            matches = matches + hit.cast("int")
            rest = F.when(hit, F.array(*[F.lit(x) for x in c.emits[1:]]).cast("array<string>")).otherwise(rest)
            to = F.when(hit, F.lit(c.to)).otherwise(to)
        inside = F.size(s["rest"]) > 0
        failure = F.when(inside & (F.get(s["rest"], F.lit(0)) != kind), "mismatch").when(~inside & (matches == 0), "none").when(~inside & (matches > 1), "ambiguous")
        left = F.when(inside, F.slice(s["rest"], F.lit(2), F.size(s["rest"]))).otherwise(rest)
        goal = F.when(inside, s["to"]).otherwise(to)
        done = F.size(left) == 0
        live = F.struct(F.when(done, goal).otherwise(s["vertex"]).alias("vertex"), left.alias("rest"), goal.alias("to"), failure.alias("failed"), F.when(failure.isNotNull(), e["stream_version"]).alias("at"))
        stop = F.struct(s["vertex"].alias("vertex"), F.array().cast("array<string>").alias("rest"), F.lit(None).cast("string").alias("to"), F.coalesce(s["failed"], failure).alias("failed"), F.coalesce(s["at"], e["stream_version"]).alias("at"))
        return F.when(s["failed"].isNotNull() | failure.isNotNull(), stop).otherwise(live)

    folded = log.groupBy("stream_name").agg(F.aggregate(events, start, step).alias("s"), F.max("stream_version").alias("last"))
    cut = F.size("s.rest") > 0
    return folded.select("stream_name", "s.vertex", F.coalesce("s.failed", F.when(cut, "truncated").otherwise("ok")).alias("outcome"), F.coalesce("s.at", F.when(cut, F.col("last"))).alias("at"))
