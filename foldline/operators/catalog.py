"""Rules over declaration tables: every rule is a query, all findings are collected, none stops at the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(want: DataFrame, have: DataFrame, key: str, value: str) -> DataFrame:
    """Expected against actual by key: missing, unexpected, changed, same."""
    a, b = want.select(F.col(key).alias("ka"), F.col(value).alias("va")), have.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    finding = F.when(F.col("kb").isNull(), "missing").when(F.col("ka").isNull(), "unexpected").when(~F.col("va").eqNullSafe(F.col("vb")), "changed").otherwise("same")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), finding.alias("finding"))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """References to nothing."""
    return rows.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)), column, "left_anti")


def ownership(targets: DataFrame, projections: DataFrame) -> DataFrame:
    """Targets without exactly one owner: targets (target), projections (projection, target)."""
    n = projections.groupBy("target").agg(F.count_distinct("projection").alias("owners"))
    return targets.select("target").join(n, "target", "left").select("target", F.coalesce("owners", F.lit(0)).alias("owners")).filter("owners <> 1")


def cycles(edges: DataFrame) -> DataFrame:
    """Names on a dependency cycle of any length, and the least name that they reach and that reaches them:
    edges (name, depends_on).

    Names that nothing needs or that need nothing are on no cycle; they go first, as long as that thins the edges
    out. Of the rest the closure is taken by doubling, written between rounds, until it is closed.
    """
    from .tables import written

    core = written(edges.select("name", "depends_on").distinct(), "edges")
    size, now = -1, core.count()
    while now and (size < 0 or now < 0.9 * size):
        thin = core.join(core.select(F.col("depends_on").alias("name")).distinct(), "name", "left_semi").join(core.select(F.col("name").alias("depends_on")).distinct(), "depends_on", "left_semi")
        core = written(thin.select("name", "depends_on"), "edges")
        size, now = now, core.count()
    reach, size = core.toDF("a", "b"), -1
    while size != now:
        far = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        reach = written(reach.union(far).distinct(), "reach")
        size, now = now, reach.count()
    both = reach.join(reach.toDF("b", "a"), ["a", "b"])
    return both.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("cycle"))


def out_of_order(order: DataFrame, edges: DataFrame) -> DataFrame:
    """Dependencies that don't stand before what needs them: order (grp, name, position)."""
    me, dep = order.toDF("grp", "name", "at"), order.toDF("grp", "depends_on", "dep_at")
    return edges.join(me, "name").join(dep, ["grp", "depends_on"]).filter("dep_at >= at").select("grp", "name", "depends_on")


def removed(base: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    return base.select(*keys).distinct().join(now.select(*keys), list(keys), "left_anti")


def moved(base: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value changed, for instance an owner or a group."""
    both = base.select(key, F.col(value).alias("before")).join(now.select(key, F.col(value).alias("after")), key)
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def members(groups: DataFrame) -> DataFrame:
    """Targets in several groups, and groups without targets: groups (grp, target)."""
    many = groups.filter("target is not null").groupBy("target").agg(F.count_distinct("grp").alias("n")).filter("n > 1").select(F.lit("several-groups").alias("finding"), F.col("target").alias("name"))
    none = groups.groupBy("grp").agg(F.count("target").alias("n")).filter("n = 0").select(F.lit("empty-group").alias("finding"), F.col("grp").alias("name"))
    return many.unionByName(none)


def mixed_sources(sources: DataFrame) -> DataFrame:
    """Groups that mix whole-log and category sources: sources (grp, scope)."""
    return sources.groupBy("grp").agg(F.bool_or(F.col("scope") == "all").alias("a"), F.bool_or(F.col("scope") == "category").alias("c")).filter("a and c").select("grp")


def suppliers(models: DataFrame, owners: DataFrame) -> DataFrame:
    """Query models whose observed targets don't have exactly one owner, held back while a target is unknown."""
    seen = models.join(owners, "target", "left").groupBy("model").agg(F.count_distinct("projection").alias("owners"), F.bool_or(F.col("projection").isNull()).alias("unknown"))
    return seen.filter("not unknown and owners <> 1").select("model", "owners")


def cursors(queries: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Waiting queries without exactly one fit cursor: a cursor over everything serves any wait, one of a category
    only a wait for that category. queries (model, wait, category); subscriptions (model, scope, sub_category)."""
    fit = (F.col("scope") == "all") | ((F.col("wait") == "category") & (F.col("category") == F.col("sub_category")))
    found = queries.join(subscriptions, "model", "left").groupBy("model", "wait").agg(F.count_if(fit).alias("fit"))
    return found.filter("wait <> 'immediate' and fit <> 1")


def clear_needs_replay(targets: DataFrame, owners: DataFrame) -> DataFrame:
    """Targets cleared before a replay whose owner can't be replayed: targets (target, policy), owners (target, replayable, start)."""
    both = targets.filter("policy = 'clear'").join(owners, "target")
    finding = F.when(~F.col("replayable"), "needs-replayable-owner").when(F.col("start") == "current-head", "starts-at-head")
    return both.select("target", finding.alias("finding")).filter("finding is not null")


def wiring(projections: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Async projections whose live subscription differs in name or source from what is declared."""
    both = projections.join(subscriptions, "projection", "left")
    finding = F.when(F.col("live_name").isNull(), "no-subscription").when(F.col("live_name") != F.col("name"), "other-name").when(F.col("live_source") != F.col("source"), "other-source")
    return both.select("projection", finding.alias("finding")).filter("finding is not null")


def outside(models: DataFrame, groups: DataFrame) -> DataFrame:
    """Query models that observe a target their group doesn't cover: models (model, grp, target), groups (grp, target)."""
    return models.join(groups, ["grp", "target"], "left_anti").select("model", "grp").distinct()
