"""Scans of the event log. Each is a filter that reaches the Parquet scan, with the order and page it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stream(log: DataFrame, name: str, after: int = 0, through: int | None = None) -> DataFrame:
    """Events of one stream with version > after, and up to ``through`` if given, in order."""
    found = log.filter((F.col("stream_name") == name) & (F.col("stream_version") > after))
    return (found if through is None else found.filter(F.col("stream_version") <= through)).orderBy("stream_version")


def as_of(log: DataFrame, version: int) -> DataFrame:
    return log.filter(F.col("stream_version") <= version)


def page(log: DataFrame, after: int, size: int, category: str | None = None) -> DataFrame:
    """The next ``size`` events after a position, of the whole log or a category."""
    found = log.filter(F.col("global_position") > after)
    return (found if category is None else found.filter(F.col("category") == category)).orderBy("global_position").limit(size)


def page_back(log: DataFrame, before: int, size: int) -> DataFrame:
    return log.filter(F.col("global_position") < before).orderBy(F.desc("global_position")).limit(size)


def bounded(log: DataFrame, head: int) -> DataFrame:
    """Everything up to a captured head, which is never extended."""
    return log.filter(F.col("global_position") <= head)


def complete(log: DataFrame, declared: DataFrame) -> DataFrame:
    """Whether all of each stream's history was seen: declared (stream_name, version)."""
    seen = log.groupBy("stream_name").agg(F.max("stream_version").alias("last"), F.count(F.lit(1)).alias("n"))
    return declared.join(seen, "stream_name", "left").select("stream_name", "version", F.coalesce("last", F.lit(0)).alias("last"), (F.coalesce("n", F.lit(0)) == F.col("version")).alias("complete"))


def category(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def category_error(name: Column) -> Column:
    """Why a category is refused, or null: blank, reserved, white space or control characters, a dash."""
    return F.when(F.length(name) == 0, "empty").when(name == "$all", "reserved").when(name.contains("-"), "dash").when(name.rlike(r"[\s\x00-\x1F\x7F]"), "blank-or-control")


def entity_stream(category_name: Column, entity: Column) -> Column:
    """``category-id``; null for a blank id. The id may hold dashes."""
    return F.when(F.length(F.trim(entity)) > 0, F.concat_ws("-", category_name, entity))


def merge(*sources: DataFrame) -> DataFrame:
    """Sources in the one order of positions; the same position twice is an error to be looked up with ``clashes``."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def clashes(log: DataFrame) -> DataFrame:
    return log.groupBy("global_position").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def merge_chunk(log: DataFrame, by: str, cursors: DataFrame, size: int) -> DataFrame:
    """The next events of a merge of pages: a page of ``size`` from each source behind its cursor, and of these, in the one
    order, at most ``size`` up to the horizon, behind which a source that isn't read to its end may still have any.

    cursors: the source, cursor; each source is read as far as its page by an order and a limit of its own.
    """
    pages = None
    for row in cursors.collect():  # one row a source of a rebuild's contract
        one = log.filter((F.col(by) == row[by]) & (F.col("global_position") > row["cursor"])).orderBy("global_position").limit(size + 1)
        pages = one if pages is None else pages.unionByName(one)
    place = F.row_number().over(Window.partitionBy(by).orderBy("global_position"))
    pages = pages.withColumn("_place", place).withColumn("_more", F.max("_place").over(Window.partitionBy(by)) > size).filter(F.col("_place") <= size)
    ends = pages.groupBy(by, "_more").agg(F.max("global_position").alias("last")).filter("_more").agg(F.min("last").alias("_horizon"))
    held = pages.crossJoin(F.broadcast(ends)).filter(F.col("_horizon").isNull() | (F.col("global_position") <= F.col("_horizon")))
    return held.drop("_place", "_more", "_horizon").orderBy("global_position").limit(size)


def chunk_error(chunk: DataFrame, floor: int) -> DataFrame:
    """What is wrong with a merged chunk, as rows (finding, global_position): a position twice, or one that had been applied."""
    twice = clashes(chunk).select(F.lit("duplicate").alias("finding"), "global_position")
    return twice.unionByName(chunk.filter(F.col("global_position") <= floor).select(F.lit("regression").alias("finding"), "global_position"))


def head(log: DataFrame, *by: str) -> DataFrame:
    """Largest position, 0 for an empty log, or by category."""
    return log.groupBy(*by).agg(F.coalesce(F.max("global_position"), F.lit(0)).alias("head"))


def captured(log: DataFrame) -> int:
    """The head of the log as a number, read once, for work that is bounded by it."""
    return head(log).first()["head"]


def before(log: DataFrame, *by: str, run: int = 1 << 16) -> DataFrame:
    """Adds ``before``: the position before each event's, among those of its key, or 0.

    Within runs of positions by a window, between runs over one row a run, so that no key is sorted in one task.
    """
    at = log.withColumn("_run", F.floor(F.col("global_position") / run))
    last = at.groupBy(*by, "_run").agg(F.max("global_position").alias("_last"))
    last = last.select(*by, "_run", F.lag("_last", 1, 0).over(Window.partitionBy(*by).orderBy("_run")).alias("_start"))
    inside = F.lag("global_position").over(Window.partitionBy(*by, "_run").orderBy("global_position"))
    return at.withColumn("before", inside).join(last, [*by, "_run"]).withColumn("before", F.coalesce("before", "_start")).drop("_run", "_start")


def watermarks(log: DataFrame, cursor: int, size: int) -> DataFrame:
    """The first streams, by name, with events after a cursor, and their last positions."""
    found = log.groupBy("stream_name").agg(F.max("global_position").alias("watermark")).filter(F.col("watermark") > cursor)
    return found.orderBy("stream_name").limit(size)


def buckets(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("bucket"))


def bucket_of(key: Column, n: int) -> Column:
    """Stable bucket of a stream, so that one consumer sees all of it."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def zipped(df: DataFrame, keep: list[str], **arrays: str) -> DataFrame:
    """Parallel arrays as rows, in order: ordinality from 1."""
    rows = df.select(*keep, F.posexplode(F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])).alias("at", "row"))
    return rows.select(*keep, (F.col("at") + 1).alias("ordinality"), *[F.col(f"row.{n}").alias(n) for n in arrays])


def upsert(existing: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins by key; an existing row is older than any change."""
    late = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), order).alias("r")).select("r.*").drop(order)
    return existing.join(late.select(key), key, "left_anti").unionByName(late)


def insert_ignore(existing: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First writer wins by key; an existing row stays."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(*keys), keys, "left_anti")
