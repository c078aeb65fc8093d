"""Queries over the log: scans, heads, watermarks, joins, set operations, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import lift, scans
from ..sources.lift import table, with_
from .registry import query

LOG = "global_position, stream_name, stream_version, event_type"


@query(with_("event_log") + f"SELECT {LOG} FROM event_log WHERE stream_name = 'user-7' AND stream_version > 10")
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scans.stream(lift.event_log(spark, sf), "user-7", 10).select(*LOG.split(", "))


@query(with_("event_log") + f"SELECT {LOG} FROM event_log WHERE stream_name = 'user-7' AND stream_version > 3 AND stream_version <= 20")
def stream_scan_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return scans.stream(lift.event_log(spark, sf), "user-7", 3, 20).select(*LOG.split(", "))


@query(with_("all_log") + "SELECT * FROM all_log WHERE global_position > 1000 ORDER BY global_position LIMIT 500")
def log_page(spark: SparkSession, sf: str) -> DataFrame:
    return scans.page(lift.all_log(spark, sf), 1000, 500)


@query(with_("all_log") + "SELECT * FROM all_log WHERE category = 'order' AND global_position > 1000 ORDER BY global_position LIMIT 500")
def category_page(spark: SparkSession, sf: str) -> DataFrame:
    return scans.page(lift.all_log(spark, sf), 1000, 500, "order")


@query(with_("all_log") + "SELECT * FROM all_log WHERE global_position < 9000 ORDER BY global_position DESC LIMIT 256")
def log_page_back(spark: SparkSession, sf: str) -> DataFrame:
    return scans.page_back(lift.all_log(spark, sf), 9000, 256)


@query(with_("event_log") + "SELECT s.stream_name, s.version, max(e.stream_version) AS last, count(*) = max(s.version) AS complete FROM (SELECT stream_name, count(*) + (stream_id % 3 = 0)::INT AS version FROM event_log GROUP BY stream_name, stream_id) s JOIN event_log e USING (stream_name) GROUP BY s.stream_name, s.version")
def stream_completeness(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.event_log(spark, sf)
    declared = log.groupBy("stream_name", "stream_id").agg(F.count(F.lit(1)).alias("n")).select("stream_name", (F.col("n") + (F.col("stream_id") % 3 == 0).cast("int")).alias("version"))
    return scans.complete(log, declared)


@query(with_("all_log") + "SELECT category, count(*) AS n, max(global_position) AS last FROM all_log WHERE global_position <= 20000 GROUP BY category")
def bounded_read(spark: SparkSession, sf: str) -> DataFrame:
    return scans.bounded(lift.all_log(spark, sf), 20000).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.max("global_position").alias("last"))


@query("SELECT bucket::INT AS bucket, count(event_id) AS n FROM range(16) b(bucket) LEFT JOIN (SELECT event_id, (user_id % 16)::INT AS k FROM events) e ON k = bucket GROUP BY bucket")
def bucket_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("user_id") % 16).cast("int").alias("bucket"), "event_id")
    return scans.buckets(spark, 16).join(rows, "bucket", "left").groupBy("bucket").agg(F.count("event_id").alias("n"))


@query("WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS words, list_transform(string_split(p_name, ' '), lambda x: length(x)) AS sizes FROM part) SELECT p_partkey, i::INT AS ordinality, words[i] AS word, sizes[i]::INT AS size FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM a)")
def unnest_ordinality(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    rows = table(spark, sf, "part").select("p_partkey", words.alias("word"), F.transform(words, F.length).alias("size"))
    return scans.zipped(rows, ["p_partkey"], word="word", size="size")


@query(with_("all_log") + "SELECT category, coalesce(max(global_position), 0) AS head FROM all_log GROUP BY category")
def category_head(spark: SparkSession, sf: str) -> DataFrame:
    return scans.head(lift.all_log(spark, sf), "category")


@query(with_("all_log") + "SELECT coalesce(max(global_position), 0) AS head FROM all_log")
def log_head(spark: SparkSession, sf: str) -> DataFrame:
    return scans.head(lift.all_log(spark, sf))


@query(with_("event_log") + "SELECT stream_name, max(global_position) AS watermark FROM event_log GROUP BY stream_name HAVING max(global_position) > 9500 ORDER BY stream_name LIMIT 50")
def stream_watermarks(spark: SparkSession, sf: str) -> DataFrame:
    return scans.watermarks(lift.event_log(spark, sf), 9500, 50)


@query(with_("all_log") + "SELECT global_position, stream_name, category, lag(global_position, 1, 0) OVER (PARTITION BY category ORDER BY global_position) AS before FROM all_log")
def kway_merge(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.all_log(spark, sf)
    parts = [log.filter(F.col("category") == c) for c in ("event", "order", "customer")]
    return scans.before(scans.merge(*parts), "category").select("global_position", "stream_name", "category", "before")


@query(with_("all_log") + """, c AS (SELECT category, max(global_position) // 3 AS cursor FROM all_log GROUP BY 1), p AS (SELECT a.*, row_number() OVER (PARTITION BY category ORDER BY global_position) AS k, count(*) OVER (PARTITION BY category) AS n FROM all_log a JOIN c USING (category) WHERE global_position > cursor),
h AS (SELECT min(global_position) AS horizon FROM p WHERE k = 400 AND n > 400) SELECT global_position, stream_name, category FROM p, h WHERE k <= 400 AND (horizon IS NULL OR global_position <= horizon) ORDER BY global_position LIMIT 400""")
def merge_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """The next chunk of a merge of three categories, each behind its own cursor."""
    log = lift.all_log(spark, sf)
    cursors = log.groupBy("category").agg(F.floor(F.max("global_position") / 3).alias("cursor"))
    return scans.merge_chunk(log, "category", cursors, 400).select("global_position", "stream_name", "category")


@query(with_("all_log") + "SELECT global_position, count(*) AS n FROM (SELECT global_position FROM all_log UNION ALL SELECT global_position FROM all_log WHERE category = 'customer' AND source_id % 50 = 0) GROUP BY ALL HAVING count(*) > 1")
def merge_clashes(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.all_log(spark, sf)
    return scans.clashes(scans.merge(log, log.filter("category = 'customer' and source_id % 50 = 0")))


@query(with_("event_log") + "SELECT stream_name FROM event_log WHERE event_type IN ('purchase') UNION SELECT 'user-' || c_custkey FROM customer WHERE c_acctbal < 0")
def audit_selection(spark: SparkSession, sf: str) -> DataFrame:
    typed = lift.event_log(spark, sf).filter(F.col("event_type").isin("purchase")).select("stream_name")
    held = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("stream_name"))
    return typed.union(held).distinct()


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_orderdate")


@query("SELECT coalesce(n_name, '(none)') AS n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def left_join_chain(spark: SparkSession, sf: str) -> DataFrame:
    c, n, o = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "orders")
    both = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").join(o, c["c_custkey"] == o["o_custkey"], "left")
    return both.groupBy(F.coalesce("n_name", F.lit("(none)")).alias("n_name")).agg(F.count_distinct("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT e.event_id, o.o_orderkey, e.ts AS event_ts, o.o_orderdate FROM events e JOIN orders o ON o.o_orderkey = e.event_id WHERE (e.user_id, e.event_id) > (100, 5000)")
def keyset_compare(spark: SparkSession, sf: str) -> DataFrame:
    e, o = table(spark, sf, "events"), table(spark, sf, "orders")
    later = F.struct("user_id", "event_id") > F.struct(F.lit(100).cast("long").alias("user_id"), F.lit(5000).cast("long").alias("event_id"))
    return e.filter(later).join(o, e["event_id"] == o["o_orderkey"]).select("event_id", "o_orderkey", F.col("ts").alias("event_ts"), "o_orderdate")


@query("WITH f AS (SELECT l_suppkey % 10 AS name, max(l_partkey) AS floor FROM lineitem WHERE l_quantity < 5 GROUP BY 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l LEFT JOIN f ON f.name = l.l_suppkey % 10 WHERE floor IS NULL OR l_partkey > floor")
def delete_below_floors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    floors = rows.filter("l_quantity < 5").groupBy((F.col("l_suppkey") % 10).alias("name")).agg(F.max("l_partkey").alias("floor"))
    kept = rows.join(floors, rows["l_suppkey"] % 10 == floors["name"], "left").filter("floor is null or l_partkey > floor")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS finding FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k")
def schema_compare(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.catalog import compare

    c = table(spark, sf, "customer")
    want = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    have = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("v"))
    return compare(want, have, "k", "v")


@query("SELECT DISTINCT kind, id FROM (SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'customer', o_custkey FROM orders WHERE o_totalprice > 400000)")
def finding_union(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders").filter("o_totalprice > 400000"), table(spark, sf, "customer").filter("c_acctbal < -900")
    part = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    return part(o, "order", "o_orderkey").unionByName(part(c, "customer", "c_custkey")).unionByName(part(o, "customer", "o_custkey")).distinct()


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) FILTER (event_type = 'error') AS errors, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (value > 300), '') AS large FROM events GROUP BY user_id")
def ordered_arrays(spark: SparkSession, sf: str) -> DataFrame:
    large = F.sort_array(F.collect_list(F.when(F.col("value") > 300, F.col("event_id"))))
    kinds = F.array_join(F.sort_array(F.collect_set("event_type")), ",")
    return table(spark, sf, "events").groupBy("user_id").agg(kinds.alias("kinds"), F.count_if(F.col("event_type") == "error").alias("errors"), F.array_join(large.cast("array<string>"), ",").alias("large"))


@query("SELECT n_regionkey, count(DISTINCT s_suppkey) AS suppliers, CASE WHEN count(DISTINCT n_nationkey) = 5 THEN min(s_acctbal) END AS floor FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_regionkey")
def group_floor(spark: SparkSession, sf: str) -> DataFrame:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier").filter("s_acctbal > 5000")
    both = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_regionkey")
    return both.agg(F.count_distinct("s_suppkey").alias("suppliers"), F.when(F.count_distinct("n_nationkey") == 5, F.min("s_acctbal")).alias("floor"))


@query(with_("all_log") + "SELECT sub AS subscription, c AS category, min(pos) AS position, greatest(0, (SELECT max(global_position) FROM all_log) - min(pos)) AS distance FROM (SELECT 'sub-' || category AS sub, category AS c, source_id % 3 AS member, max(global_position) AS pos FROM all_log WHERE source_id % 7 <> 0 GROUP BY ALL) GROUP BY ALL")
def subscription_position(spark: SparkSession, sf: str) -> DataFrame:
    log = lift.all_log(spark, sf)
    members = log.filter("source_id % 7 <> 0").groupBy("category", (F.col("source_id") % 3).alias("member")).agg(F.max("global_position").alias("pos"))
    floors = members.groupBy("category").agg(F.min("pos").alias("position"))
    behind = F.greatest(F.lit(0), scans.head(log).scalar() - F.col("position"))
    return floors.select(F.concat(F.lit("sub-"), "category").alias("subscription"), "category", "position", behind.alias("distance"))


@query("SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, max(l_shipdate) AS last FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY l_returnflag")
def adapter_progress(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-06-01").cast("timestamp_ntz"))
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"), F.max("l_shipdate").alias("last"))


@query("WITH c AS (SELECT s_suppkey AS id, 'cat ' || s_suppkey AS a, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a-b' WHEN 2 THEN 'a b' WHEN 3 THEN '$all' ELSE 'ok' || s_suppkey END AS name FROM supplier) SELECT id, name, CASE WHEN name = '' THEN 'empty' WHEN name = '$all' THEN 'reserved' WHEN contains(name, '-') THEN 'dash' WHEN contains(name, ' ') THEN 'blank-or-control' END AS error, split_part(name, '-', 1) AS category, CASE WHEN trim(name) <> '' THEN 's-' || name END AS stream_name FROM c")
def category_validation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "").when(k % 5 == 1, "a-b").when(k % 5 == 2, "a b").when(k % 5 == 3, "$all").otherwise(F.concat(F.lit("ok"), k.cast("string")))
    rows = table(spark, sf, "supplier").select(k.alias("id"), name.alias("name"))
    return rows.select("id", "name", scans.category_error(F.col("name")).alias("error"), scans.category(F.col("name")).alias("category"), scans.entity_stream(F.lit("s"), F.col("name")).alias("stream_name"))


@query("SELECT k AS c_custkey, v AS balance FROM (SELECT c_custkey AS k, round(c_acctbal, 2) AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, max_by(o_totalprice, o_orderkey) FROM orders GROUP BY 1)")
def upsert_last_writer(spark: SparkSession, sf: str) -> DataFrame:
    now = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    changes = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return scans.upsert(now, changes, "c_custkey", "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def insert_first_writer(spark: SparkSession, sf: str) -> DataFrame:
    have = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return scans.insert_ignore(have, table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query(with_("event_log") + ", h AS (SELECT max(global_position) AS head FROM event_log), s AS (SELECT 'sub-' || stream_id % 50 AS subscription, max(global_position) FILTER (event_type = 'click') AS position FROM event_log GROUP BY 1) SELECT subscription, coalesce(position, 0) AS position, greatest(0, head - coalesce(position, 0)) AS lag FROM s, h")
def subscription_lag(spark: SparkSession, sf: str) -> DataFrame:
    """How far each subscription, which has come to its last click, is behind the head."""
    from ..streaming.subscriptions import lag

    log = lift.event_log(spark, sf)
    name = F.concat(F.lit("sub-"), (F.col("stream_id") % 50).cast("string"))
    at = log.groupBy(name.alias("subscription")).agg(F.coalesce(F.max(F.when(F.col("event_type") == "click", F.col("global_position"))), F.lit(0)).alias("position"))
    return at.join(lag(scans.head(log), at), "subscription")


@query("SELECT user_id, count(*) AS events, 1::BIGINT AS buckets, true AS within FROM events GROUP BY 1")
def bucket_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a stream go to one bucket out of sixteen."""
    e = table(spark, sf, "events").withColumn("bucket", scans.bucket_of(F.col("user_id"), 16))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("bucket").alias("buckets"), F.bool_and(F.col("bucket").between(0, 15)).alias("within"))
