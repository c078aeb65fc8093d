"""Canonical event-sourcing tables out of the star schema, and the same as SQL for the oracle.

Times stay TIMESTAMP_NTZ in batch plans. No lift needs a global sort: positions come from the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category ``user``: one stream a user, positions and versions from 1."""
    e = table(spark, sf_dir, "events").withColumn("stream_name", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    # Numbered by the stream's name, so that what groups by stream needs no other exchange.
    version = F.row_number().over(Window.partitionBy("stream_name").orderBy("event_id"))
    return e.select(
        (F.col("event_id") + 1).alias("global_position"), (F.col("user_id") + 1).alias("stream_id"), "stream_name", F.lit("user").alias("category"),
        version.cast("long").alias("stream_version"), "event_id", "event_type", "value", F.col("props").alias("payload"), F.col("ts").alias("created_at"),
    )


def all_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three categories in one order: the position interleaves the ids of events, orders and customers."""
    part = lambda name, key, lane, cat: table(spark, sf_dir, name).select(
        (F.col(key) * 4 + lane).alias("global_position"), F.concat(F.lit(cat + "-"), F.col(key).cast("string")).alias("stream_name"), F.lit(cat).alias("category"), F.col(key).alias("source_id")
    )
    return part("events", "event_id", 1, "event").unionByName(part("orders", "o_orderkey", 2, "order")).unionByName(part("customer", "c_custkey", 3, "customer"))


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as outgoing messages of forty sources; every seventh has no key, some were claimed and not finished."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "sent").when((F.col("o_orderstatus") == "O") & (k % 11 == 0), "publishing").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        k.alias("outbox_id"), F.concat(F.lit("shop-"), (F.col("o_custkey") % 40).cast("string")).alias("source"), F.when(k % 7 != 0, F.col("o_custkey")).alias("message_key"), F.col("o_orderdate").alias("created_at"),
        status.alias("status"), (k % 12).alias("attempts"), (F.col("o_orderdate") + F.make_dt_interval((k % 7).cast("int"))).alias("next_attempt_at"), F.col("o_orderpriority").alias("payload"),
    )


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as deliveries of (source, dedupe_key); ``seq`` names the columns of the delivery order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("dedupe_key"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"),
    )


def timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 5 == 0, "firing").when(k % 13 == 0, "fired").when(k % 17 == 0, "cancelled").otherwise("scheduled")
    return table(spark, sf_dir, "orders").select(
        k.alias("timer_id"), F.lit("orders").alias("owner"), F.col("o_custkey").cast("string").alias("correlation_id"), F.col("o_orderdate").alias("fire_at"),
        status.alias("status"), (k % 9).alias("attempts"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("updated_at"),
    )


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as workflow journals: a turn is a step, and its role with the turn its name."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("workflow_id"), F.col("turn").alias("ordinal"), F.concat_ws(":", "role", F.col("turn").cast("string")).alias("step_name"),
        F.length("text").cast("long").alias("result"), (F.col("conv_id") % 3).cast("int").alias("generation"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.col("user_id").alias("group_key"), (F.col("event_id") % 7).alias("read_ct"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("int"))).alias("visible_at"), F.col("ts").alias("enqueued_at"),
        F.col("props").alias("payload"), F.col("event_type").alias("kind"), (F.col("event_id") % 4).alias("schema_version"),
    )


#: The same lifts for the oracle.
CTE = {
    "event_log": "SELECT event_id + 1 AS global_position, user_id + 1 AS stream_id, 'user-' || user_id AS stream_name, 'user' AS category, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS stream_version, event_id, event_type, value, props AS payload, ts AS created_at FROM events",
    "all_log": "SELECT event_id * 4 + 1 AS global_position, 'event-' || event_id AS stream_name, 'event' AS category, event_id AS source_id FROM events UNION ALL SELECT o_orderkey * 4 + 2, 'order-' || o_orderkey, 'order', o_orderkey FROM orders UNION ALL SELECT c_custkey * 4 + 3, 'customer-' || c_custkey, 'customer', c_custkey FROM customer",
    "outbox": "SELECT o_orderkey AS outbox_id, 'shop-' || o_custkey % 40 AS source, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS message_key, o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderstatus = 'O' AND o_orderkey % 11 = 0 THEN 'publishing' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status, o_orderkey % 12 AS attempts, o_orderdate + to_days((o_orderkey % 7)::INT) AS next_attempt_at, o_orderpriority AS payload FROM orders",
    "inbox": "SELECT l_orderkey AS source, l_linenumber AS dedupe_key, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, l_returnflag AS flag, l_quantity AS quantity FROM lineitem",
    "timers": "SELECT o_orderkey AS timer_id, 'orders' AS owner, o_custkey::VARCHAR AS correlation_id, o_orderdate AS fire_at, CASE WHEN o_orderkey % 5 = 0 THEN 'firing' WHEN o_orderkey % 13 = 0 THEN 'fired' WHEN o_orderkey % 17 = 0 THEN 'cancelled' ELSE 'scheduled' END AS status, o_orderkey % 9 AS attempts, o_orderdate + to_days(1) AS updated_at FROM orders",
    "journal": "SELECT conv_id AS workflow_id, turn AS ordinal, role || ':' || turn AS step_name, length(text) AS result, (conv_id % 3)::INT AS generation FROM conversations",
    "queue": "SELECT event_id AS msg_id, user_id AS group_key, event_id % 7 AS read_ct, ts + to_minutes(event_id % 90) AS visible_at, ts AS enqueued_at, props AS payload, event_type AS kind, event_id % 4 AS schema_version FROM events",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " "
