"""Exact deduplication as a stateful stream, in DataFrame operations alone.

A feed of (digest, id, locator) rows, one a document, is written to the shared folder. A structured stream
folds it into keyed state: for each digest the largest id, where that row's content lies, and the number of
rows. The state is kept on disk by RocksDB and never expires, so a later feed into the same ``Dedup`` folder is
held against everything seen before. A digest seen once is done. On a hit, that is a digest with more rows, the
full bytes decide: the contents of all its rows, those of earlier feeds too, are fetched by their locators and
grouped by digest and whole text, pre-aggregated before they are shuffled.

A locator is a Parquet file and the row's place in it. Documents that aren't read straight from Parquet files have
none; they are written into the folder first.

Defined cases: null and empty texts are equal; a null id counts as a row and is never preferred to another id;
of repeated rows with one id one is as good as the other, and all of them are kept if that id is the one that
stays; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, scratch, spare, written

#: State on disk. Without preallocation a small partition's state takes no more disk than its rows need; all the
#: stores of an executor share one bounded memory. A store is closed with the task that commits it, so an executor has
#: as many open as it runs tasks, however many partitions there are; what each takes beside that memory isn't bounded.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _as_read(docs: DataFrame, column: str) -> bool:
    """Whether a column is one of the only table that the rows come from, as it is there."""
    plan = docs.select(column)._jdf.queryExecution().analyzed()
    leaves, wanted = plan.collectLeaves(), plan.output().apply(0)
    if leaves.size() != 1:
        return False
    table = leaves.apply(0).output()
    return any(table.apply(i).semanticEquals(wanted) and table.apply(i).name() == column for i in range(table.size()))


class Dedup:
    """State in a folder: ``feed`` takes a batch of documents in and returns what is now known of their digests (a row for
    each micro-batch that a digest came in, as a rule one), ``state`` reads what is known of all, and ``decided`` tells
    the last feed's documents apart by their whole texts."""

    def __init__(self, spark: SparkSession, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.spark, self.folder, self.id_col, self.text_col = spark, folder or scratch(spark, "dedup"), id_col, text_col
        self.last, self.seen = "", None

    def located(self, docs: DataFrame) -> DataFrame:
        """digest, doc_id, locator of each row."""
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        wanted = [F.unhex(digest(F.col(self.text_col))).alias("digest"), F.col(self.id_col).cast("long").alias("doc_id"), place.alias("locator")]
        if _as_read(docs, self.text_col):
            try:
                return docs.select(*wanted)
            except AnalysisException:  # not from Parquet files
                pass
        path = f"{self.folder}/texts-{uuid.uuid4().hex}"
        docs = docs.select(self.id_col, self.text_col)
        docs.write.parquet(path)
        return self.spark.read.schema(docs.schema).parquet(path).select(*wanted)

    def feed(self, docs: DataFrame) -> DataFrame:
        spark, self.last = self.spark, uuid.uuid4().hex
        rows = self.located(docs).withColumn("feed", F.lit(self.last))
        rows.write.mode("append").parquet(f"{self.folder}/feed")
        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            stream = spark.readStream.schema(rows.schema).parquet(f"{self.folder}/feed")
            known = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
            known = known.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.locator").alias("locator"), "n")
            out = f"{self.folder}/seen-{self.last}"
            # By range: createDataFrame would start Python on the executors, and its daemon stays.
            spark.range(0).select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in known.schema]).write.parquet(f"{out}/batch=-1")
            # Written on the executors; a micro-batch that runs again replaces its own folder.
            write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
            query = known.writeStream.outputMode("update").foreachBatch(write).trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/state").start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        self.rows = spark.read.schema(rows.schema).parquet(f"{self.folder}/feed")
        self.seen = spark.read.schema(known.schema).parquet(f"{out}/batch=*")
        return self.seen

    def state(self) -> DataFrame:
        """digest, keep_id, locator, n: one row a digest ever fed."""
        read = self.spark.read.format("statestore").load(f"{self.folder}/state")
        return read.select("key.digest", F.col("value.max.doc_id").alias("keep_id"), F.col("value.max.locator").alias("locator"), F.col("value.count").alias("n"))

    def fetched(self, rows: DataFrame) -> DataFrame:
        """Rows (digest, doc_id, locator, feed) with their texts, read by the locators."""
        files = [x["file"] for x in rows.select("locator.file").distinct().collect()]  # names of files, not of documents
        if not files:
            return rows.select("digest", "doc_id", "feed", F.lit("").alias("text"))
        texts = self.spark.read.schema(f"`{self.text_col}` string").parquet(*map(unquote, files))
        texts = texts.select(F.coalesce(F.col(self.text_col), F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        wanted = rows.select("digest", "doc_id", "feed", "locator.file", "locator.row")
        return texts.join(broadcast_if_small(wanted, 64), ["file", "row"]).select("digest", "doc_id", "feed", "text")

    def decided(self) -> DataFrame:
        """digest, doc_id, keep_id, n of each row of the last feed, over all feeds; n is null for a digest seen once."""
        hits = written(self.seen.filter("n > 1").select("digest").distinct(), "hits")
        texts = self.fetched(written(self.rows.join(broadcast_if_small(hits, 48), "digest"), "hit-rows"))
        # Full bytes of the hits: one class a distinct text, whatever its digest.
        classes = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        narrow = written(classes.select("digest", "keep_id", "n"), "classes")
        split = written(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest"), "split")
        rows = self.rows.filter(F.col("feed") == self.last).select("digest", "doc_id")
        if not split.count():
            return rows.join(narrow, "digest", "left")
        # Two texts with one digest: these rows are told apart by their text.
        apart = texts.filter(F.col("feed") == self.last).join(split, "digest", "left_semi").join(classes, ["digest", "text"]).select("digest", "doc_id", "keep_id", "n")
        return rows.join(split, "digest", "left_anti").join(narrow, "digest", "left").unionByName(apart)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Dedup | None = None) -> DataFrame:
    """Per document: doc_id, keep_id (the largest id of its text), group_size, kept, text_sha256. known: what earlier
    feeds are in already; a new one if none is given."""
    known = known or Dedup(docs.sparkSession, None, id_col, text_col)
    known.feed(docs)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return known.decided().select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the rows that ``dedup`` drops, with all their columns; of repeated rows one stays."""
    found = dedup(docs, id_col, text_col).filter("group_size > 1")
    kept = F.col("kept")
    # Ids of copies: of a dropped row, or of a kept one that comes more than once.
    copies = found.groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    name, mark, keeps = (spare(docs, x) for x in ("_copy_id", "_copy_digest", "_copy_kept"))
    copies = written(copies.filter(~kept | (F.col("n") > 1)).select(F.col("doc_id").alias(name), F.unhex("text_sha256").alias(mark), kept.alias(keeps)), "copies")
    same = F.col(id_col).cast("long").eqNullSafe(F.col(name)) & (F.unhex(digest(F.col(text_col))) == F.col(mark))
    rest = docs.join(broadcast_if_small(copies, 64), same, "left_anti")
    again = written(copies.filter(F.col(keeps)), "again")
    if again.count():
        once = docs.join(broadcast_if_small(again, 64), same, "left_semi").dropDuplicates([id_col, text_col])
        rest = rest.unionByName(once)
    return rest
