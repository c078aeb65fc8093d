"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir, written  # noqa: F401  (the operators take them from here)

#: Rows of one Arrow batch sent to Python. Whole texts travel in these batches, so the row
#: count bounds the memory of a worker; one very long text still travels alone in its row.
ARROW_ROWS = 512
ARROW_BYTES = 2 << 20
#: Most bytes that an operator broadcasts, after counting the rows.
BROADCAST_BYTES = 16 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/foldline-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lowers the size of an Arrow batch, so that a batch of whole texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def text_bytes(df: DataFrame) -> Column:
    """Bytes of a row's texts, alone and in arrays."""
    out = F.lit(0).cast("long")
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            out = out + F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 24), F.lit(0))
    return out


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a written table for broadcast if it proves to take at most BROADCAST_BYTES; else it joins by shuffle.
    row_bytes: of a row without its texts, which are measured."""
    n, texts = df.agg(F.count(F.lit(1)), F.sum(text_bytes(df))).first()
    return F.broadcast(df) if n * row_bytes + (texts or 0) <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, by: int) -> Column:
    """crc32 of the id written as text, modulo ``by``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


def chunks(texts: Iterable[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(position of the first, texts) runs of about ``most`` characters; None becomes empty."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        if run and size + len(text or "") > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(text or "")
        size += len(text or "")
    if run:
        yield first, run


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of a 64-bit hash (splitmix64); fixed values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
