"""Row numbers in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import written

#: Low bits of ``monotonically_increasing_id`` that count within a partition; fixed by Spark.
_WITHIN = (1 << 33) - 1


def numbered(df: DataFrame, name: str, *order: str, first: int = 1) -> DataFrame:
    """Adds consecutive numbers by ``order``, which must be total.

    Rows are dealt by ranges of the order and sorted within; a partition's place in the count comes from the sizes of
    those before it, one row a partition. The dealt rows are written, since sampled ranges may differ on another run.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_WITHIN).alias("_at")), "numbered")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # one row a partition
    return rows.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_at") + first).alias(name))
