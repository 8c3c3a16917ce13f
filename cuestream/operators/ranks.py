"""Numbers in the order of a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.operators.lineage import checkpointed


def numbered(rows: DataFrame, *order: Column | str, name: str = "nth") -> DataFrame:
    """rows with their place, from 1, in an order that leaves no ties.

    The table is dealt by ranges of the order and sorted within each; a place is the row's within its range and the
    rows of the ranges before. Only counts, one for each range, are summed in one task."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part, within = F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__within")
    dealt = checkpointed(dealt.select("*", part, within))
    counts = dealt.groupBy(F.col("__part").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__of", before.alias("__before"))
    placed = dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))
    return placed.withColumn(name, (F.col("__before") + F.col("__within") + 1).cast("long")).drop("__part", "__within", "__of", "__before")
