"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuestream.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step of large or small stars: neighbours move to the least node that they share a node with."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("of"))
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("of").alias("u"), F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that has a link; links has columns u, v.

    Large and small stars alternate until nothing moves; each round is checkpointed, and only a count
    and a checksum of the links reach the driver. Loops and repeated links do no harm.
    """
    links = checkpointed(links.where(F.col("u") != F.col("v")).select("u", "v").distinct())
    state = None
    while True:
        links = checkpointed(_star(_star(links, True), False))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
