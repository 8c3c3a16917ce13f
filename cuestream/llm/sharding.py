"""Shards of near equal bytes by sampled splitters; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.llm.common import checkpointed, table

N_SHARDS = 16
#: Ranges: one for so many bytes, within these bounds. All tables of ranges are this small.
RANGE_BYTES, MIN_RANGES, MAX_RANGES = 64 << 20, 4096, 16384
#: Expected keys in the sample for each range.
KEYS_PER_RANGE = 16
#: A range is overfull beyond so many times its share; its records are dealt to subranges.
OVERFULL = 2.0
PREFIX_BITS = 12


def shard(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, size, text_crc32, law, shard, slot, grown_shard: one row for each row of docs.

    Law `bytes`: the shards' sizes are near equal, to within a range (1/256 of a shard, or one
    document where that is larger). A null text has size 1 and the crc32 of no bytes. Repeated rows get a
    slot each; ties in the key are ordered by id. Extra columns are left out. An empty table gives
    an empty result. The key is a hash of the text, so copies lie together, and then the id: a range
    that copies of one text make overfull is divided by the id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")
        )
    )
    total = records.agg(F.sum("size")).first()[0] or 1
    n_ranges = min(MAX_RANGES, max(MIN_RANGES, total // RANGE_BYTES))

    # Each record is drawn with a chance in proportion to its size, by a hash of what it is.
    chance = F.col("size") * (KEYS_PER_RANGE * n_ranges / total)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "key"), 11) / F.lit(float(1 << 53))
    quantiles = F.percentile_approx("key", F.lit([k / n_ranges for k in range(1, n_ranges)]), 10 * n_ranges)
    splitters = records.where(draw < chance).agg(F.array_distinct(quantiles).alias("at"))
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    at = F.array_distinct(F.concat(F.array(low), F.coalesce("at", F.array().cast("array<bigint>"))))
    ranges = splitters.select(at.alias("at")).select(F.posexplode("at").alias("range", "low"), F.col("at"))
    ranges = ranges.select("range", "low", F.coalesce(F.get("at", F.col("range") + 1) - 1, high).alias("last"))
    prefix = lambda c: F.shiftright(F.col(c), 64 - PREFIX_BITS)
    ranges = checkpointed(ranges.select("range", "low", "last", F.explode(F.sequence(prefix("low"), prefix("last"))).alias("prefix")))

    inside = (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("last"))
    ranged = records.withColumn("prefix", prefix("key")).join(F.broadcast(ranges), "prefix").where(inside).drop("prefix", "low", "last")
    share = total / n_ranges
    overfull = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * share)
    overfull = checkpointed(overfull.select("range", F.ceil(F.col("bytes") / share).alias("parts")))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.col("parts"))).cast("long")
    placed = ranged.join(F.broadcast(overfull), "range", "left").withColumn("part", part).drop("parts")

    units = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("bytes").over(W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = (before + F.col("bytes") / 2) * n_shards / F.lit(float(total))
    units = units.withColumn("shard", F.least(F.floor(middle), F.lit(n_shards - 1)).cast("int"))
    first = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    units = checkpointed(units.select("range", "part", "shard", first.alias("first")))
    within = F.row_number().over(W.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32"))
    return placed.join(F.broadcast(units), ["range", "part"]).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_sampled_splitters": op7_sampled_splitters}
ORACLES: dict[str, str] = {}
