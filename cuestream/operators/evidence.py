"""Evidence for repairs: pairs of frames whose masks are compared, and second readings of a frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from cuestream.functions import readings as R
from cuestream.operators.lineage import checkpointed

MASK = "stream_id long, frame long, height int, width int, bits binary"
#: A type and not its name: this module is also read where there is no session.
SPAN = StructType([StructField("low", IntegerType()), StructField("high", IntegerType())])

Test = Callable[[np.ndarray, np.ndarray, object], bool]


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else R.likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def related(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is not None and y is not None and R.related(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(SPAN)
def glyph_disagreement(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The span of a that one slip explains; null if none does."""
    spans = [None if x is None or y is None else R.glyph_disagreement(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame([s or (None, None) for s in spans], columns=["low", "high"]).astype("Int32")


def packed(mask: np.ndarray) -> dict:
    """The columns of a mask."""
    return {"height": mask.shape[0], "width": mask.shape[1], "bits": np.packbits(mask).tobytes()}


def unpacked(height: int, width: int, bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Bounds within the frame."""
    low, high = (lambda v: F.greatest(F.lit(0.0), v)), (lambda v: F.least(F.lit(1.0), v))
    return F.struct(low(left).alias("left"), low(top).alias("top"), high(right).alias("right"), high(bottom).alias("bottom"))


def padded(bounds: Column, dx: float, dy: float) -> Column:
    return F.when(bounds["left"].isNotNull(), box(bounds["left"] - dx, bounds["top"] - dy, bounds["right"] + dx, bounds["bottom"] + dy))


def union(a: Column, b: Column) -> Column:
    """The bounds of both; of one where the other is null."""
    return F.struct(
        F.least(a["left"], b["left"]).alias("left"), F.least(a["top"], b["top"]).alias("top"), F.greatest(a["right"], b["right"]).alias("right"), F.greatest(a["bottom"], b["bottom"]).alias("bottom")
    )


def tested(pairs: DataFrame, masks: DataFrame, test: Test, name: str = "alike") -> DataFrame:
    """pairs (stream_id, a, b and whatever the test needs) with whether the masks of frames a and b pass the test.

    A frame without a mask proves nothing. Only masks of frames that are asked for are sent, once for each pair: what makes or reads
    the masks sees the frames first. Pairs are worked out once."""
    pairs = checkpointed(pairs)
    ids = [c for c in pairs.columns]
    asked = lambda side: masks.join(pairs.select("stream_id", F.col(side).alias("frame")), ["stream_id", "frame"], "left_semi")
    of = lambda side: asked(side).select(F.col("stream_id").alias(f"__{side}s"), F.col("frame").alias(f"__{side}f"), F.struct("height", "width", "bits").alias(f"__{side}"))
    met = pairs
    for side in ("a", "b"):
        met = met.join(of(side), (F.col("stream_id") == F.col(f"__{side}s")) & (F.col(side) == F.col(f"__{side}f")), "left").drop(f"__{side}s", f"__{side}f")

    def run(batches):
        for pdf in batches:
            alike = []
            for row in pdf.to_dict("records"):
                one, two = row["__a"], row["__b"]
                alike.append(bool(one is not None and two is not None and test(unpacked(**one), unpacked(**two), row)))
            yield pdf[ids].assign(**{name: alike})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + f", {name} boolean"
    return met.mapInPandas(run, schema)


def within(test: Callable) -> Test:
    """A test on the parts of both masks within the pair's bounds."""
    from cuestream.operators.masks import cut

    def run(a: np.ndarray, b: np.ndarray, row) -> bool:
        if row["bounds"] is None:
            return False
        bounds = [row["bounds"][k] for k in ("left", "top", "right", "bottom")]
        return bool(test(cut(a, bounds), cut(b, bounds)))

    return run


def glyphs(a: np.ndarray, b: np.ndarray, row) -> bool:
    """The disputed glyph of the pair's line is the same in both."""
    from cuestream.operators.masks import glyph_region_match

    sides = [[row[k][c] for c in ("x", "y", "w", "h")] if row[k] is not None else None for k in ("a_box", "b_box")]
    return None not in sides and glyph_region_match(a, b, *sides, row["text"], (row["low"], row["high"]))


def reread(rows: DataFrame, recheck: DataFrame | None) -> DataFrame:
    """rows (stream_id, frame, ...) with `read` and `read_confidence`, what a second reader says of the frame: null where
    it said nothing, or is not there at all, which proves nothing."""
    if recheck is None:
        return rows.withColumn("read", F.lit(None).cast("string")).withColumn("read_confidence", F.lit(None).cast("double"))
    said = recheck.groupBy("stream_id", "frame").agg(F.max(F.struct("confidence", "text")).alias("__r"))
    return rows.join(said, ["stream_id", "frame"], "left").withColumn("read", F.col("__r.text")).withColumn("read_confidence", F.col("__r.confidence")).drop("__r")
