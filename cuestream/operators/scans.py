"""Which frames of a scan one recognition may serve."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuestream.operators import evidence as E
from cuestream.operators import masks as M
from cuestream.operators.streams import in_groups

# Seconds that a group may last, and bytes that it may hold.
GROUP_S, GROUP_BYTES = 1.5, 64 << 20

LEADER = "stream_id long, frame long, leader long"


def scan_groups(rows: DataFrame, masks: DataFrame, seconds: float = GROUP_S, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """stream_id, frame, leader: the first frame of each frame's group. A frame begins a group if its mask is not compatible with
    the leader's, if the leader began seconds ago or more, or if the group's masks fill most_bytes.

    Frames without any pixel are compatible with none, so streams are cut before each of them: no task works through more than
    what is shown without a blank."""
    met = rows.select("stream_id", "frame", "start").join(masks, ["stream_id", "frame"])
    w = W.partitionBy("stream_id").orderBy("frame")
    # Only masks with a pixel are sent to Python; frames without any are their own leaders.
    shown = met.withColumn("bits", F.when(F.hex("bits").rlike("[^0]"), F.col("bits")))
    new = F.col("bits").isNull() | F.lag("bits").over(w).isNull()
    cut = shown.withColumn("part", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))

    def run(part: Iterable[dict]) -> Iterable[tuple]:
        leader, held = None, 0
        for row in part:
            if row["bits"] is None:
                yield (row["stream_id"], row["frame"], row["frame"])
                continue
            size = row["height"] * row["width"]
            if leader is None or row["start"] - leader["start"] >= seconds or held + size > most_bytes or not serves(leader, row):
                leader, held = row, 0
            held += size
            yield (row["stream_id"], row["frame"], leader["frame"])

    return in_groups(cut, ("stream_id", "part"), ("frame",), run, LEADER)


def serves(leader: dict, row: dict) -> bool:
    """Whether the masks of two frames are compatible; the leader's is unpacked once."""
    if "mask" not in leader:
        leader["mask"] = E.unpacked(leader["height"], leader["width"], leader["bits"])
        leader["itself"] = bool(M.compatible(leader["mask"], leader["mask"]))
    if all(leader[k] == row[k] for k in ("height", "width", "bits")):
        return leader["itself"]
    return bool(M.compatible(leader["mask"], E.unpacked(row["height"], row["width"], row["bits"])))
