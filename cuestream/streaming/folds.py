"""The queue's events and the readings of streams as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from cuestream.functions.readings import key
from cuestream.operators import jobs
from cuestream.operators.lineage import shared_folder

RUN = "stream_id long, key string, n long, first_frame long, last_frame long, start_us long, end_us long, refused boolean"


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a streaming query over all that is there; its last output, from the shared folder."""
    spark, folder = stream.sparkSession, _shared(stream.sparkSession)

    def keep(batch: DataFrame, epoch: int) -> None:
        # A batch that is run again after a failure overwrites what it had written.
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch:08d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete":
        last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=0)
        return spark.read.schema(stream.schema).parquet(f"{folder}/out/epoch={last:08d}")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/epoch=*")


def fold_events(events: DataFrame) -> DataFrame:
    """A stream of worker events to the running state of each job; the fold is the batch one, kept up to date."""
    return jobs.fold_events(events)


class _Open:
    """The open run of a stream (none if n is 0) and the last start that was taken in."""

    def __init__(self, values=("", 0, 0, 0, 0, 0, -(1 << 63))):
        self.key, self.n, self.first, self.last, self.start, self.end, self.seen = values

    def values(self) -> tuple:
        return self.key, self.n, self.first, self.last, self.start, self.end, self.seen

    def close(self) -> list[tuple]:
        done = [(self.key, self.n, self.first, self.last, self.start, self.end, False)] if self.n else []
        self.n = 0
        return done

    def take(self, row) -> list[tuple]:
        """What a row finishes: a run, or the row itself if it comes too late."""
        if row.text is None:
            return self.close()
        k = key(row.text)
        if row.start_us <= self.seen:
            return [(k, 0, row.frame, row.frame, row.start_us, row.end_us, True)]
        done = [] if self.n and k == self.key else self.close()
        if not self.n:
            self.key, self.first, self.start = k, row.frame, row.start_us
        self.n, self.last, self.end, self.seen = self.n + 1, row.frame, row.end_us, row.start_us
        return done


def encode_runs(rows: DataFrame) -> DataFrame:
    """A stream of observations (stream_id, frame, start_us, end_us, text) to its finished runs.

    The state of a stream is its open run and the last start: a run is given out when another key begins, or at an
    end mark, a row without text that starts after all others. Rows that do not start after the last one are given
    out as `refused`, with n 0, for whoever watches the stream. Rows of one micro-batch are put in order first."""

    def run(stream, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current, done = _Open(state.get) if state.exists else _Open(), []
        for row in pd.concat(list(batches)).sort_values(["start_us", "frame"]).itertuples(index=False):
            done += current.take(row)
        state.update(current.values())
        yield pd.DataFrame([(stream[0], *x) for x in done], columns=[c.strip().split(" ")[0] for c in RUN.split(",")])

    kept = "key string, n long, first_frame long, last_frame long, start_us long, end_us long, last_us long"
    return rows.groupBy("stream_id").applyInPandasWithState(run, RUN, kept, "append", "NoTimeout")
