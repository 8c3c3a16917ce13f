"""Work through rows group by group, in order, without a frame of its own for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows given out, and rows unpacked, at a time.
BATCH, SLICE = 4096, 256


def in_groups(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], run: Callable[[Iterable[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """What run makes of each group of rows (records in the given order), as applyInPandas by the keys would give it. rows come from a
    window over the first key, or are dealt by it: they are not sent again.

    A task goes through its sorted rows once and holds what run holds: many small groups cost no more than their rows."""
    # Not a string: tasks have no session to read one with.
    names = StructType.fromDDL(schema)
    dealt = rows.sortWithinPartitions(*keys, *order)

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types, found = to_arrow_schema(names), []

        def given():
            nonlocal found
            columns = zip(*found, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)
            found = []
            return out

        records = (row for batch in batches for at in range(0, batch.num_rows, SLICE) for row in batch.slice(at, SLICE).to_pylist())
        for _, group in groupby(records, key=itemgetter(*keys)):
            for row in run(group):
                found.append(row)
                if len(found) >= BATCH:
                    yield given()
        if found:
            yield given()

    return dealt.mapInArrow(work, names)
