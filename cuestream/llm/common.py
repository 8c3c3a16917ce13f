"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import pathlib
import shutil
import sys
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is set and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    folder = tempfile.mkdtemp(prefix="shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that later jobs survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write df once, compressed, in the shared folder and read it back. Unlike a checkpoint, the table read back
    does not keep the shuffle files of its making alive (see release)."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; they need not have it installed."""
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        root = pathlib.Path(__file__).parents[1]
        folder = tempfile.mkdtemp()  # served by the driver for as long as it lives
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, str(source.relative_to(root.parent)))
        spark.sparkContext.addPyFile(f"{folder}/{root.name}.zip")
        _shipped = spark.sparkContext.applicationId


#: What a worker process may forget between stages: memos, and models that are cheap to open again.
_memos: weakref.WeakValueDictionary = weakref.WeakValueDictionary()
_forget: list[Callable[[], None]] = []
_stage: int | None = None


def forgotten_between_stages(forget: Callable[[], None]) -> None:
    _forget.append(forget)


def begin_task() -> None:
    """Workers are reused: at the first task of another stage drop what the last one remembered, and give the memory back."""
    global _stage
    context = TaskContext.get()
    if context is None or context.stageId() == _stage:
        return
    _stage = context.stageId()
    for memo in list(_memos.values()):
        memo.forget()
    for forget in _forget:
        forget()
    trim()


def trim() -> None:
    """Give freed memory back to the system where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to column dictionaries; casts them to schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        begin_task()
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def held_out(doc_id: str, divisor: int, remainder: int):
    """crc32 of the id as text, modulo a divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % divisor == remainder


class TwoGenerations(dict):
    """A memo bounded by bytes: when a generation is full the entries not used since the last turn are dropped."""

    ENTRY_BYTES = 100

    def __init__(self, make: Callable[[Any], Any], size: int):
        super().__init__()
        self.make, self.size, self.used, self.old = make, size, 0, {}
        _memos[id(self)] = self

    def forget(self) -> None:
        self.clear()
        self.used, self.old = 0, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        used = self.ENTRY_BYTES + sys.getsizeof(key) + sys.getsizeof(value)
        if used > self.size // 8:
            return value  # a giant is not worth the room of many
        if self.used + used > self.size:
            self.old, self.used = dict(self), 0
            self.clear()
        self[key] = value
        self.used += used
        return value
