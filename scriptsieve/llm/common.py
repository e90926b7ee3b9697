"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import storage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for checkpoints and files; see `storage`."""
    folder = storage.shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs on DataFrames made in here removes its shuffle files when it ends; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint; no shuffle files of it stay."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet under the shared folder and read again; for what is too wide for checkpoint()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts can be long: what a task holds at once outside the heap is a batch or two."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: About a row group, the least that a task can read by itself.
ROW_GROUP = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where its files are so few and so small that they would keep fewer busy; else df itself, so no more than a row group a core is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * ROW_GROUP and len(df.inputFiles()) < cores else df


def by_batch(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, rows: int = 512):
    """An iterator function for mapInArrow that calls fn on slices of at most `rows` rows, as Python lists by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


_MEMOS: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Empties the memos of this worker, which a step that needs its memory for something else calls."""
    for memo in list(_MEMOS):
        memo.clear()
        memo.older = {}


class Memo(dict):
    """A dict that computes missing values. When it holds `most` keys they become the older generation, whose keys move back
    as they are asked for again, so that a worker's memory stays bounded and frequent keys stay. Keys longer than `longest` aren't held."""

    __hash__ = object.__hash__

    def __init__(self, fn: Callable, most: int = 200_000, longest: int = 64):
        super().__init__()
        _MEMOS.add(self)
        self.fn, self.most, self.longest, self.older = fn, most, longest, {}

    def missing(self, keys: Iterable) -> list:
        """Those of the keys that are to be held and aren't, once each; put() takes their values, so that they can be computed together."""
        return [k for k in set(keys) if k not in self and k not in self.older and len(k) <= self.longest]

    def put(self, keys: Iterable, values: Iterable) -> None:
        self.older.update(zip(keys, values))

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
