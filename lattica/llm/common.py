"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark's reader alone touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name_or_path: str) -> str:
    """Path of a vocabulary file: a path as it is, a bare name in the shared folder."""
    return name_or_path if os.sep in name_or_path else public_tokenizers.path(name_or_path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, from ``spark.checkpoint.dir``.

    Where it is unset a local one serves on one machine, as in tests; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "/tmp/lattica-checkpoints"
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Lineage ends there, and the files outlive lost executors; they stay until the shared
    folder is cleared.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "durable")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing will read again, lost executors or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(df: DataFrame) -> None:
    """Deletes the files of a ``durable`` table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """A dict that computes missing values and starts afresh at ``limit`` entries.

    Forgetting only costs time, so its memory is bounded and results don't depend on it.
    """

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


_kept: dict = {}


def forget() -> None:
    """Drops what the worker's earlier operators kept and hands the memory back to the system."""
    if _kept:
        _kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
        if trim:
            trim(0)


def worker_kept(make: Callable, *args):
    """What an operator keeps in its worker from task to task, made by ``make(*args)``.

    Workers serve the stages of a job one after the other: what another operator kept goes first,
    so that a worker holds one operator's caches only.
    """
    if (make, args) not in _kept:
        forget()
        _kept[make, args] = make(*args)
    return _kept[make, args]


def in_portions(texts: Iterable[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive lists of texts of about ``most`` characters (a longer text makes a list alone)."""
    portion: list[str] = []
    size = 0
    for text in texts:
        if portion and size + len(text) > most:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text)
    if portion:
        yield portion
