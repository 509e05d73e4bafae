"""Shared-folder helpers: written tables instead of local checkpoints, and memory-mapped files.

Everything that outlives one Spark job goes to the folder that the cluster names in
``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import mmap
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder (URI) that the driver and all executors can reach: below ``spark.checkpoint.dir``, or in a local session
    without that setting a folder of this process. On a cluster the setting must be there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + _own_folder()
    if "://" not in root and not root.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        root = default.rstrip("/") + root if not default.startswith("file:") else "file://" + root
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}"


_own: list[str] = []


def _own_folder() -> str:
    """One folder a process for local sessions, removed when the process ends."""
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quire-shared-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return _own[0]


def shards(df: DataFrame, each: int = 64 << 20) -> int:
    """In how many shards to deal what is counted over ``df``: as many as a shuffle has partitions, and more for large
    inputs, so that a task holds the counts of about ``each`` bytes of input at once."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // each)) if size < 1 << 60 else least


def deal(blocks: DataFrame, shards: int) -> DataFrame:
    """Rows with a column ``shard``: consecutive shards go to one partition, where they come one after another."""
    parts = min(shards, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.floor(F.col("shard").cast("long") * parts / shards).cast("int")
    return blocks.repartitionById(parts, at).sortWithinPartitions("shard")


BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While an action runs, batches between Spark and Python hold about ``size``; the session's own setting comes back."""
    before = spark.conf.get(BYTES)
    spark.conf.set(BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BYTES, before)


def give_back() -> None:
    """Return memory that this process has freed, and its allocators still hold, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which its worker gives back memory: a worker stays for a minute, beside steps that need the memory."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Workspace:
    """Names the tables and files of one operator run. What has served is dropped on the way; what the result still
    reads goes when the driver's process ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        _open.add(self.root)
        _closing(spark)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the table read back: this cuts the lineage, and a lost
        executor costs only a new read."""
        at = self.path(name)
        with small_batches(self.spark):
            df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quire_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            at = getattr(df, "_quire_path", None)
            if at:
                self.delete(at)

    def tidy(self) -> None:
        """Have the driver collect its garbage: Spark then removes the shuffle files of steps whose results are written."""
        gc.collect()
        self.spark._jvm.System.gc()

    def delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_open: set[str] = set()
_watched: set[str] = set()


def _closing(spark: SparkSession) -> None:
    """Once an application: remove the folders of all runs before the session stops."""
    app = spark.sparkContext.applicationId
    if app in _watched:
        return
    _watched.add(app)
    context = spark.sparkContext
    stop = context.stop

    def cleared():
        sweep(spark)
        stop()

    context.stop = cleared
    atexit.register(sweep, spark)


def sweep(spark: SparkSession) -> None:
    """Remove the folders of all runs of this process."""
    if spark.sparkContext._jsc is None:
        return
    for root in list(_open):
        _open.discard(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def local_path(uri: str) -> str | None:
    """The path of a file: URI (a mount shared by all machines), else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put(uri: str, data: bytes) -> None:
    """Write a whole file under its final name at once, so a retried or doubled task does no harm."""
    with writing(uri) as f:
        f.write(data)


@contextlib.contextmanager
def writing(uri: str):
    """A stream whose file appears under its final name when all is written; after an error nothing is left."""
    at = local_path(uri)
    if at is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        half = f"{at}.{uuid.uuid4().hex}.part"
        try:
            with open(half, "wb") as f:
                yield f
            os.replace(half, at)
        finally:
            if os.path.exists(half):
                os.remove(half)
        return
    store, path = _filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    half = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(half) as f:
        yield f
    store.move(half, path)


def get(uri: str, start: int = 0, size: int | None = None) -> bytes:
    """Read a byte range of a file."""
    at = local_path(uri)
    if at is not None:
        with open(at, "rb") as f:
            f.seek(start)
            return f.read(-1 if size is None else size)
    store, path = _filesystem(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def length(uri: str) -> int:
    at = local_path(uri)
    if at is not None:
        return os.path.getsize(at)
    store, path = _filesystem(uri)
    size = store.get_file_info(path).size
    if size is None:
        raise FileNotFoundError(uri)
    return size


def listed(uri: str) -> list[str]:
    """Names of the whole files in a folder, in order; none if there is no such folder."""
    at = local_path(uri)
    if at is not None:
        names = os.listdir(at) if os.path.isdir(at) else []
    else:
        from pyarrow import fs

        store, path = _filesystem(uri)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True))]
    return sorted(x for x in names if not x.endswith((".part", ".crc")))


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file, memory-mapped. A file in a remote store is first copied beside the worker;
    the copy's name is removed at once, so nothing stays behind when the worker ends."""
    at = local_path(uri)
    if at is not None:
        if os.path.getsize(at) == 0:
            return np.empty(0, np.uint8)
        with open(at, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
    store, path = _filesystem(uri)
    with tempfile.TemporaryFile() as f:
        with store.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                f.write(block)
        f.flush()
        if f.tell() == 0:
            return np.empty(0, np.uint8)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
