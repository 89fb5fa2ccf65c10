"""Shared folders for intermediate tables and binary files.

Everything that one task writes and another reads lives below the folder that the cluster names in
``spark.checkpoint.dir``.  Tables cut lineage: once written, a lost executor costs a re-read, not a re-run.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch between the JVM and Python, unless the session sets a limit of its own.
BATCH_BYTES = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a session that is one process (tests) gets a folder of its own where none is
    set: on a cluster a folder of one machine would lose what executors write."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        named = _LOCAL[app]
    return named.rstrip("/")


def bounded(spark: SparkSession) -> SparkSession:
    """``spark`` with Arrow batches bounded in bytes, so that long texts don't add up in a batch of many rows."""
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    return spark


Batches = Iterator[pa.RecordBatch]


#: What workers keep from task to task, by the name of its kind.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Return what this process freed to the system."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """Return what the driver's JVM freed outside its heap to the system; a JVM that can't is left alone.

    Hundreds of Spark's threads allocate there, each in one of many arenas, and what they free stays with the process."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # the public face of a class that isn't
        invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def forget_all_but(kind: str | None) -> None:
    for cache in [cache for name, cache in KEPT.items() if name != kind and cache]:
        cache.clear()
        give_back()


def _frugal(run: Callable[[Batches], Batches], keeps: str | None) -> Callable[[Batches], Batches]:
    def held(batches: Batches) -> Batches:
        forget_all_but(keeps)
        try:
            yield from run(batches)
        finally:  # workers are reused: what a task freed goes back to the system, not to the next stage's worker
            give_back()

    return held


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: object, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` whose batches are bounded in bytes and whose workers give memory back after each task.

    keeps: the kind of what its workers keep; they give back all other kinds."""
    bounded(df.sparkSession)
    return df.mapInArrow(_frugal(run, keeps), schema)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and so does what the driver
    held outside its heap for the job."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    give_back_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one number each that a join may broadcast: some 100 MB of an executor's and of the driver's memory.
FEW = 2_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame | None:
    """``df`` (written, of narrow rows) to be broadcast, if it has at most ``most`` rows; else None: then a join shuffles."""
    return F.broadcast(df) if df.count() <= most else None


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``uri`` (file, hdfs, s3, gs) and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
