"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``. Where that is unset, a temporary one if Spark runs in
    this process alone; an error on a cluster, whose machines wouldn't see it.

    The folder is removed when the driver's Python ends.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="firn-shared-")
        root = f"{base.rstrip('/')}/firn-{app}-{uuid.uuid4().hex[:8]}"
        _ROOTS[app] = root
        atexit.register(_remove, weakref.ref(spark), root)
    return _ROOTS[app]


def _remove(ref, root: str) -> None:
    spark = ref()
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the cluster's own clean-up remains
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage and fixes the rows: a stage that is run again after an executor is lost reads the same
    rows in the same files. The shuffle files of the write go at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _WRITTEN.append(path)
    return out


#: Paths of what has been written, oldest first, and those of tables that are still in use here.
_WRITTEN: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def mark() -> int:
    """How much has been written so far, for ``drop_since``."""
    return len(_WRITTEN)


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.remove(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` has written for these tables, when all that is made of them is written itself. Others stay until the driver ends."""
    for df in tables:
        _delete(df.sparkSession, _PATHS.pop(df))


def drop_since(begin: int, *keep: DataFrame) -> None:
    """Delete all that was written after ``mark`` gave ``begin`` but for the tables named."""
    own = {_PATHS[df] for df in keep}
    for path in [p for p in _WRITTEN[begin:] if p not in own]:
        _delete(keep[0].sparkSession, path)


def settle(spark: SparkSession) -> None:
    """Let go of what finished plans have left on the driver: Python's handles, the plans and broadcasts behind them, whose shuffle
    files go with them, and the memory. Spark does the same, but only each half hour."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
    give_back()


_HELD: dict[object, object] = {}


def give_back() -> None:
    """Return what a worker process has freed to the system; allocators keep it otherwise, and workers share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def worker_cache(key: object, make: Callable[[], object], collect: bool = True) -> object:
    """What a worker process keeps from batch to batch, under one key at a time: workers outlive a stage, so the cache of
    another operator goes when the next one begins. ``collect=False`` leaves Python's cycle collector off meanwhile."""
    if key not in _HELD:
        _HELD.clear()
        gc.enable()
        gc.collect()
        give_back()
        _HELD[key] = make()
        if not collect:
            gc.disable()
    return _HELD[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
