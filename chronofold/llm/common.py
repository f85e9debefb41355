"""What the corpus operators share: the shared folder, table access and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts for words name it.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where all run in one JVM, one of our own will do."""
    set_in_session = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_in_session:
        return set_in_session.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="chronofold-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, in a folder of the application that clear_scratch() removes."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _own_folder(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/chronofold/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
        atexit.register(clear_scratch, spark)
    return folder


_folders: dict[str, SparkSession] = {}


def clear_scratch(spark: SparkSession) -> None:
    """Remove what the application's operators have written below the shared folder; results not yet read are lost.

    Called as the driver's process ends; a driver that goes on after its results are written calls it itself.
    """
    for folder in [f for f, s in _folders.items() if s is spark]:
        del _folders[folder]
        with contextlib.suppress(Exception):  # the JVM may be gone
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# what Python workers hold from task to task

_caches: dict[str, Callable[[], None]] = {}
_working_for = ""


def worker_cache(name: str, clear: Callable[[], None]) -> None:
    """Name a cache that an operator's tasks leave in their worker for the next one."""
    _caches[name] = clear


def working_for(name: str = "") -> None:
    """Called as a task begins: what other operators left in this worker is dropped, so that one cache is held at a time."""
    global _working_for
    if _working_for != name:
        for other, clear in _caches.items():
            if other != name:
                clear()
        _working_for = name
        # what allocators keep of it goes back too, as the next operator's share of the executor's memory
        gc.collect()
        give_back()


def give_back() -> None:
    """Called as a task with large batches ends: allocators return what is free to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def row_uid(*columns: str) -> Column:
    """A key for rows that may repeat a doc_id: equal rows share it, different texts do not."""
    return F.xxhash64(*columns)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
