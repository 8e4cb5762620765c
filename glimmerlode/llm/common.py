"""Shared helpers: table access, durable intermediates and word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word and text contracts: space and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = bytes(0x20 if 9 <= c <= 13 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIR: dict[str, str] = {}
_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2048"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = _OWN_DIR.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='glimmerlode-')}")
    return where.rstrip("/")


@contextlib.contextmanager
def stored_plan(spark: SparkSession) -> Iterator[None]:
    """Settings of queries whose result is stored: their shuffle files go as they end, and Arrow batches hold few rows, since JVM and Python each keep whole ones."""
    was = {k: spark.conf.get(k, None) for k in _STORED}
    for k, v in _STORED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at files that outlive executors, its shuffles go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with stored_plan(spark):
        writer = df.select("*").write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind materialized tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


SLICE = 1024  # rows of a batch that are Python objects at once
_MEMO: dict[Any, Any] = {}


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, few at a time."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def worker_memo(key: Any, make: Callable[[], Any]) -> Any:
    """What the tasks of a worker process share under key. A process holds one such thing at a time."""
    if key not in _MEMO:
        drop_memo()
        _MEMO[key] = make()
    return _MEMO[key]


def drop_memo() -> None:
    """Give back what worker_memo holds: worker processes live on, and later stages need the room."""
    if _MEMO:
        _MEMO.clear()
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def squeeze(text: str | None) -> bytes:
    """UTF-8 bytes with every run of contract white space as one space; null counts as empty."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(SPACE_BYTES)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out
