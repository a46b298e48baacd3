"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs in one process, as in
    local tests; on a cluster each machine would write to a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and later
    steps that use ``df`` twice do not compute it twice. ``forget`` deletes it.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_at = path
    return found


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(*frames: DataFrame) -> None:
    """Deletes what ``staged`` wrote. Only for tables whose every reader has been written itself."""
    for df in frames:
        delete(df.sparkSession, df.staged_at)


def with_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: it is sent to the executors once, as an archive."""
    sc = spark.sparkContext
    if getattr(sc, "quillmesh_sent", None) is None:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="quillmesh-")) / f"quillmesh-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))  # the driver serves it; executors keep copies of their own
        sc.quillmesh_sent = str(archive)
    return spark


_Made = TypeVar("_Made")
_ENGINE: dict[tuple, object] = {}


def engine(key: tuple, make: Callable[[], _Made]) -> _Made:
    """What a Python worker has loaded for ``key``: one thing at a time.

    Spark reuses workers, so that what an earlier query loaded would stay beside the new one.
    """
    if key not in _ENGINE:
        _ENGINE.clear()
        gc.collect()
        _ENGINE[key] = make()
    return _ENGINE[key]


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % m


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``most`` bytes of ``column`` or one row."""
    n, start, held = batch.num_rows, 0, 0
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for i in range(n):
        if i > start and (held + int(sizes[i]) > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(sizes[i])
    if start < n:
        yield batch.slice(start, n - start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts one by one; null counts as empty."""
    for x in batch.column(column):
        yield x.as_py() or ""
