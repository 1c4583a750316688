"""Session helpers that any part of the package may use."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Python workers get at once, at most, unless the session says otherwise.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` after which the worker's memory is given back."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it. Batches are bounded in rows and in bytes, as rows
    may be long texts; a bound that the session was given stays. (Plans read these settings when they run, so they cannot be set back here.)"""
    given = spark.conf.getAll
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in given:
            spark.conf.set(key, most)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tessera-code-")  # of the driver, which serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{_PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent).as_posix())
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) gets a new local
    folder as its checkpoint folder; on a cluster that would be a folder that executors do not see, so it fails there."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[(\*|\d+)(, *\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Lists of the paths made since a ``scratch`` was entered, the innermost last.
_scratches: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _scratches:
        _scratches[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete what was written under a path, wherever Spark can write."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Everything that is materialised within is deleted at the end. Results that are still needed then must have been written to a path made before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete everything that this application has materialised. Call it when results were consumed."""
    delete(spark, f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, h: str, most: int, bits: int = 12) -> DataFrame:
    """The rows of ``df`` with the smallest values of the 64-bit hash column ``h``: at most ``most``, and all rows if there are no more than that.
    Rows are counted by leading bits, in a histogram of fixed length, and only the bucket in which the bound is passed is counted by the next bits,
    so no rows are sorted and none but histograms reach the driver. Rows of one hash are taken or left together."""
    within, left, used = df, most, 0
    while True:
        used += bits
        lead = F.shiftrightunsigned(F.col(h), 64 - used)
        counts = sorted((r["lead"], r["n"]) for r in within.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).collect())
        for at, n in counts:
            if n > left:
                break
            left -= n
        else:
            return df
        if left == 0 or used + bits > 60:
            return df.where(lead < at)
        within = df.where(lead == at)
