"""What driver and executors share: a folder, tables in it, and this package's code."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the session is local a temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered for release()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; for when its results have been stored elsewhere."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    This cuts the lineage: an executor that is lost afterwards takes nothing with it,
    and Spark plans what follows with the table's true size.  The shuffle files of the
    write are dropped when it has ended.
    """
    return _write(df, shared_path(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are needed until a result is written, and then deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.append(path)
        return _write(df, path)

    def release(self) -> None:
        _delete(self.spark, self.paths)
        made = _made.get(self.spark.sparkContext.applicationId, [])
        made[:] = [p for p in made if p not in set(self.paths)]
        self.paths = []


#: Bytes of an Arrow batch, unless the session sets its own: what a Python worker holds of one at a time.  The JVM
#: holds vectors and stream buffers for it, which grow by doubling, outside its heap.
ARROW_BYTES = 2 << 20
_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)


def ship(spark: SparkSession) -> None:
    """Make the session ready for Python on its executors: small Arrow batches, and, once a context, this package."""
    if spark.conf.get(_BATCH).rstrip("b") == _SPARKS_OWN:
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / f"{package.name}-{os.getpid()}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc)
