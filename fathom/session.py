"""Session helpers shared by operators: shipping the package, shared folders, materialised tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_fathom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="fathom-"), "fathom_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._fathom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: a folder of our own if all runs in
    one process, else an error, as no folder of this machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark.sparkContext, "_fathom_dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="fathom-shared-")
            spark.sparkContext._fathom_dir = root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one intermediate table; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/fathom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


#: Shuffle files of a finished write are of no more use, as what it wrote is in the shared folder.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_TIDY)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._fathom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what materialise() wrote for these tables, before the driver ends. No plan may read them any more."""
    for t in tables:
        path = t.__dict__.pop("_fathom_path", None)
        if path:
            remove(t.sparkSession, path)
            _made.remove((t.sparkSession, path))


def spread(df: DataFrame, *by: str, each: int = 2) -> DataFrame:
    """Rows dealt over all cores by these columns: a small file is else read, and all that follows done, by one task. each: tasks a core."""
    return df.repartition(max(8 * each, each * df.sparkSession.sparkContext.defaultParallelism), *by)


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name)
        out.append(name)
    return tuple(out)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Returns freed memory of this process to the system: a Python worker that waits for its next task else keeps it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries other than glibc
        ctypes.CDLL(None).malloc_trim(0)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session may have ended; the folder then belongs to its owner
            return
