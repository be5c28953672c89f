"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which shuffle files go when the query that wrote them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, deleted when the application ends.

    A folder of the machine is taken only where that is unset and driver and
    executors are one process.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="docketlake-")
        _folders[app] = f"{base.rstrip('/')}/docketlake-{app}"
        p, fs = file_system(spark, _folders[app])
        fs.mkdirs(p)
        fs.deleteOnExit(p)  # also where the program has stopped the session
        atexit.register(_end, spark, _folders[app])
    return _folders[app]


def _end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        delete(spark, path)


def file_system(spark: SparkSession, path: str):
    """A path of Hadoop's and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go at their ends."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Lineage ends at files that every executor reads, so a lost executor costs
    one task, and the shuffle files that made the table go. The written table's
    size is known to the optimizer, which then broadcasts it only below its
    threshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docketlake_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut(), once nothing reads them."""
    for df in tables:
        delete(df.sparkSession, df._docketlake_path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, for clusters where it isn't installed."""
    app, root = spark.sparkContext.applicationId, Path(__file__).parent
    if app not in _shipped and root.is_dir():
        _shipped.add(app)
        target = Path(tempfile.mkdtemp(prefix="docketlake-")) / "docketlake.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))


#: Bytes a core of tables that are dealt to all cores.
SMALL_TABLE = 32 << 20


def dealt(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One of fewer files than cores that is also small is dealt to all cores, since a file of one row group is one task; larger ones are read as they are."""
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) < cores:
        p, fs = file_system(spark, path)
        if fs.getContentSummary(p).getLength() < SMALL_TABLE * cores:
            return rows.repartition(cores)
    return rows
