"""Written tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again. The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset, on a local master (as in tests), a
temporary folder of this process stands in for it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that a task sorts or aggregates where tasks are as many as the rows take.
TASK_ROWS = 500_000
_LOCAL: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The URI of the shared folder for this application's tables."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        base = "file://" + _LOCAL["dir"]
    return f"{base.rstrip('/')}/weftline-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Gives the list of paths made while it lasts; those still in it at the end are deleted."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        drop_path(spark, *_SCRATCH.pop())


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def parts_of(rows: int) -> int:
    """Tasks for so many narrow rows: what one holds in memory doesn't depend on their number."""
    return max(1, min(-(-rows // TASK_ROWS), 10_000))


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another state is another table."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(target)))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the shared folder; a reader sees the old one or the new one."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".new")
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    store.delete(target, False)
    store.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What ``write_text`` wrote; None if there is no such file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def drop_all(spark: SparkSession) -> None:
    """Delete everything that this application wrote in the shared folder: at its end."""
    drop_path(spark, shared_dir(spark))


def col(name: str) -> Column:
    """The column of this very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that clash with none of ``df``'s, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
