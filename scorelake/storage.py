"""Intermediate tables that outlive executors.

Iterative operators cut their lineage by writing a table below the folder named in
``spark.checkpoint.dir``, which all executors share. Only a local session that names no folder gets
a temporary one; on a cluster the setting is needed.

Stored tables live as long as the process, since results are read later than they are planned. Work
done inside ``with scratch():`` leaves nothing behind: its tables are deleted at the end of the block.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_stored: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set and the master is local."""
    folder = spark.conf.get(_KEY, None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        # The setting can't be changed in a running session, so the folder is remembered here.
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="scorelake-")
        _own[app] = folder
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table as read back."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/scorelake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    _stored[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads, such as those of an earlier round."""
    for table in tables:
        if path := _stored.pop(table, None):
            delete_path(table.sparkSession, path)
            with contextlib.suppress(ValueError):
                _written.remove((table.sparkSession, path))


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables stored within the block when it ends; results must have been read or written by then."""
    kept = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[kept:]:
            delete_path(spark, path)
        del _written[kept:]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            delete_path(spark, path)
