"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Adaptive execution splits skewed join partitions and merges small ones; the
# group limit lets "first n per task" prune before the shuffle for any usual n.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.window.group.limit.threshold": "20000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_local_folders: dict[str, str] = {}
_own_folders: set[str] = set()


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="scoreloom-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below a folder of this application in the shared folder.

    The folder is removed when the application ends.
    """
    app = spark.sparkContext.applicationId
    folder = f"{shared_folder(spark)}/scoreloom/{app}"
    if folder not in _own_folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _own_folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove what a job has written below the shared folder and is done with."""
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, lineage cut, and
    still there when an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table as a local relation.

    Unlike a table made from Python rows its size is known when a query is
    planned, so that joins to it are broadcast without a hint.
    """
    struct = StructType.fromDDL(schema)
    dicts = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(dicts, to_arrow_schema(struct)), struct)
