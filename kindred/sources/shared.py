"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a temporary one. That will do
    only where there is but one machine, so a session of several must set it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = f"file://{folder}"
    return _own[app]


def _owned(spark: SparkSession) -> str:
    """This application's folder in the shared one, which goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/kindred-{app}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _folders[app]


def table(df: DataFrame, name: str, options: dict[str, object] | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, is computed once, and outlives executors. The rows of each
    value of ``by`` lie in files of their own."""
    spark = df.sparkSession
    path = f"{_owned(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.options(**(options or {})).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)
