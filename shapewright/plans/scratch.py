"""Lineage cuts of the iterative operators: tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[SparkSession, str] = {}


def _remove_all() -> None:
    """At the end of the program; where its session has been stopped before, tables stay behind."""
    for spark, folder in _FOLDERS.items():
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    """A folder below the checkpoint folder; one of our own only where none is set and Spark is local."""
    if spark not in _FOLDERS:
        context = spark.sparkContext
        root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
        if not root:
            local = context.master.startswith("local")
            root = "file://" + tempfile.mkdtemp(prefix="cuts-") if local else spark.conf.get("spark.sql.warehouse.dir")
        if not _FOLDERS:
            atexit.register(_remove_all)
        _FOLDERS[spark] = f"{root.rstrip('/')}/cuts-{uuid.uuid4().hex}"
    return _FOLDERS[spark]


def cut(df: DataFrame) -> DataFrame:
    """df, computed, written and read again: columnar, of a known size, and safe from lost executors."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
