"""The folder that driver and executors share, and tables written to it between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own, below spark.checkpoint.dir; removed when the driver ends.

    A path without a scheme lies on the cluster's default file system. Where the setting is missing, a temporary folder will do for a
    session on one machine; a cluster has no such folder that all can see, so there it is an error.
    """
    context = spark.sparkContext
    if context.applicationId not in _ROOTS:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{(root or tempfile.gettempdir()).rstrip('/')}/meshloom-{uuid.uuid4().hex}")
        if not root:
            path = context._jvm.org.apache.hadoop.fs.Path(f"file://{path.toUri().getPath()}")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        uri = system.makeQualified(path).toString()
        _ROOTS[context.applicationId] = uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return _ROOTS[context.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written to and read from the shared folder: computed once, lineage ends there, and a lost executor takes nothing with it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
