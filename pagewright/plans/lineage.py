"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context. A local session may do without either and gets a
    temporary folder; on a cluster executors would not share one, so that is an error."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and reliably stored; earlier shuffle files that nothing refers to may go."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    gc.collect()
    return df.checkpoint()


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever store it is; without error where it, or the session, is gone."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have gone before the interpreter ends
        pass


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    atexit.register(forget, spark, path)
    return path
