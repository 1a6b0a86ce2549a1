"""Tables that a job writes for itself: computed once, read by several branches, and safe from lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, which all executors share; a local master without that setting gets a temporary one."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None)
    if not base and context.master.startswith("local"):
        base = getattr(context, "_fragloom_scratch", None)
        if not base:
            base = context._fragloom_scratch = tempfile.mkdtemp(prefix="fragloom-scratch-")
            atexit.register(shutil.rmtree, base, True)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/scratch-{context.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet files in that folder, read again; compressed well, since scratch tables count against the disk."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes the application's tables; results that haven't been read by then are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
