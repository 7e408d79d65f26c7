"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tasks for each core that write a narrow table.
NARROW_TASKS = 4


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under `spark.checkpoint.dir`, deleted when the application's process ends.

    Where that setting is missing a temporary folder takes its place, but only in local mode: on a cluster executors could not read it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sparrowplan-"))
        root = context.getCheckpointDir()
    folder = f"{root}/sparrowplan-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back: cuts lineage, survives lost executors, and is computed once.

    `narrow`: rows of a few numbers, cheap to make; some tasks for each core write them, so that there aren't as many small files as partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written = df.coalesce(NARROW_TASKS * spark.sparkContext.defaultParallelism) if narrow else df
    written.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
