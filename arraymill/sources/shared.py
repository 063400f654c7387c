"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master an own folder where that is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="arraymill-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed reliably there: evaluated once, and its lineage ends."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder's path as Spark's readers name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def unsized(df: DataFrame) -> DataFrame:
    """df as rows of unknown size. What a task opens by its path is not in Spark's estimates: the voxels of a list of paths
    would count as a small table and be broadcast through the driver."""
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), df.sparkSession)


def co_partitioned(df: DataFrame) -> DataFrame:
    """cut(df) with joins that take sides as they are dealt, where both are dealt alike by some of the join's keys. The
    session's setting comes back afterwards."""
    spark, name = df.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return cut(df.select("*"))
    finally:
        spark.conf.set(name, before)
