"""Session helpers: table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; only where that is unset (tests, one
    machine) a local folder is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-", dir=os.environ.get("TMPDIR")))
    return sc.getCheckpointDir()


def write_cut(df: DataFrame, *by: str) -> str:
    """The path under which ``df`` has been written as Parquet into the shared checkpoint folder, a folder for each value of the columns ``by``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back by path, so that its lineage is cut.

    Unlike a checkpointed plan the table read back has a known size, by which the optimizer chooses joins, and only the columns that are
    used are read. Tables stay until ``clear_cuts``, since results that read them are computed later.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_cut(df))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear_cuts(spark: SparkSession) -> None:
    """Removes the tables that ``cut`` has written in this application; results that read them must have been computed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
