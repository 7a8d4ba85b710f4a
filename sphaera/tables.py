"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a new folder is set on a single machine; a cluster has to name one."""
    have = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sphaera-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table that is written once: iterations start from it with a short lineage, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of cut() that no later plan reads."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._cut_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def kept(spark: SparkSession, name: str, make) -> DataFrame:
    """make() as a table that is written once in an application and read again by later plans, as long as its folder is there."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/kept-{sc.applicationId}-{name}"
    done = sc._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(sc._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
