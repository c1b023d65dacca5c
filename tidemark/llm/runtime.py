"""Where intermediate tables go, and what every operator needs of a session."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one, and only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage ends there, and a lost executor costs no earlier work.

    The table goes when the application ends, or by drop(). With `release` Spark is told to drop the shuffle files that nothing needs
    any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    schema = df.schema
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.tidemark_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that cut() has written and nothing reads any more."""
    fs, where = _place(df.sparkSession, df.tidemark_path)
    fs.delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, by which packed shuffles are dealt out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
