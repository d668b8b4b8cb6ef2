"""Session and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(**conf: str) -> SparkSession:
    """A session with the settings the engine is meant for; spark-submit's own settings win where given later."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.config(map=settings | conf).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, which only a single machine can use."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="claimloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def deal(df: DataFrame, *by: str, slim: bool = False) -> DataFrame:
    """df dealt evenly by columns to more tasks than there are cores: for costly steps after joins that leave few, uneven partitions.

    slim: of small rows, so tasks follow the cores alone; more would spend longer on getting a large expression ready than on rows.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    if not slim:
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)
    return df.repartition(tasks, *by)


def store(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows rests on the table, not on how it came about."""
    return store_at(df)[0]


def store_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As store(), with the table's place, for those who drop() it when nothing reads it any more."""
    path = f"{shared_dir(df.sparkSession)}/claimloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
