"""What the corpus operators share: the shared scratch folder, the definition of a word and a blocked Bloom filter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but a blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: White space, as WORD has it.
BLANKS = " \t\n\x0b\x0c\r"

_made: ContextVar[list[str] | None] = ContextVar("claimloom_scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, which only a single machine can use."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="claimloom-")
    spark.sparkContext.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def store(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back; the table, and where it is.

    The table outlives any executor. Its folder is scratch space of the application.
    """
    path = f"{shared_dir(df.sparkSession)}/claimloom-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    out = df.write.option("compression", codec) if codec else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    return store(df)[0]


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the scratch tables that are made inside; the caller drops them when nothing reads them any more."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def word_count(text: str | Column) -> Column:
    """Words of a text as LONG; null has none."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def nullable_key(column: str | Column) -> Column:
    """A string that is never null and sorts as the column does by code point, null last."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


PROBES = 5
KEYS_A_BLOCK = 4
#: Filters of at most so many blocks (16 MB as a table) are broadcast.
MAX_BLOCKS = 1 << 20


def bloom_blocks(keys: int, most: int | None = None) -> int:
    """The size of a filter for so many keys. One with less than it takes passes more, never less."""
    return max(1, min(keys // KEYS_A_BLOCK, most or keys))


def bloom_block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_mask(key: Column) -> Column:
    """PROBES bits of a word, six bits of the hash each."""
    h = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for k in range(PROBES):
        bit = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return word


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """__block, __word: the blocked Bloom filter of the one column of keys; a block is one 64-bit word."""
    key = F.col(keys.columns[0])
    return keys.groupBy(bloom_block(key, blocks).alias("__block")).agg(F.bit_or(bloom_mask(key)).alias("__word"))


def may_hold(rows: DataFrame, key: Column, keys: DataFrame, blocks: int, out: str) -> DataFrame:
    """rows with the boolean column ``out``: whether the filter of keys passes ``key``; false for null."""
    known = bloom(keys, blocks)
    if blocks <= MAX_BLOCKS:
        known = F.broadcast(known)
    # a larger filter is dealt by its blocks, and rows go to them; rows without a key meet none, wherever they are
    nowhere = -1 - F.spark_partition_id()
    rows = rows.withColumn("__probe", F.when(key.isNotNull(), bloom_block(key, blocks)).otherwise(nowhere)).withColumn("__mask", bloom_mask(key))
    rows = rows.join(known, F.col("__probe") == F.col("__block"), "left")
    passes = F.col("__word").bitwiseAND(F.col("__mask")) == F.col("__mask")
    return rows.withColumn(out, F.coalesce(passes, F.lit(False))).drop("__probe", "__mask", "__block", "__word")
