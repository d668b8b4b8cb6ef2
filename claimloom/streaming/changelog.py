"""Change feeds as streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from claimloom.operators.claims import latest_per_key
from claimloom.session import drop, store_at


def read_feed(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def upsert(
    feed: DataFrame, state: str, keys: list[str], order: list[str], checkpoint: str, complete: Callable[[int], bool] = lambda batch: True, buckets: int = 16, keep: int = 2, listing: bool = False, mode: str = "append",
) -> StreamingQuery:
    """Keeps the last write per key in a state table by buckets of the key: state/state_bucket=B/state_version=N.

    A batch reads and writes the buckets that its keys fall in, each once, and no other; its log (state-status/version=N) names the
    last version of every bucket, so readers look at the last log alone. A batch that is run again writes the same rows again, so
    a restart changes nothing. Of each bucket and of the log the last ``keep`` versions stay. ``buckets`` is for a new state:
    an old one keeps its own, so it is chosen by the size that the state will have.

    listing: a batch lists what there is, and a key that it lacks is gone, if the batch is complete: then the key's row stays as a
    tombstone, with the batch in ``gone_in``, until the key is seen again. A batch that is not complete proves no absence and
    removes nothing, whatever it lacks.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark, whole = df.sparkSession, listing and complete(n)
        versions, width = last_log(spark, state, below=n)
        width = width or buckets
        bucket = F.pmod(F.xxhash64(*keys), F.lit(width)).cast("int")
        fresh, path = store_at(latest_per_key(df, keys, order).select(*df.columns).withColumns({"gone_in": F.lit(None).cast("long"), "state_bucket": bucket}))
        touched = sorted(r["state_bucket"] for r in fresh.select("state_bucket").distinct().collect())  # at most ``buckets`` rows
        if whole:
            touched = sorted({*touched, *versions})  # any of them may hold what is gone
        schema = fresh.drop("state_bucket").schema
        old = [f"{state}/state_bucket={b}/state_version={versions[b]}" for b in touched if b in versions]
        rows = fresh
        if old:
            held = spark.read.schema(schema).option("basePath", state).parquet(*old).select(*fresh.columns)
            if whole:
                listed = fresh.select(*keys).withColumn("_listed", F.lit(True))
                same = [held[k].eqNullSafe(listed[k]) for k in keys]
                held = held.join(listed, reduce(and_, same), "left").withColumn("gone_in", F.when(F.col("_listed").isNull(), F.coalesce(held["gone_in"], F.lit(n)))).select(*[held[c] for c in fresh.columns if c != "gone_in"], "gone_in").select(*fresh.columns)
            rows = fresh.unionByName(held)
        # a key that is seen again is no longer gone, whatever the order says
        first = [F.col("gone_in").isNull().cast("int").alias("_here")] if listing else []
        merged = latest_per_key(rows.select("*", *first), ["state_bucket", *keys], [*(["_here"] if listing else []), *order]).select(*fresh.columns).withColumn("state_version", F.lit(n))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state_bucket", "state_version").parquet(state)
        now = versions | dict.fromkeys(touched, n)
        entries = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(v).alias("version")) for b, v in sorted(now.items())]).cast(f"array<{_ENTRY}>")
        spark.range(1).select(F.lit(complete(n)).alias("complete"), F.lit(width).alias("width"), entries.alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{state}-status/version={n}")
        drop(spark, path)
        for b in touched:
            if n >= keep:
                drop_older(spark, f"{state}/state_bucket={b}", n, keep)
        drop_older(spark, f"{state}-status", n, keep, "version=")

    return feed.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ENTRY = "struct<bucket:int,version:bigint>"


def _versions(spark: SparkSession, folder: str, prefix: str) -> list[tuple[int, object]]:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return sorted((int(p.getPath().getName().split("=")[1]), p.getPath()) for p in files.listStatus(where) if p.getPath().getName().startswith(prefix))


def last_log(spark: SparkSession, state: str, below: int | None = None) -> tuple[dict[int, int], int | None]:
    """The last version of each bucket, and how many buckets there are, by the last log (before a batch); one small file."""
    known = [v for v, _ in _versions(spark, f"{state}-status", "version=") if below is None or v < below]
    if not known:
        return {}, None
    row = spark.read.schema(f"complete boolean, width int, buckets array<{_ENTRY}>").json(f"{state}-status/version={known[-1]}").first()
    return {e["bucket"]: e["version"] for e in row["buckets"]}, row["width"]


def read_state(spark: SparkSession, state: str, schema: StructType, tombstones: bool = False) -> DataFrame:
    """The state table as of the last batch; with tombstones also what is gone, and gone_in, the batch that said so."""
    paths = [f"{state}/state_bucket={b}/state_version={v}" for b, v in sorted(last_log(spark, state)[0].items())]
    whole = StructType([*schema.fields, StructField("gone_in", LongType())])
    rows = spark.read.schema(whole).parquet(*paths) if paths else spark.createDataFrame([], whole)
    return rows if tombstones else rows.filter("gone_in is null").drop("gone_in")


def drop_older(spark: SparkSession, folder: str, newest: int, keep: int, prefix: str = "state_version=") -> None:
    """Deletes versions in a folder but for the last ``keep``."""
    found = _versions(spark, folder, prefix)
    for version, path in found[: max(0, len(found) - keep)]:
        if version < newest:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def windowed(feed: DataFrame, ts: str, key: str, late: str = "45 days", width: str = "1 day") -> DataFrame:
    """Counts by window and key of a stream or table, with a bound on lateness."""
    return feed.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def window_counts(feed: DataFrame, state: str, ts: str, key: str, checkpoint: str, late: str, width: str = "1 day") -> StreamingQuery:
    """windowed() of a stream into a state table of (start, key, n). Spark drops windows that the watermark has passed from its own
    state; rows that come for them are late, they are left out and counted: late_rows()."""
    counts = windowed(feed, ts, key, late, width).select(F.col("window.start").alias("start"), key, "n")
    return upsert(counts, state, ["start", key], ["n"], checkpoint, mode="update")  # a count only grows


def late_rows(query: StreamingQuery) -> int:
    """Rows that came behind the watermark in a query's batches so far (of the last hundred that Spark remembers)."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
