"""Queries on streams of the given events, as files that arrive one by one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.registry import query
from claimloom.session import shared_dir, table
from claimloom.streaming import changelog

#: Runs of the listing, in order, and whether each reached its end.
COMPLETE = (True, False, True, False, True, False)
#: Files of the windowed stream; how late a row may be; every so manieth event comes a file late, or in the last file.
FILES, LATE_DAYS, NEXT, LAST = 5, 4, 7, 11


def arrive(rows: DataFrame, folder: str, parts: list) -> None:
    """Writes the parts of rows one after the other, as files of a stream in that order."""
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)


_RUN = f"CAST(floor((day(ts) - 1) * {len(COMPLETE)} / 31) AS INTEGER)"


@query(f"""
WITH e AS (SELECT *, {_RUN} AS run FROM events), seen AS (SELECT * FROM e WHERE (user_id + run) % 4 <> 0),
last AS (SELECT user_id, max(run) AS run, arg_max(event_id, run::BIGINT * 1000000000 + event_id) AS event_id FROM seen GROUP BY user_id),
whole AS (SELECT run FROM (SELECT unnest({[*COMPLETE]}) AS complete, unnest(range({len(COMPLETE)})) AS run) WHERE complete)
SELECT user_id, event_id, (SELECT min(w.run) FROM whole w WHERE w.run > l.run) AS gone_in FROM last l""")
def stream_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Users by the last listing that had them. A user that a complete listing lacks is gone from then on until seen again; one
    that a listing which broke off lacks is not."""
    work = f"{shared_dir(spark)}/claimloom-stream-{uuid.uuid4().hex}"
    run = F.floor((F.dayofmonth("ts") - 1) * len(COMPLETE) / 31)
    events = table(spark, d, "events").select("user_id", "event_id", run.cast("int").alias("run")).filter((F.col("user_id") + F.col("run")) % 4 != 0)
    arrive(events, f"{work}/in", [F.col("run") == k for k in range(len(COMPLETE))])
    feed = changelog.read_feed(spark, f"{work}/in", events.schema)
    changelog.upsert(feed, f"{work}/state", ["user_id"], ["run", "event_id"], f"{work}/checkpoint", complete=lambda n: COMPLETE[n], listing=True).awaitTermination()
    return changelog.read_state(spark, f"{work}/state", events.schema, tombstones=True).select("user_id", "event_id", "gone_in")


@query(f"""
WITH b AS (
  SELECT *, CASE WHEN event_id % {LAST} = 0 THEN {FILES - 1} WHEN event_id % {NEXT} = 0 THEN least({FILES - 1}, CAST(floor((day(ts) - 1) * {FILES} / 31) AS INTEGER) + 1) ELSE CAST(floor((day(ts) - 1) * {FILES} / 31) AS INTEGER) END AS file FROM events),
w AS (SELECT f AS file, (SELECT max(ts) FROM b WHERE b.file < f - 1) - INTERVAL {LATE_DAYS} DAY AS mark FROM (SELECT unnest(range({FILES})) AS f)),
j AS (SELECT b.*, date_trunc('day', ts) AS start, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM b JOIN w USING (file))
SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n, 0 AS late FROM j WHERE NOT late GROUP BY ALL
UNION ALL SELECT NULL, event_type, 0, count(*) FROM j WHERE late GROUP BY ALL""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by type of events that come out of order, with a bound on lateness, and per type how many came too late."""
    work = f"{shared_dir(spark)}/claimloom-stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    file = F.floor((F.dayofmonth("ts") - 1) * FILES / 31)
    file = F.when(F.col("event_id") % LAST == 0, FILES - 1).when(F.col("event_id") % NEXT == 0, F.least(F.lit(FILES - 1), file + 1)).otherwise(file)
    arrive(events, f"{work}/in", [file == k for k in range(FILES)])
    feed = changelog.read_feed(spark, f"{work}/in", events.schema)
    changelog.window_counts(feed, f"{work}/state", "ts", "event_type", f"{work}/checkpoint", f"{LATE_DAYS} days").awaitTermination()
    schema = spark.createDataFrame([], "start timestamp, event_type string, n long").schema
    counts = changelog.read_state(spark, f"{work}/state", schema)
    zero = F.lit(0).cast("long")
    kept = counts.groupBy("event_type").agg(F.sum("n").alias("_kept"))
    late = events.groupBy("event_type").agg(F.count("*").alias("_all")).join(kept, "event_type", "left").select("event_type", (F.col("_all") - F.coalesce("_kept", zero)).alias("late")).filter("late > 0")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", zero.alias("late")).unionByName(late.select(F.lit(None).cast("string").alias("start"), "event_type", zero.alias("n"), "late"))
