"""Sources: id lists, snapshots, feeds, content-addressed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.functions import text


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """org, input, error, pos from a list of ids: lines of text or CSV, JSON lines, or a JSON array."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("value"))
    many = F.from_json("value", "array<string>")
    own = F.coalesce(F.get_json_object("value", "$.organisation_number"), F.get_json_object("value", "$.org"))
    cells = F.when(F.startswith("value", F.lit("[")), many).when(F.startswith("value", F.lit("{")), F.array(own)).otherwise(F.array(F.split("value", "[,;]")[0]))
    rows = lines.select("line", F.posexplode(cells).alias("k", "input")).withColumn("pos", F.struct("line", "k")).drop("line", "k")
    return valid_ids(rows)


def valid_ids(rows: DataFrame, width: int = 9) -> DataFrame:
    """input, pos -> org, input, error, pos: nine digits; a repeated id keeps its first place, invalid rows all stay."""
    rows = rows.filter(F.trim("input") != "").filter(~F.lower(F.trim("input")).rlike("^(organisation|orgnr|#)"))
    number = text.digits(F.col("input"))
    rows = rows.withColumn("org", F.when(F.length(number) == width, number)).withColumn("error", F.when(F.length(number) != width, "not an id of nine digits"))
    good = rows.filter("error is null").groupBy("org").agg(F.min("pos").alias("pos"), F.min_by("input", "pos").alias("input"), F.first("error").alias("error"))
    return good.select("org", "input", "error", "pos").unionByName(rows.filter("error is not null").select("org", "input", "error", "pos"))


def read_snapshot(spark: SparkSession, path: str, orgs: DataFrame | None = None) -> DataFrame:
    """Envelopes of a previous run as JSON lines; the last line of an id counts; only wanted ids."""
    rows = spark.read.json(path).withColumn("_line", F.monotonically_increasing_id())
    rest = [c for c in rows.columns if c not in ("organisation_number", "_line")]
    last = rows.groupBy("organisation_number").agg(F.max_by(F.struct(*rest), "_line").alias("r")).select("organisation_number", "r.*")
    return last if orgs is None else last.join(orgs.select(F.col("org").alias("organisation_number")).distinct(), "organisation_number", "left_semi")


def compact_feed(feed: DataFrame, key: str = "uuid", seq: str = "seq") -> DataFrame:
    """A paged change feed with only the last write per key."""
    rest = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def feed_report(feed: DataFrame) -> DataFrame:
    return compact_feed(feed).agg(F.count("*").alias("ads"), F.count_if(F.col("status") == "ACTIVE").alias("active"))


def raw_pages(pages: DataFrame, body: str, key: str) -> DataFrame:
    """Content-addressed: sha256, its folder, and the first page that has it."""
    rows = pages.select(F.sha2(body, 256).alias("sha256"), F.col(key).alias("key"))
    return rows.groupBy("sha256").agg(F.min("key").alias("first_key"), F.count("*").alias("copies")).withColumn("folder", F.left("sha256", F.lit(2)))


def resolvable(candidates: DataFrame, dns: DataFrame) -> DataFrame:
    return candidates.join(dns.select("host").distinct(), "host", "left_semi")


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
