"""Sinks: run outputs, state, site data, audit files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_run(envelopes: DataFrame, folder: str, run_id: str) -> None:
    """An immutable snapshot of the run; a second write of the same run fails rather than replaces."""
    envelopes.write.mode("errorifexists").json(f"{folder}/snapshots/run_id={run_id}")


def merge_latest(latest: DataFrame, envelopes: DataFrame) -> DataFrame:
    """The latest record of each valid id: this run's, else the one before."""
    valid = envelopes.filter(F.col("org").rlike("^[0-9]{9}$"))
    return latest.join(valid.select("org"), "org", "left_anti").unionByName(valid, allowMissingColumns=True)


def write_raw(pages: DataFrame, store: DataFrame | None, folder: str) -> None:
    """Write-once by content: pages (sha256, body) that the store does not have, by folder."""
    new = pages.dropDuplicates(["sha256"])
    new = new if store is None else new.join(store.select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.left("sha256", F.lit(2))).write.mode("append").partitionBy("prefix").parquet(folder)


def script_json(row: Column) -> Column:
    """JSON that may stand in a script element."""
    return F.replace(F.to_json(row), F.lit("</"), F.lit("<\\/"))


def site_index(index: DataFrame) -> DataFrame:
    """Index rows as JSON, most claims first."""
    return index.orderBy(F.col("k").desc(), F.col("n").asc_nulls_last(), "o").select("o", script_json(F.struct(*index.columns)).alias("json"))


def write_audit(claims: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in claims.dtypes]
    claims.select(*flat).write.mode("overwrite").csv(path, header=True)


def run_report(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))
