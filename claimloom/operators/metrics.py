"""Run metrics, audits, recall and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_quantiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50 and p95 as elements n/2 and n*0.95 of the sorted values (from 0), no interpolation.

    Ranks over counts of distinct values: no group is collected.
    """
    from pyspark.sql import Window

    own = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    own = own.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(value)))
    half = F.floor(F.col("_total") / 2)
    return own.groupBy(*keys).agg(at(half).alias("p50"), at(F.least(F.col("_total") - 1, F.floor(F.col("_total") * 95 / 100))).alias("p95"), F.sum("_n").alias("n"))


def histogram(rows: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def top(rows: DataFrame, column: str, n: int = 15) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def evidence_metrics(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: how complete the evidence behind the claims is.

    claims: claim_id, family, reporting_period, evidence_ids, locator, claim_span, span_kind; evidence: id, source_url,
    retrieved_at, content_sha256, snapshot_path. Ids without a row of evidence don't count.
    """
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    facts = evidence.select("id", (there("source_url") & there("retrieved_at")).alias("sourced"), there("content_sha256").alias("hashed"), there("snapshot_path").alias("kept"))
    cited = claims.select("claim_id", F.explode("evidence_ids").alias("id")).join(facts, "id")
    facts = cited.groupBy("claim_id").agg(F.bool_and("sourced").alias("sourced"), F.bool_or("hashed").alias("hashed"), F.bool_or("kept").alias("kept"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    accounts = F.col("family") == "annual_accounts"
    claims = claims.withColumns({c: F.lit(None).cast("string") for c in ("reporting_period",) if c not in claims.columns})
    return claims.join(facts, "claim_id", "left").agg(
        F.count("*").alias("claims"), yes(F.col("sourced")).alias("with_source_and_retrieval_time"), yes(F.col("hashed")).alias("with_content_hash"), yes(there("claim_span")).alias("with_any_span"),
        yes(F.col("span_kind") == "source_text").alias("with_quoted_span"), yes(there("locator")).alias("with_locator"), yes(F.col("kept")).alias("with_stored_snapshot"),
        yes(accounts).alias("accounts_claims"), yes(accounts & there("reporting_period")).alias("accounts_claims_with_reporting_period"),
    )


def coverage(states: DataFrame) -> DataFrame:
    return states.groupBy("family").agg(F.round(F.avg((F.col("state") == "available").cast("int")) * 100, 1).alias("percent"), F.count("*").alias("companies"))


def recall(ours: DataFrame, reference: DataFrame, company_share: float = 0.7) -> DataFrame:
    """By family: share of reference companies we have, share of reference claims we have, and their blend; 1 if empty.
    Both: org, family, key."""
    ref, own = reference.distinct(), ours.distinct().withColumn("ours", F.lit(True))
    hit = ref.join(own, ["org", "family", "key"], "left").withColumn("hit", F.coalesce("ours", F.lit(False)).cast("int"))
    by = hit.groupBy("family", "org").agg(F.max("hit").alias("any"), F.sum("hit").alias("hits"), F.count("*").alias("n"))
    out = by.groupBy("family").agg(F.avg("any").alias("company_recall"), (F.sum("hits") / F.sum("n")).alias("claim_recall"))
    families = ours.select("family").union(reference.select("family")).distinct()
    out = families.join(out, "family", "left").fillna(1.0, ["company_recall", "claim_recall"])
    return out.withColumn("score", company_share * F.col("company_recall") + (1 - company_share) * F.col("claim_recall"))


def sample(rows: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows by a hash of their key: the same rows whatever the partitions."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(n)


def run_links(previous: DataFrame) -> DataFrame:
    return previous.groupBy("run_id").agg(F.count("*").alias("records"), F.min("started_at").alias("started_at")).orderBy("run_id")


def validation(envelopes: DataFrame, expected: int, requests: int, cap: int) -> DataFrame:
    n = F.count("*")
    return envelopes.agg(n.alias("records"), (n == expected).alias("exact_count"), (F.countDistinct("org") == n).alias("unique"), F.lit(requests <= cap).alias("within_cap"))


def phases(log: DataFrame) -> DataFrame:
    return log.groupBy("phase").agg(F.count_if(F.col("done")).alias("done"), F.count_if(~F.col("done")).alias("skipped"), F.sum("seconds").alias("seconds"), F.sum("requests").alias("requests"))


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only, with the side."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def request_counts(log: DataFrame, hosts: int = 15) -> DataFrame:
    """Requests by purpose, and by host for the busiest hosts. log: purpose, host."""
    by = lambda c: log.groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    return by("purpose").unionByName(by("host").orderBy(F.col("n").desc(), "name").limit(hosts))


def differing_fields(diff: DataFrame, key: str) -> DataFrame:
    """Of leaves that differ (key, path, before, after): records by path, most first by count, with the first example."""
    return diff.groupBy("path").agg(F.countDistinct(key).alias("records"), F.min_by(F.struct(key, "before", "after"), key).alias("example"))


def overlap(ours: DataFrame, reference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every key of either side as agreed, disagreed, missing or extra."""
    a, b = ours.select(*keys, F.col(value).alias("ours")).distinct(), reference.select(*keys, F.col(value).alias("theirs")).distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").when(F.col("ours").eqNullSafe(F.col("theirs")), "agreed").otherwise("disagreed")
    return both.withColumn("kind", kind).drop("_a", "_b")
