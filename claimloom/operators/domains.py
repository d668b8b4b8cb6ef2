"""Registered domains by a table of public suffixes, with wildcards and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffix_rules(rules: DataFrame, rule: str = "rule") -> DataFrame:
    """(suffix, kind) of rules as they are published: ``co.uk``, ``*.ck`` (any one label below), ``!www.ck`` (not a suffix after all).

    Blank lines, comments and repeated rules don't count.
    """
    r = F.lower(F.trim(F.col(rule)))
    kind = F.when(F.startswith(r, F.lit("!")), "exception").when(F.startswith(r, F.lit("*.")), "wildcard").otherwise("plain")
    kept = rules.filter(r.isNotNull() & (r != "") & ~F.startswith(r, F.lit("//")))
    return kept.select(F.regexp_replace(r, r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def _tail(labels: Column, n: Column) -> Column:
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def registered_domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """(host, suffix, domain) of each distinct host: its public suffix, and the part that somebody has registered.

    Every ending of a host is looked up in the table by an equi-join; of the rules that fit an exception wins over all, then the
    one of most labels, and without any the last label is the suffix. domain is null where the host is itself a suffix, has empty
    labels or is an address in digits; hosts are compared in lower case, without a dot at their end.
    """
    named = hosts.select(F.col(host).alias("host")).filter("host is not null").distinct()
    clean = F.regexp_replace(F.lower(F.trim("host")), r"\.$", "")
    rows = named.withColumn("labels", F.split(clean, r"\."))
    sound = ~F.exists("labels", lambda x: x == "") & ~clean.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:")
    # the endings of a host, each with the number of its labels
    ends = rows.filter(sound).select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n")).withColumn("suffix", _tail(F.col("labels"), F.col("n")))
    # an exception is one label longer than the suffix, and a wildcard one shorter
    longer = F.col("n") - F.when(F.col("kind") == "exception", 1).when(F.col("kind") == "wildcard", -1).otherwise(0)
    hits = ends.join(suffix_rules(rules), "suffix").select("host", "labels", (F.col("kind") == "exception").alias("sure"), longer.alias("length")).filter(F.col("length") <= F.size("labels"))
    best = hits.groupBy("host").agg(F.max(F.struct("sure", "length")).alias("b")).select("host", F.col("b.length").alias("length"))
    out = rows.filter(sound).join(best, "host", "left").withColumn("length", F.coalesce("length", F.lit(1)))
    registered = F.when(F.size("labels") > F.col("length"), _tail(F.col("labels"), F.col("length") + 1))
    out = out.select("host", _tail(F.col("labels"), F.col("length")).alias("suffix"), registered.alias("domain"))
    return named.join(out, "host", "left")


def with_domain(rows: DataFrame, rules: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """rows with the registered domain of their host; each distinct host is looked up once."""
    found = registered_domains(rows, rules, host).select(F.col("host").alias("_host"), F.col("domain").alias(domain))
    return rows.drop(domain).join(found, F.col(host) == F.col("_host"), "left").drop("_host")
