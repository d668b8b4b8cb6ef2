"""Evidence: what claims are cited to.

A source record is a row with org and, as far as they are known, source_url, final_url, source_class, retrieved_at,
content_sha256, http_status and raw (the body as it was sent). Claims carry the ids of their evidence, where in the source
the value stands (locator), and the words that say so: as they stand there (source_text) or written out from the value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import ids, quotes, text

RECORD = {"source_url": "string", "final_url": "string", "source_class": "string", "retrieved_at": "string", "content_sha256": "string", "http_status": "int", "raw": "string"}
#: What a claim carries of its evidence.
CITED = ("evidence_ids", "locator", "claim_span", "span_kind", "confidence")


def with_record(rows: DataFrame) -> DataFrame:
    """rows with all columns of a source record; those that are not there are null."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in RECORD.items() if c not in rows.columns})


def evidence_of(method: str) -> Column:
    """The id of the evidence that a record is, read by a method; null for a row without a record."""
    known = F.col("source_url").isNotNull() | F.col("content_sha256").isNotNull()
    return F.when(known, ids.evidence_id(F.col("source_url"), F.col("content_sha256"), F.lit(method)))


def rendered(c: Column) -> Column:
    return F.struct(c.alias("text"), F.lit(False).alias("exact"))


def verbatim(c: Column) -> Column:
    return F.struct(c.alias("text"), c.isNotNull().alias("exact"))


def cite(claims: DataFrame, evidence: Column | None, locator: Column | None, span: Column | None, confidence: Column | None) -> DataFrame:
    """claims (field, value_json, …) with CITED. Without a span the value is written out."""
    none = F.lit(None).cast("string")
    said = span["text"] if span is not None else none
    exact = F.coalesce(span["exact"] & said.isNotNull(), F.lit(False)) if span is not None else F.lit(False)
    written = F.concat(F.lit('"'), F.col("field"), F.lit('": '), F.col("value_json"))
    return claims.withColumns({
        "evidence_ids": F.array_compact(F.array(evidence if evidence is not None else none)),
        "locator": locator if locator is not None else none,
        "claim_span": F.coalesce(text.clip(said), text.clip(written)),
        "span_kind": F.when(exact, "source_text").otherwise("rendered_value"),
        "confidence": (confidence if confidence is not None else F.lit(1.0)).cast("double"),
    })


def snapshot_path(sha256: Column) -> Column:
    """Where the content is kept in the content-addressed store."""
    return F.concat(F.lit("raw/"), F.left(sha256, F.lit(2)), F.lit("/"), sha256)


def records(rows: DataFrame, method: str, *, span: Column | None = None, note: Column | None = None, period: Column | None = None) -> DataFrame:
    """The evidence table of source records read by a method; rows without a record give none.

    Without a span the record's own words that name the entity are looked for.
    """
    rows = with_record(rows)
    none = F.lit(None).cast("string")
    own = quotes.record_span(F.col("raw"), F.col("org"), F.col("source_url"))
    shown = F.coalesce(*[c for c in (span, note) if c is not None], own)
    return rows.select(
        F.col("org").cast("string").alias("org"), evidence_of(method).alias("id"), "source_url", F.coalesce("final_url", "source_url").alias("final_url"), "source_class", "retrieved_at", F.coalesce("http_status", F.lit(200)).alias("http_status"),
        "content_sha256", F.lit(method).alias("extraction_method"), (period if period is not None else none).alias("reporting_period"), (note if note is not None else none).alias("note"),
        text.clip(shown).alias("claim_span"), snapshot_path(F.col("content_sha256")).alias("snapshot_path"), quotes.source_rights(F.coalesce("source_class", F.lit(""))).alias("rights"),
    ).filter("id is not null")


def first_wins(*tables: DataFrame) -> DataFrame:
    """One row per entity and id: of several the one in the first table, there the one of the least period and words."""
    both = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_t", F.lit(k)) for k, t in enumerate(tables)])
    rest = [c for c in both.columns if c not in ("org", "id", "_t")]
    return both.groupBy("org", "id").agg(F.min_by(F.struct(*rest), F.struct("_t", "reporting_period", "claim_span")).alias("_r")).select("org", "id", "_r.*")
