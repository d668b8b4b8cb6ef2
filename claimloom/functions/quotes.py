"""Spans of evidence: the words of a source that a claim rests on, found in the text as it was sent.

A quote is a struct (text, exact): exact where the text stands in the source, otherwise it is rendered from the parsed value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.ids import json_string
from claimloom.functions.text import clip, norm

#: A JSON string, a number or word, and an object or array without others inside.
STRING = r'"(?:\\.|[^"\\])*+"'
VALUE = STRING + r"|-?\d[\d.eE+-]*|true|false|null|\{[^{}]*\}|\[[^\[\]]*\]"

#: Terms under which open registers publish, by source class and by the beginning of one.
RIGHTS = {"official_job_register_nav": "NAV pam-stilling-feed public API, used under https://arbeidsplassen.nav.no/vilkar-api"}
RIGHTS_BY_PREFIX = {"official_": "Brønnøysund Register Centre open data, NLOD 2.0"}
RIGHTS_OF_PAGES = "public page on the company's own site; fetched only where robots.txt allows this user agent"


def _occurrences(raw: Column, key: str, value: str = VALUE) -> Column:
    """The places of a key in JSON text, in order: (said, value)."""
    pattern = F.lit(rf'"\Q{key}\E"\s*+:\s*+({value})')
    said, values = (F.regexp_extract_all(raw, pattern, F.lit(k)) for k in (0, 1))
    return F.coalesce(F.arrays_zip(said.alias("said"), values.alias("value")), F.array().cast("array<struct<said:string,value:string>>"))


def same_json(value: Column) -> Column:
    """Equal for JSON texts of equal meaning: numbers by size, the rest without layout; null for what is not JSON."""
    number = value.rlike(r"^\s*-?\d")
    return F.when(number, F.concat(F.lit("#"), value.try_cast("double").cast("string"))).otherwise(F.to_json(F.try_parse_json(value)))


def quote_json(raw: Column, key: str, expected: Column | None = None, fallback: Column | None = None, suffix: Column | None = None) -> Column:
    """The first "key": value of the text; with expected (JSON text), the first whose value means the same."""
    suffix = F.coalesce(suffix, F.lit("")) if suffix is not None else F.lit("")
    found = _occurrences(raw, key)
    if expected is not None:
        found = F.filter(found, lambda o: same_json(o["value"]) == same_json(expected))
    said = F.try_element_at(found, F.lit(1))["said"]
    shown = F.concat(F.lit(f'"{key}": '), F.coalesce(*[c for c in (fallback, expected) if c is not None], F.lit("null")))
    # bound to names by an array of one, so that each is worked out once
    quote = lambda q: F.struct(F.concat(clip(F.coalesce(q["said"], q["shown"])), q["suffix"]).alias("text"), q["said"].isNotNull().alias("exact"))
    return F.element_at(F.transform(F.array(F.struct(said.alias("said"), shown.alias("shown"), suffix.alias("suffix"))), quote), 1)


def index_quotes(raw: DataFrame, keys: list[str], body: str, key: str) -> DataFrame:
    """keys, value, quote: the first place of every text value of a JSON key, by one pass over each response."""
    places = raw.select(*keys, F.posexplode(_occurrences(F.col(body), key, STRING)).alias("pos", "o"))
    value = F.regexp_extract("o.value", r'(?s)^"(.*)"$', 1)
    said = F.trim(F.regexp_replace("o.said", r"\s+", " "))
    return places.select(*keys, "pos", value.alias("value"), said.alias("said")).groupBy(*keys, "value").agg(F.min_by("said", "pos").alias("quote"))


def anchor_quote(raw: Column, org: Column) -> Column:
    """The first text field of a response that holds the id; null without one."""
    fields = F.regexp_extract_all(raw, F.lit(r'"[A-Za-z_]+"\s*+:\s*+"[^"\n]*"'), F.lit(0))
    return clip(F.try_element_at(F.filter(fields, lambda f: F.contains(f, org)), F.lit(1)))


def record_span(raw: Column, org: Column, source_url: Column) -> Column:
    """What shows that a record is about an entity, or where it came from."""
    return F.coalesce(anchor_quote(raw, org), F.concat(F.lit("record for organisation number "), org, F.lit(" returned by "), F.coalesce(source_url, F.lit("None"))))


def role_quote(raw: Column, name: Column, organisation_number: Column, role: Column, role_code: Column) -> Column:
    """The holder of a role as the register names them: by surname, whole words only; organisations by their number."""
    suffix = F.concat(F.lit(" · rolle: "), F.coalesce(role, F.lit("None")), F.lit(" ("), F.coalesce(role_code, F.lit("None")), F.lit(")"))
    holder = norm(name)

    def names(o):
        surname = norm(F.regexp_extract(o["value"], r'(?s)^"(.*)"$', 1))
        return (surname != "") & ((holder == surname) | F.endswith(holder, F.concat(F.lit(" "), surname)))

    said = F.try_element_at(F.filter(_occurrences(raw, "etternavn", STRING), names), F.lit(1))["said"]
    named = F.struct(F.concat(clip(said), suffix).alias("text"), F.lit(True).alias("exact"))
    plain = F.struct(F.concat(F.lit('"navn": '), json_string(F.coalesce(name, F.lit(""))), suffix).alias("text"), F.lit(False).alias("exact"))
    by_number = quote_json(raw, "organisasjonsnummer", json_string(organisation_number), suffix=suffix)
    return F.when((holder != "") & said.isNotNull(), named).when(F.coalesce(organisation_number, F.lit("")) != "", by_number).otherwise(plain)


def site_proof(snippets: Column) -> Column:
    """Of (url, marker, text) in page order the strongest: number, then address, then phone, with its page."""
    first = lambda marker: F.try_element_at(F.filter(snippets, lambda s: (s["marker"] == marker) & (s["text"] != "")), F.lit(1))
    best = F.coalesce(*map(first, ("organisation_number", "address", "phone")))
    return F.when(best.isNotNull(), clip(F.concat(best["text"], F.lit(" ("), best["url"], F.lit(")")), 260))


def source_rights(source_class: Column, rights: Mapping[str, str] = RIGHTS) -> Column:
    """The terms of use of a source; rights: more source classes and theirs."""
    out = F.lit(RIGHTS_OF_PAGES)
    for prefix, terms in RIGHTS_BY_PREFIX.items():
        out = F.when(F.startswith(source_class, F.lit(prefix)), terms).otherwise(out)
    for name, terms in rights.items():
        out = F.when(source_class == name, terms).otherwise(out)
    return out
