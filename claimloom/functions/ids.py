"""Stable keys: everything that is published has an id made of its content.

Canonical JSON has sorted keys, ", " and ": " between parts, and plain UTF-8; doubles are written with at least one decimal
and without exponent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions.text import norm


def json_string(c: Column) -> Column:
    quoted = c
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def json_double(c: Column) -> Column:
    exact = c.cast(T.DecimalType(38, 6)).cast("string")
    return F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.regexp_replace(exact, "0+$", ""), r"\.$", ".0"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of a known type."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'"{f.name}": '), canonical(value[f.name], f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        out = json_string(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = json_double(value.cast("double"))
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def short_hash(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def claim_key(org: Column, family: Column, field: Column, identity: Column, period: Column | None = None) -> Column:
    """identity: canonical JSON. period: given only where the value itself is the identity."""
    parts = [org, family, field, norm(identity)]
    key = F.concat_ws("|", *parts)
    return key if period is None else F.when(period.isNull(), key).otherwise(F.concat_ws("|", key, period))


def claim_id(key: Column) -> Column:
    return F.concat(F.lit("cl-"), short_hash(key))


def value_hash(value_json: Column) -> Column:
    return short_hash(value_json)


def evidence_id(url: Column, sha256: Column, method: Column) -> Column:
    quoted = [F.when(c.isNull(), F.lit("null")).otherwise(json_string(c)) for c in (url, sha256, method)]
    return F.concat(F.lit("ev-"), short_hash(*quoted))


def change_id(*parts: Column) -> Column:
    """Absent parts count as the word None."""
    return F.concat(F.lit("chg-"), short_hash(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))
