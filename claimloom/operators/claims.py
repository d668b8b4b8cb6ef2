"""From normalised records to claims, evidence and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import ids, quotes, vocab
from claimloom.operators import evidence
from claimloom.session import store


def present(value: Column) -> Column:
    """Absence is a state, never a claim; 0 and false are values."""
    text = value.cast("string")
    return value.isNotNull() & ~F.trim(text).isin("", "[]", "{}")


def unpivot(records: DataFrame, org: str, fields: dict[str, str]) -> DataFrame:
    """org, family, field, value_json: a row per field (name -> family) that is present, in the order given."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    cells = [F.struct(F.lit(k).alias("pos"), F.lit(family).alias("family"), F.lit(name).alias("field"), present(F.col(name)).alias("there"), ids.canonical(F.col(name), kinds[name]).alias("value_json")) for k, (name, family) in enumerate(fields.items())]
    return records.select(F.col(org).cast("string").alias("org"), F.explode(F.array(*cells)).alias("c")).select("org", "c.*").filter("there").drop("there")


def identify(claims: DataFrame, identity: str | None = None, period: str | None = None) -> DataFrame:
    """Adds claim_key, claim_id and value_hash."""
    key = ids.claim_key(F.col("org"), F.col("family"), F.col("field"), F.col(identity or "value_json"), F.col(period) if period and not identity else None)
    return claims.withColumn("claim_key", key).withColumn("claim_id", ids.claim_id(F.col("claim_key"))).withColumn("value_hash", ids.value_hash(F.col("value_json")))


def figures(accounts: DataFrame, org: str, period: str, currency: str, account_type: str) -> DataFrame:
    """A claim per figure and period; the identity is figure, period and type of accounts, the value has the amount.

    Rows that are source records (evidence.RECORD) give claims with the words of the figure as filed.
    """
    shown = [c for c in vocab.FIGURES if c in accounts.columns]
    quoted_as = lambda c: quotes.quote_json(F.col("raw"), vocab.FIGURES[c], ids.json_double(F.col(c).cast("double")), suffix=suffix) if "raw" in accounts.columns else F.lit(None).cast("struct<text:string,exact:boolean>")
    rows = evidence.with_record(accounts)
    place = F.col("pos") if "pos" in accounts.columns else F.lit(None).cast("int")
    suffix = F.concat(F.lit(" (regnskapsperiode "), F.coalesce(F.col(period), F.lit("None")), F.lit(")"))
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("amount"), quoted_as(c).alias("quote")) for c in shown]
    rows = rows.select(
        F.col(org).cast("string").alias("org"), F.col(period).alias("reporting_period"), F.col(currency).alias("currency"), F.col(account_type).alias("account_type"),
        evidence.evidence_of("brreg_regnskap_json_v1").alias("_e"), place.alias("_at"), F.explode(F.filter(F.array(*cells), lambda x: x["amount"].isNotNull())).alias("c"),
    ).select("*", "c.*").drop("c").withColumn("family", F.lit("annual_accounts"))
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(ids.json_string(F.col(c)))
    rows = rows.withColumn("value_json", F.concat(F.lit('{"account_type": '), quoted("account_type"), F.lit(', "amount": '), ids.json_double(F.col("amount")), F.lit(', "currency": '), quoted("currency"), F.lit("}")))
    rows = rows.withColumn("identity", F.concat(F.lit("["), F.concat_ws(", ", quoted("field"), quoted("reporting_period"), quoted("account_type")), F.lit("]")))
    rows = rows.withColumn("effective_date", F.nullif(F.substring_index("reporting_period", "..", -1), F.lit("")))
    rows = evidence.cite(rows, F.col("_e"), F.concat(F.lit("$["), F.col("_at").cast("string"), F.lit("]."), "field"), F.col("quote"), None)
    return identify(rows, "identity").drop("identity", "quote", "_e", "_at")


def merge_duplicates(claims: DataFrame, keys: list[str], pos: str = "pos", evidence: str = "evidence_ids") -> DataFrame:
    """Of claims with one key the first stays, with the evidence of all in order."""
    rest = [c for c in claims.columns if c not in (*keys, pos, evidence)]
    parts = F.array_sort(F.collect_list(F.struct(pos, evidence)))
    out = claims.groupBy(*keys).agg(F.min_by(F.struct(pos, *rest), pos).alias("_first"), parts.alias("_parts"))
    return out.select(*keys, "_first.*", F.array_distinct(F.flatten(F.transform("_parts", lambda p: p[evidence]))).alias(evidence))


def build(rows: DataFrame, org: str, family: str, field: str | dict[str, str | None], value: Column, identity: Column, *carried: str, method: str | None = None, locator: str | Column | None = None, span: Column | None = None, confidence: Column | None = None) -> DataFrame:
    """Claims of one kind from rows: identified by ``identity`` (text, or an array of texts), whatever their value.

    field: a name, or names with the name of the field that each is an alias of. An alias is the same fact under a second name.
    method, locator, span (text, exact), confidence: how the value was read from the source record that a row is, and where.
    """
    names = field if isinstance(field, dict) else {field: None}
    kinds = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(a).cast("string").alias("alias_of")) for n, a in names.items()])
    rows = evidence.with_record(rows)
    given = {"_e": evidence.evidence_of(method) if method else F.lit(None).cast("string"), "_l": F.lit(locator) if isinstance(locator, str) else locator, "_q": span, "_c": confidence}
    given = {k: v for k, v in given.items() if v is not None}
    rows = rows.select(F.col(org).cast("string").alias("org"), F.lit(family).alias("family"), value.alias("value"), identity.alias("identity"), *carried, *[v.alias(k) for k, v in given.items()]).filter(present(F.col("value")))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    rows = rows.withColumns({c: ids.canonical(F.col(b), kind[b]) for c, b in (("value_json", "value"), ("identity_json", "identity"))})
    rows = rows.withColumn("kind", F.explode(kinds)).select("org", "family", "kind.field", "kind.alias_of", "value_json", "identity_json", *carried, *given)
    rows = evidence.cite(rows, *[F.col(c) if c in given else None for c in ("_e", "_l", "_q", "_c")]).drop(*given)
    return identify(rows, "identity_json").drop("identity_json")


def record_state(status: Column, note: Column) -> Column:
    """State of a family from the status of its source record."""
    note = F.coalesce(note, F.lit(""))
    return (
        F.when(status.isNull() | note.rlike("budget_exhausted|BudgetExhausted"), "failed")
        .when(status == "available", "available").when(status == "not_found", "not_available").when(status == "not_applicable", "not_applicable")
        .when((status == "blocked") | note.rlike("HTTP (401|403|429|451)"), "blocked").otherwise("failed")
    )


def http_status(code: Column) -> Column:
    return F.when(code == 200, "available").when(code.isin(404, 410), "not_found").otherwise("source_error")


def finalize(orgs: DataFrame, claims: DataFrame, states: DataFrame) -> DataFrame:
    """org, family, state, claims for all families: any claim makes a family available, none and no state not_available."""
    grid = orgs.select("org").distinct().withColumn("family", F.explode(F.array(*map(F.lit, vocab.FAMILIES))))
    n = claims.groupBy("org", "family").agg(F.count("*").alias("claims"))
    out = grid.join(n, ["org", "family"], "left").join(states.select("org", "family", "state"), ["org", "family"], "left")
    return out.select("org", "family", F.when(F.col("claims") > 0, "available").otherwise(F.coalesce("state", F.lit("not_available"))).alias("state"), F.coalesce("claims", F.lit(0)).alias("claims"))


def overall(states: DataFrame) -> DataFrame:
    """org, state: available if its identity is, failed otherwise."""
    return states.groupBy("org").agg(F.when(F.bool_or((F.col("family") == "legal_identity") & (F.col("state") == "available")), "available").otherwise("failed").alias("state"))


def envelopes(claims: DataFrame, states: DataFrame) -> DataFrame:
    """A row per company: its claims in order and the states of its families. A company's claims are tens of rows."""
    rest = [c for c in claims.columns if c != "org"]
    own = claims.groupBy("org").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("claims"))
    shown = states.groupBy("org").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "state")))).alias("availability"))
    return shown.join(overall(states), "org").join(own, "org", "left")


def published_errors(errors: DataFrame) -> DataFrame:
    """Errors without traces and addresses of objects, in order."""
    return errors.drop("trace").withColumn("error", F.regexp_replace("error", " at 0x[0-9a-fA-F]+", "")).orderBy("org", "source", "error")


def group_edges(tree: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """All (ancestor, node, level) of a tree of (parent, node), level by level, as deep as it goes; roots: (node).

    Every level is written to the shared folder, so a plan never holds more than one join, however deep the tree. A level
    beyond ``most`` means that the links go round in a circle, which is an error.
    """
    session = tree.sparkSession
    tree = store(tree.select("parent", "node"))
    level = store(roots.select(F.col("node").alias("ancestor"), F.col("node"), F.lit(0).alias("level")))
    found = [level]
    while not level.isEmpty():
        if len(found) > most:
            raise ValueError(f"a tree of over {most} levels: its links go round in a circle")
        level = store(level.alias("l").join(tree.alias("t"), F.col("l.node") == F.col("t.parent")).select("l.ancestor", F.col("t.node").alias("node"), F.lit(len(found)).alias("level")))
        found.append(level)
    paths = [str(f).rsplit("/", 1)[0] for x in found for f in x.inputFiles()[:1]]
    return session.read.schema(level.schema).parquet(*paths).filter("level > 0")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregation, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
