"""Snapshot refresh: what changed between two runs of claims.

One full outer join on (org, claim_key) and one ladder that names the action of each row. Claims have the columns
org, claim_key, family, field, value_json, value_hash, evidence_ids, and where they apply alias_of, signal, role_code, title,
stale. Availability: org, family, state, for either run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from claimloom.functions import ids, tree, vocab
from claimloom.session import store

OPTIONAL = {"alias_of": "string", "signal": "string", "role_code": "string", "title": "string", "stale": "boolean", "evidence_ids": "array<string>"}
KEEPS = ("unchanged", "alias_added", "backfilled", "added", "changed")


@dataclass
class Refresh:
    claims: DataFrame
    changes: DataFrame
    counts: DataFrame
    actions: DataFrame


def lookup(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def with_optional(claims: DataFrame) -> DataFrame:
    return claims.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in claims.columns})


def website_derived(family: Column, field: Column, signal: Column) -> Column:
    return family.isin(*vocab.DEBOUNCED_FAMILIES) | field.isin(*vocab.DEBOUNCED_FIELDS) | ((field == "hiring_signal") & F.coalesce(signal == "careers_page", F.lit(False)))


def material(family: Column, field: Column, role_code: Column, change_type: Column) -> Column:
    return (
        F.when(family == "legal_identity", field.isin(*vocab.MATERIAL_IDENTITY_FIELDS))
        .when(family == "leadership", F.coalesce(role_code.isin(*vocab.MATERIAL_ROLES), F.lit(False)) | change_type.isin("new_role", "removed_role"))
        .otherwise(family.isin(*vocab.MATERIAL_FAMILIES))
    )


def diff(previous: DataFrame, current: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Every claim of either run with its action; previous columns are prefixed p_, current ones c_."""
    sides = []
    for side, (df, state) in {"p": (previous, before), "c": (current, now)}.items():
        df = with_optional(df)
        sides.append((df.select("org", "claim_key", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in ("org", "claim_key")]), state.select("org", F.col("family").alias("f"), F.col("state").alias(f"{side}_state"))))
    (p, p_state), (c, c_state) = sides
    # families are as many rows as there are entities, and more than planned for where they come of an explode: never broadcast
    known = before.select("org").distinct().withColumn("known", F.lit(True)).hint("merge")
    rows = p.join(c, ["org", "claim_key"], "full_outer").withColumns({x: F.coalesce(f"c_{x}", f"p_{x}") for x in ("family", "field")})
    for state in (p_state, c_state):
        rows = rows.join(state.withColumnRenamed("f", "family").hint("merge"), ["org", "family"], "left")
    rows = rows.join(known, "org", "left")
    own, old = F.col("c_value_hash").isNotNull(), F.col("p_value_hash").isNotNull()
    derived = website_derived(F.col("family"), F.col("field"), F.coalesce("c_signal", "p_signal"))
    checked = F.coalesce(F.col("c_state").isin("available", "not_available"), F.lit(False))
    lasting = F.col("family").isin(*vocab.LASTING_FAMILIES)
    waits = derived & ~F.coalesce("p_stale", F.lit(False))  # a first miss
    removable = lookup(F.col("family"), vocab.REMOVED).isNotNull()
    action = (
        F.when(F.col("known").isNull(), "first_run")
        .when(~old & F.col("c_alias_of").isNotNull(), "alias_added")
        .when(~old & (F.coalesce(F.col("p_state").isin("failed", "blocked"), F.lit(True)) | derived), "backfilled")
        .when(~old, "added")
        .when(own & (F.col("p_value_hash") == F.col("c_value_hash")), "unchanged")
        .when(own, "changed")
        .when(checked & ~derived & F.col("p_alias_of").isNotNull(), "dropped")
        .when(lasting & checked, "historical")
        .when(~checked | waits | ~removable, "stale")
        .otherwise("removed")
    )
    return rows.withColumn("action", action).drop("known")


def apply(previous: DataFrame, current: DataFrame, before: DataFrame, now: DataFrame) -> Refresh:
    # claims, changes and counts all rest on the one comparison: it is written once
    rows = store(diff(previous, current, before, now))
    kept = [c[2:] for c in rows.columns if c.startswith("c_") and c not in ("c_state",)]
    carried = F.col("action").isin("stale", "historical")
    claims = rows.filter(~F.col("action").isin("dropped", "removed")).select(
        "org", "claim_key", *[F.when(carried, F.col(f"p_{c}")).otherwise(F.col(f"c_{c}")).alias(c) for c in kept if c != "stale"],
        (F.col("action") == "stale").alias("stale"), (F.col("action") == "historical").alias("historical"), (F.col("action") == "backfilled").alias("backfilled"),
    )
    return Refresh(claims, changes(rows), counts(rows), rows.select("org", "claim_key", "family", "field", "action"))


def changes(rows: DataFrame) -> DataFrame:
    """change_id, type, both values and evidence of what was added, changed or removed."""
    kind = F.when(F.col("action") == "added", lookup(F.col("family"), vocab.ADDED)).when(F.col("action") == "changed", F.concat(F.lit("changed_"), "field")).otherwise(lookup(F.col("family"), vocab.REMOVED))
    rows = rows.filter(F.col("action").isin("added", "changed", "removed")).withColumn("change_type", kind)
    none = F.array().cast("array<string>")
    return rows.select(
        "org", ids.change_id(F.col("claim_key"), F.col("change_type"), F.col("p_value_hash"), F.col("c_value_hash")).alias("change_id"), "change_type", "claim_key", "family", "field",
        F.when((F.col("family") == "jobs") & (F.col("action") == "removed") & F.col("p_title").isNotNull(), F.concat(F.lit('{"title": '), ids.json_string(F.col("p_title")), F.lit("}"))).otherwise(F.col("p_value_json")).alias("previous_value"), F.col("c_value_json").alias("current_value"),
        material(F.col("family"), F.col("field"), F.coalesce("c_role_code", "p_role_code"), F.col("change_type")).alias("material"),
        F.struct(F.coalesce("p_evidence_ids", none).alias("previous"), F.coalesce("c_evidence_ids", none).alias("current")).alias("evidence_ids"),
    )


def counts(rows: DataFrame) -> DataFrame:
    changed = F.col("action").isin("added", "changed", "removed")
    return rows.groupBy("org").agg(F.count_if(changed).alias("changes"), F.count_if(F.col("action") == "stale").alias("stale"), F.count_if(F.col("action") == "historical").alias("historical"), F.count_if(F.col("action") == "backfilled").alias("backfilled"))


def merge_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """The change log with new changes; what was logged before stays as it is."""
    both = log.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    first = Window.partitionBy("org", "change_id").orderBy("_age")
    return both.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_age")


def carried_evidence(claims: DataFrame, changed: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Evidence (org, id, …) of this run, and of the previous run what carried claims and changes still cite."""
    cited = claims.filter("stale or historical").select("org", F.explode("evidence_ids").alias("id")).unionByName(changed.select("org", F.explode("evidence_ids.previous").alias("id"))).distinct()
    # evidence is as many rows as claims, and more than planned for, as its ids come of an explode: never broadcast
    old = before.join(cited.hint("merge"), ["org", "id"], "left_semi").join(now.hint("merge"), ["org", "id"], "left_anti")
    return now.withColumn("from_previous_run", F.lit(False)).unionByName(old.withColumn("from_previous_run", F.lit(True)), allowMissingColumns=True)


def leaves(df: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """key, path, value of every leaf of the records, at any depth; lists give their length and, by position, their elements.

    volatile: names of columns or fields, anywhere in a record, that belong to a run and not to the record.
    """
    def walk(value: Column, kind, path: Column):
        if isinstance(kind, StructType):
            parts = [walk(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields if f.name not in volatile]
            whole = [F.array(F.struct(path.alias("path"), F.lit("<absent>").alias("value")))]
            return F.when(value.isNull(), whole[0]).otherwise(F.concat(*parts)) if parts else F.filter(whole[0], lambda x: F.lit(False))
        if isinstance(kind, ArrayType):
            length = F.array(F.struct(F.concat(path, F.lit("[length]")).alias("path"), F.size(value).cast("string").alias("value")))
            inside = F.flatten(F.transform(value, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            return F.when(value.isNull(), F.array(F.struct(path.alias("path"), F.lit(None).cast("string").alias("value")))).otherwise(F.concat(length, inside))
        text = value if isinstance(kind, StringType) else F.to_json(value) if isinstance(kind, MapType) else value.cast("string")
        return F.array(F.struct(path.alias("path"), text.alias("value")))

    found = [walk(F.col(f.name), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name != key and f.name not in volatile]
    return df.select(key, F.explode(F.concat(*found)).alias("x")).select(key, "x.*")


def record_diff(before: DataFrame, after: DataFrame, key: str, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Leaves that differ between two versions of the same records, at any depth."""
    a, b = (leaves(d, key, volatile).withColumnRenamed("value", n) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, [key, "path"], "full_outer").filter(~F.col("before").eqNullSafe(F.col("after")))


#: Names of values that belong to one run, wherever they stand in a record.
RUN_SCOPED = ("run", "operations", "run_id", "started_at", "completed_at", "retrieved_at", "requests", "runtime_ms")


def compare_runs(before: DataFrame, after: DataFrame, key: str, body: str = "record") -> DataFrame:
    """key, verdict, paths of the records of two runs, JSON texts of any shape: as tree.compared() says, or missing or extra.

    What belongs to a run does not count, wherever it stands.
    """
    side = lambda df, name: df.select(key, F.col(body).alias(name), F.lit(True).alias(f"{name}_here"))
    both = side(before, "a").join(side(after, "b"), key, "full_outer")
    found = both.withColumn("_x", tree.compared(F.col("a"), F.col("b"), RUN_SCOPED))
    there = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    verdict = F.when(F.col("a_here").isNull(), "extra").when(F.col("b_here").isNull(), "missing").otherwise(F.col("_x.verdict"))
    return found.select(key, verdict.alias("verdict"), F.when(there, F.col("_x.paths")).otherwise(F.array().cast("array<string>")).alias("paths"))
