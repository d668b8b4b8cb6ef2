"""The company index: a row per company, and comparisons over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def company_index(claims: DataFrame, states: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One aggregation over claims (org, pos, family, field, value_json, reporting_period, alias_of, platform, stale)."""
    live = ~F.coalesce("stale", F.lit(False))
    text = F.when(F.startswith("value_json", F.lit('"')), F.try_variant_get(F.try_parse_json("value_json"), "$", "string")).otherwise(F.col("value_json"))
    first = lambda family, field, c=text: F.min_by(F.when((F.col("family") == family) & (F.col("field") == field), c), F.when((F.col("family") == family) & (F.col("field") == field), F.col("pos")))
    identity = lambda field, c=text: first("legal_identity", field, c)
    figure = lambda field: F.array_sort(F.collect_list(F.when(live & (F.col("family") == "annual_accounts") & (F.col("field") == field), F.struct(F.coalesce("reporting_period", F.lit("")).alias("period"), (-F.col("pos")).alias("at"), F.get_json_object("value_json", "$.amount").cast("double").alias("amount")))))
    code = F.get_json_object("value_json", "$.role_code")
    leaders = F.array_sort(F.collect_list(F.when(live & (F.col("family") == "leadership") & code.isin("DAGL", "LEDE"), F.struct(F.when(code == "DAGL", 0).otherwise(1).alias("o"), "pos", F.get_json_object("value_json", "$.name").alias("name")))))
    profile = live & (F.col("family") == "company_profiles")
    platform = F.coalesce("platform", "field") if "platform" in claims.columns else F.col("field")
    rows = claims.groupBy("org").agg(
        identity("legal_name").alias("n"), identity("legal_form").alias("f"), identity("municipality").alias("m"), identity("industry", F.get_json_object("value_json", "$.beskrivelse")).alias("i"),
        identity("registered_employees").cast("long").alias("e"), figure("revenue").alias("_r"), figure("annual_result").alias("_p"), F.try_to_number(F.left(identity("founded_date"), F.lit(4)), F.lit("9999")).cast("int").alias("fy"),
        first("official_website", "official_website").alias("w"), F.count_if((F.col("field") == "open_job") & live).alias("j"), leaders.alias("_l"),
        F.count_if(profile & F.col("alias_of").isNull()).alias("x"), F.array_sort(F.collect_set(F.when(profile, platform))).alias("sp"),
        F.count_if(live & (F.col("field") == "dated_news")).alias("y"), F.count("*").alias("k"),
    )
    shown = states.groupBy("org").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("family", "state")))).alias("a"))
    rows = rows.join(shown, "org", "left")
    rows = rows.join(changes.groupBy("org").agg(F.count("*").alias("c")), "org", "left") if changes is not None else rows.withColumn("c", F.lit(0).cast("long"))
    return rows.select(
        F.col("org").alias("o"), "n", "f", "m", "i", "e", back_amount("_r", 0).alias("r"), back_amount("_r", 1).alias("r0"), back_amount("_p", 0).alias("p"), "fy", "w", "j",
        F.filter(F.transform("_l", lambda x: x["name"]), lambda x: x.isNotNull()).alias("l"), "x", "sp", "y", F.coalesce("c", F.lit(0)).alias("c"), "a", "k",
    )


def back_amount(figures: str, back: int) -> Column:
    """The amount of the first claim of the latest period, or of the period ``back`` before; figures ascend by period."""
    periods = F.reverse(F.array_sort(F.array_distinct(F.transform(figures, lambda x: x["period"]))))
    wanted = F.try_element_at(periods, F.lit(back + 1))
    return F.try_element_at(F.filter(figures, lambda x: x["period"] == wanted), F.lit(-1))["amount"]


def kth_latest(rows: DataFrame, keys: list[str], period: str, k: int) -> DataFrame:
    """Rows of the k-th latest distinct period of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    return rows.withColumn("_k", F.dense_rank().over(w)).filter(F.col("_k") == k).drop("_k")


def year_over_year(rows: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """The latest period of each key beside the one before it."""
    w = Window.partitionBy(*keys).orderBy(period)
    out = rows.withColumns({"previous_period": F.lag(period).over(w), "previous_value": F.lag(value).over(w), "_k": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(period).desc()))})
    return out.filter("_k = 1").drop("_k")


def compare(rows: DataFrame, figures: list[str]) -> DataFrame:
    """Marks the largest value of each figure among the rows (a handful of companies)."""
    top = rows.agg(*[F.max(c).alias(f"_{c}") for c in figures]).first()
    return rows.withColumns({f"{c}_is_max": F.coalesce(F.col(c) == F.lit(top[f"_{c}"]), F.lit(False)) for c in figures})
