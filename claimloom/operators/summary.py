"""Sentences about a company, each with the claims it rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text, vocab
from claimloom.operators.refresh import lookup

SECTIONS = {"identity": "Who it is", "business": "What it does", "finances": "Finances", "people": "People and locations", "presence": "Web presence and hiring"}
OPTIONAL = {"alias_of": "string", "platform": "string", "signal": "string", "title": "string", "effective_date": "string", "reporting_period": "string", "stale": "boolean"}
FLAGS = {"bankrupt": "The register flags the company as bankrupt.", "under_liquidation": "The company is under liquidation.", "forced_dissolution": "The company is under forced dissolution."}


def facts(claims: DataFrame) -> DataFrame:
    """A row per company with what sentences use: the first claim of a field, or the claims of one in order.

    One aggregation. A company's claims are tens of rows; of lists only what is shown is kept beyond the count.
    """
    claims = claims.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in claims.columns})
    live = claims.filter(~F.coalesce("stale", F.lit(False)))
    value = F.coalesce(F.try_variant_get(F.try_parse_json("value_json"), "$", "string"), F.col("value_json"))
    part = lambda name: F.get_json_object("value_json", f"$.{name}")
    here = lambda family, field: (F.col("family") == family) & (F.col("field") == field)

    def first(family: str, field: str, name: str | None = None):
        what = F.struct(value.alias("v"), F.col("value_json").alias("j"), F.col("claim_id").alias("id"))
        return F.min_by(F.when(here(family, field), what), F.when(here(family, field), F.col("pos"))).alias(name or field)

    def every(name: str, which: Column, *what: Column):
        return F.array_sort(F.collect_list(F.when(which, F.struct("pos", F.col("claim_id").alias("id"), *what)))).alias(name)

    accounts = (F.col("family") == "annual_accounts") & F.col("reporting_period").isNotNull()
    figure = lambda field, name: F.array_sort(F.collect_list(F.when(accounts & (F.col("field") == field), F.struct(F.col("reporting_period").alias("period"), "pos", part("account_type").alias("type"), part("amount").cast("double").alias("amount"), part("currency").alias("currency"), F.col("claim_id").alias("id"))))).alias(name)
    role, code = here("leadership", "role"), part("role_code")
    latest = lambda field, name, *what: F.max_by(F.when(here("dated_activity", field), F.struct(F.col("claim_id").alias("id"), "effective_date", *what)), F.when(here("dated_activity", field), F.struct(F.coalesce("effective_date", F.lit("")), "pos"))).alias(name)
    profile = (F.col("family") == "company_profiles") & F.col("alias_of").isNull()
    identity = ("legal_name", "legal_form", "municipality", "founded_date", *FLAGS, "industry", "stated_activity", "registered_employees")
    return live.groupBy("org").agg(
        *[first("legal_identity", f) for f in identity], first("public_brand", "self_description"), first("public_brand", "website_scope"), first("official_website", "official_website"),
        first("group_relationships", "parent"), every("subsidiaries", here("group_relationships", "subsidiary"), part("name").alias("name")),
        F.max_by(F.when(accounts, part("account_type")), F.when(accounts, F.struct("reporting_period", -F.col("pos")))).alias("account_type"),
        figure("revenue", "revenue"), figure("annual_result", "result"), figure("equity", "equity"), figure("assets", "assets"),
        every("leaders", role & code.isin("DAGL", "LEDE", "INNH"), part("role").alias("role"), part("name").alias("name"), code.alias("code")), every("board", role & code.isin("MEDL", "NEST")),
        first("leadership", "auditor"), first("leadership", "accountant"),
        every("workplaces", here("registered_workplaces", "registered_workplace")), F.array_sort(F.collect_set(F.when(here("registered_workplaces", "registered_workplace"), text.title_case(F.nullif(part("municipality"), F.lit("")))))).alias("cities"),
        latest("registered_role_change", "role_change"), every("profiles", profile), F.array_sort(F.collect_set(F.when(profile, F.coalesce("platform", "field")))).alias("platforms"),
        every("jobs", here("jobs", "open_job"), F.left(F.coalesce(part("title"), F.lit("")), F.lit(80)).alias("title")),
        F.min_by(F.when(here("jobs", "hiring_signal") & (F.col("signal") == "careers_page"), F.struct(value.alias("v"), F.col("claim_id").alias("id"))), F.when(here("jobs", "hiring_signal") & (F.col("signal") == "careers_page"), F.col("pos"))).alias("careers"),
        latest("dated_news", "news", "title"),
    )


def money(x: Column) -> Column:
    return text.amount_text(x["amount"], x["currency"])


def without_sign(x: Column) -> Column:
    return text.amount_text(F.abs(x["amount"]), x["currency"])


def finances(f: DataFrame, unchanged: bool = True) -> tuple[DataFrame, list]:
    """f with the two latest filed periods of the account type of the latest, and the sentences on them; unchanged: also that revenue was."""
    for name in ("revenue", "result", "equity", "assets"):
        f = f.withColumn(name, F.filter(name, lambda x: x["type"].eqNullSafe(F.col("account_type"))))
    periods = F.reverse(F.array_sort(F.array_distinct(F.transform(F.concat("revenue", "result", "equity", "assets"), lambda x: x["period"]))))
    f = f.withColumn("_periods", periods)
    f = f.withColumns({"_now": F.try_element_at("_periods", F.lit(1)), "_then": F.try_element_at("_periods", F.lit(2))})
    at = lambda name, period: F.try_element_at(F.filter(name, lambda x: x["period"] == F.col(period)), F.lit(-1))
    f = f.withColumns({f"_{name}{k}": at(name, period) for name in ("revenue", "result") for k, period in ((1, "_now"), (0, "_then"))})
    f = f.withColumns({"_equity": at("equity", "_now"), "_assets": at("assets", "_now")})
    rev, old, res, before, equity, total = (F.col(c) for c in ("_revenue1", "_revenue0", "_result1", "_result0", "_equity", "_assets"))
    year = lambda c: F.left(F.substring_index(c, "..", -1), F.lit(4))
    shown = F.concat_ws(" and ", F.concat(F.lit("revenue of "), money(rev)), F.when(res["amount"] >= 0, F.concat(F.lit("a net result of "), money(res))).when(res["amount"] < 0, F.concat(F.lit("a net loss of "), without_sign(res))))
    share = text.fixed(F.abs(rev["amount"] - old["amount"]) / old["amount"] * 100, 1)
    way = lambda new, past: F.when(new > past, "rose").otherwise("fell")
    trend = F.when(
        (old["amount"] > 0) & (rev["amount"] != old["amount"]),
        F.concat(F.lit("Revenue "), way(rev["amount"], old["amount"]), F.lit(" "), share, F.lit("% from "), money(old), F.lit(" in "), year("_then"), F.lit(" to "), money(rev), F.lit(" in "), year("_now"), F.lit(".")),
    ).when(F.lit(unchanged) & (rev["amount"] == old["amount"]), F.concat(F.lit("Revenue was unchanged at "), money(rev), F.lit(" from "), year("_then"), F.lit(" to "), year("_now"), F.lit(".")))
    phrase = lambda x: F.when(x["amount"] < 0, F.concat(F.lit("a loss of "), without_sign(x))).otherwise(money(x))
    turn = F.when(res["amount"] != before["amount"], F.concat(F.lit("The net result "), way(res["amount"], before["amount"]), F.lit(" from "), phrase(before), F.lit(" to "), phrase(res), F.lit(".")))
    owned = F.concat(F.lit("Equity was "), money(equity), F.lit(" at the end of "), year("_now"))
    of_total = F.concat(owned, F.lit(", "), text.fixed(equity["amount"] / total["amount"] * 100, 0), F.lit("% of total assets."))
    has_total = F.coalesce(total["amount"] > 0, F.lit(False))
    stands = F.when(equity["amount"] < 0, F.concat(F.lit("Equity was negative ("), money(equity), F.lit(") at the end of "), year("_now"), F.lit("."))).when(equity["amount"].isNotNull() & has_total, of_total).when(equity["amount"].isNotNull(), F.concat(owned, F.lit(".")))
    return f, [
        ("finances", F.when(shown != "", F.concat(F.lit("Filed accounts for the period ending "), F.substring_index("_now", "..", -1), F.lit(" show "), shown, F.lit("."))), [rev["id"], res["id"]]),
        ("finances", trend, [old["id"], rev["id"]]),
        ("finances", turn, [before["id"], res["id"]]),
        ("finances", stands, [equity["id"], F.when((equity["amount"] >= 0) & has_total, total["id"])]),
    ]


def sentences(claims: DataFrame, unchanged: bool = True) -> DataFrame:
    """org, pos, section, text, claim_ids: only sentences that rest on a claim. unchanged: revenue that stayed the same is told too."""
    f, about_money = finances(facts(claims), unchanged)
    c = F.col
    form = F.coalesce(lookup(c("legal_form.v"), vocab.LEGAL_FORMS), F.concat(F.lit("registered entity of type "), c("legal_form.v")))
    about = F.concat_ws(", ", F.concat(F.lit("is a "), form), F.concat(F.lit("registered in "), text.title_case(c("municipality.v"))), F.concat(F.lit("founded "), c("founded_date.v")))
    clear = (c("bankrupt.v") == "false") & (c("under_liquidation.v") == "false") & (c("forced_dissolution.v") == "false")
    names = lambda col, n, what: F.transform(F.slice(col, 1, n), what)
    ids = lambda col, n=None: F.transform(F.slice(col, 1, n) if n else c(col), lambda x: x["id"])
    count = lambda col: F.size(col).cast("string")
    basis = F.get_json_object("parent.j", "$.ownership_basis")
    parent = F.concat(F.lit("Its registered parent is "), F.coalesce(F.get_json_object("parent.j", "$.name"), F.lit("None")), F.coalesce(F.concat(F.lit(" ("), F.nullif(basis, F.lit("")), F.lit(")")), F.lit("")), F.lit("."))
    below = names("subsidiaries", 3, lambda x: F.coalesce(x["name"], F.lit("None")))
    owns = F.concat(F.lit("It has "), count("subsidiaries"), F.when(F.size("subsidiaries") == 1, F.concat(F.lit(" registered subsidiary: "), F.element_at(below, 1))).otherwise(F.concat(F.lit(" registered subsidiaries, including "), F.array_join(below, ", "))), F.lit("."))
    leads = F.array_join(names("leaders", 3, lambda x: F.concat(F.coalesce(x["role"], F.lit("None")), F.lit(": "), F.coalesce(x["name"], F.lit("None")))), "; ")
    chairs = F.size(F.filter("leaders", lambda x: x["code"] == "LEDE"))
    served = [F.when(c(f"{who}.id").isNotNull(), F.concat(F.lit(f"its {who} is "), F.coalesce(F.get_json_object(f"{who}.j", "$.name"), F.lit("None")))) for who in ("auditor", "accountant")]
    services = F.concat_ws("; ", *served)
    third = c("website_scope.v").eqNullSafe("page_on_third_party_site")
    some = lambda col, t, least=1: F.when(F.size(col) >= least, t)
    said = [
        ("identity", F.when(about != "", F.concat(c("legal_name.v"), F.lit(" "), about, F.lit("."))).otherwise(F.concat(c("legal_name.v"), F.lit("."))), ["legal_name.id", "legal_form.id", "municipality.id", "founded_date.id"]),
        *[("identity", F.when(c(f"{k}.v") == "true", t), [f"{k}.id"]) for k, t in FLAGS.items()],
        ("identity", F.when(clear, "The register shows no bankruptcy, liquidation or forced dissolution."), [f"{k}.id" for k in FLAGS]),
        ("identity", F.when(c("parent.id").isNotNull(), parent), ["parent.id"]),
        ("identity", some("subsidiaries", owns), ids("subsidiaries", 3)),
        ("business", F.concat(F.lit("Its registered industry is "), F.lower(F.get_json_object("industry.j", "$.beskrivelse")), F.lit(".")), ["industry.id"]),
        ("business", F.concat(F.lit("The registry describes its activity as: “"), F.left("stated_activity.v", F.lit(240)), F.lit("”.")), ["stated_activity.id"]),
        ("business", F.concat(F.lit("Its own website describes it as: “"), F.left("self_description.v", F.lit(240)), F.lit("” (company-reported).")), ["self_description.id"]),
        *about_money,
        ("people", F.concat(F.lit("The registry reports "), c("registered_employees.v"), F.lit(" employees.")), ["registered_employees.id"]),
        ("people", some("leaders", F.concat(F.lit("Key registered roles — "), leads, F.lit("."))), ids("leaders", 3)),
        ("people", some("board", F.concat(F.lit("The board has "), (F.size("board") + chairs).cast("string"), F.lit(" registered members including the chair."))), ids("board")),
        ("people", F.when(services != "", F.concat(F.upper(F.left(services, F.lit(1))), F.substr(services, F.lit(2)), F.lit("."))), ["auditor.id", "accountant.id"]),
        ("people", some("workplaces", F.concat(F.lit("It has "), count("workplaces"), F.lit(" registered workplaces"), F.when(F.size("cities") > 0, F.concat(F.lit(" in "), F.array_join(F.slice("cities", 1, 5), ", "))).otherwise(""), F.lit(".")), 2), ids("workplaces")),
        ("people", F.concat(F.lit("The register last recorded a change to its roles on "), c("role_change.effective_date"), F.lit(".")), ["role_change.id"]),
        ("presence", F.concat(F.when(third, "It has a page on a third-party site: ").otherwise("Its verified website is "), c("official_website.v"), F.lit(".")), [c("official_website.id"), F.when(third, c("website_scope.id"))]),
        ("presence", some("profiles", F.concat(F.lit("Company-owned profiles linked from that site: "), F.array_join("platforms", ", "), F.lit("."))), ids("profiles")),
        ("presence", some("jobs", F.concat(F.lit("It appears to be hiring: "), count("jobs"), F.lit(" active NAV job ad(s), e.g. "), F.array_join(names("jobs", 3, lambda x: x["title"]), "; "), F.lit("."))), ids("jobs", 3)),
        ("presence", F.when(F.size("jobs") == 0, F.concat(F.lit("Its site has a careers page: "), c("careers.v"), F.lit("."))), ["careers.id"]),
        ("presence", F.concat(F.lit("The latest dated item on its site is “"), F.left("news.title", F.lit(120)), F.lit("” ("), c("news.effective_date"), F.lit(").")), ["news.id"]),
    ]
    cited = lambda found: F.array_compact(F.array(*[c(i) if isinstance(i, str) else i for i in found])) if isinstance(found, list) else found
    cells = [F.struct(F.lit(k).alias("pos"), F.lit(s).alias("section"), t.alias("text"), cited(found).alias("claim_ids")) for k, (s, t, found) in enumerate(said)]
    return f.select("org", F.explode(F.array(*cells)).alias("s")).select("org", "s.*").filter(F.col("text").isNotNull() & (F.size("claim_ids") > 0))


def summaries(found: DataFrame) -> DataFrame:
    return found.groupBy("org").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def sections(found: DataFrame) -> DataFrame:
    """org, section, title, text: the sentences of each section that has any, in order."""
    own = found.groupBy("org", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    return own.withColumn("title", lookup(F.col("section"), SECTIONS)).select("org", "section", "title", "text")


def changes_text(changes: DataFrame, orgs: DataFrame | None = None) -> DataFrame:
    """org, text: what changed since the previous run; companies of orgs without any change read the same on every run."""
    kinds = changes.groupBy("org", "change_type").agg(F.count("*").alias("n"), F.count_if("material").alias("m"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("change_type", "n"))), lambda k: F.concat(k["n"].cast("string"), F.lit("× "), k["change_type"])), ", ")
    out = kinds.groupBy("org").agg(F.concat(F.lit("Since the previous run: "), F.sum("n").cast("string"), F.lit(" change(s) ("), parts, F.lit("); "), F.sum("m").cast("string"), F.lit(" material.")).alias("text"))
    return out if orgs is None else orgs.select("org").distinct().join(out, "org", "left").fillna("No changes recorded.", ["text"])


def unknowns(states: DataFrame) -> DataFrame:
    """Families that were not established, with their label and, if states have one, the reason."""
    rest = states.filter(~F.col("state").isin("available", "not_applicable"))
    return rest.withColumn("label", F.coalesce(lookup(F.col("family"), vocab.FAMILY_LABELS), "family"))


def unknowns_text(states: DataFrame) -> DataFrame:
    """org, text: the families that were not established and why, in the order of publication."""
    reason = F.coalesce("reason", F.replace("state", F.lit("_"), F.lit(" "))) if "reason" in states.columns else F.replace("state", F.lit("_"), F.lit(" "))
    at = F.array_position(F.array(*map(F.lit, vocab.FAMILIES)), F.col("family"))
    rows = unknowns(states).select("org", F.struct(at.alias("at"), F.concat("label", F.lit(" ("), reason, F.lit(")")).alias("t")).alias("x"))
    return rows.groupBy("org").agg(F.concat(F.lit("Not established from checked sources: "), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "; "), F.lit(".")).alias("text"))
