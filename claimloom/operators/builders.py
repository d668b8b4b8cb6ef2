"""Claims of each source: roles, workplaces, sites, ads and dated events. Every builder is one projection over its records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import ids, quotes, text, url, vocab
from claimloom.operators import claims, evidence
from claimloom.operators.claims import build


def _texts(*parts: Column) -> Column:
    return F.array(*[p.cast("string") for p in parts])


#: Fields of the legal identity: where the register has them, and whether a quote has to say the very value.
IDENTITY_FIELDS = {
    "legal_name": ("$.navn", True), "organisation_number": ("$.organisasjonsnummer", True), "legal_form": ("$.organisasjonsform.kode", True),
    "legal_form_label": ("$.organisasjonsform.beskrivelse", True), "business_address": ("$.forretningsadresse", False), "postal_address": ("$.postadresse", False),
    "municipality": ("$.forretningsadresse.kommune", True), "industry": ("$.naeringskode1", False), "founded_date": ("$.stiftelsesdato", True),
    "registered_date": ("$.registreringsdatoEnhetsregisteret", True), "vat_registered": ("$.registrertIMvaregisteret", True), "bankrupt": ("$.konkurs", True),
    "under_liquidation": ("$.underAvvikling", True), "forced_dissolution": ("$.underTvangsavviklingEllerTvangsopplosning", True), "stated_activity": ("$.aktivitet", False),
    "statutory_purpose": ("$.vedtektsfestetFormaal", False), "share_capital": ("$.kapital.belop", True), "registered_employees": ("$.antallAnsatte", True),
}
UNIVERSE_FIELDS = ("legal_name", "organisation_number", "legal_form", "municipality")


def _cells(rows: DataFrame, method: str, fields: dict[str, tuple[str, bool]]) -> DataFrame:
    """A claim of the legal identity for each field that is there: one pass over the rows, whatever the number of fields."""
    rows = evidence.with_record(rows)
    kinds = {f.name: f.dataType for f in rows.schema.fields}

    def cell(k, name, locator, scalar):
        value = ids.canonical(F.col(name), kinds[name])
        quote = quotes.quote_json(F.col("raw"), locator.rsplit(".", 1)[-1], value if scalar else None, fallback=value)
        # what is not there is not looked for
        return F.when(claims.present(F.col(name)), F.struct(F.lit(k).alias("pos"), F.lit(name).alias("field"), value.alias("value_json"), F.lit(locator).alias("locator"), quote.alias("quote")))

    cells = F.array_compact(F.array(*[cell(k, n, *fields[n]) for k, n in enumerate(fields) if n in rows.columns]))
    found = rows.select(F.col("org").cast("string").alias("org"), evidence.evidence_of(method).alias("_e"), F.explode(cells).alias("c")).select("org", "_e", "c.*")
    found = found.withColumns({"family": F.lit("legal_identity"), "identity_json": ids.json_string(F.col("field"))})
    found = evidence.cite(found, F.col("_e"), F.col("locator"), F.col("quote"), None)
    return claims.identify(found, "identity_json").drop("identity_json", "quote", "_e")


def identity(entities: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Claims of the legal identity and former names. entities: normalise.entity() of register records that were found, with
    org; universe: rows of the universe (org, legal_name, legal_form, municipality) for companies without such a record."""
    entities = evidence.with_record(entities)
    own = _cells(entities, "brreg_entity_json_v1", IDENTITY_FIELDS)
    named = entities.select("org", *evidence.RECORD, F.posexplode("former_names").alias("at", "was"))
    said = quotes.quote_json(F.col("raw"), "navn", ids.json_string(F.col("was.name")))
    former = build(
        named.withColumn("effective_date", F.col("was.to")), "org", "public_brand", "previous_legal_name", F.col("was"), _texts(F.lit("previous_legal_name"), F.col("was.name")), "effective_date",
        method="brreg_entity_json_v1", locator=F.concat(F.lit("$.historiskeNavn["), F.col("at").cast("string"), F.lit("]")), span=said,
    )
    parts = [own, former]
    if universe is not None:
        left = universe.join(entities.select("org").distinct(), "org", "left_anti").withColumn("organisation_number", F.col("org"))
        parts.append(_cells(left, "frozen_universe_row_v1", {n: (f"$.{'name' if n == 'legal_name' else n}", True) for n in UNIVERSE_FIELDS}))
    return union(parts)


def filings(entities: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Claims of filed accounts: the last year that the register names, and every year of which there is a copy (org, year)."""
    year = F.col("latest_submitted_accounts").cast("string")
    said = quotes.quote_json(F.col("raw"), "sisteInnsendteAarsregnskap", ids.json_string(year))
    parts = [build(evidence.with_record(entities), "org", "filing_history", "latest_submitted_accounts_year", year, F.lit("latest_submitted_accounts_year"), method="brreg_entity_json_v1", locator="$.sisteInnsendteAarsregnskap", span=said)]
    if history is not None:
        copy = F.col("year").cast("string")
        parts.append(build(history, "org", "filing_history", "filed_annual_account_copy", copy, copy, method="brreg_regnskap_copy_years_v1", locator="$[*]"))
    return union(parts)


def leadership(roles: DataFrame) -> DataFrame:
    """Claims of the active roles (org, role, role_code, name, organisation_number, group_last_changed, inactive).

    The same holder of the same role is the same claim, whatever else of it changes. Auditors and accountants have fields
    of their own.
    """
    rows = roles.filter(~F.coalesce("inactive", F.lit(False))).withColumn("effective_date", F.col("group_last_changed"))
    identity = _texts(F.col("role_code"), text.norm(F.col("name")), F.col("organisation_number"))
    service = F.coalesce(F.col("role_code").isin(*vocab.SERVICE_ROLES), F.lit(False))
    cases = [("role", ~service)] + [(field, F.col("role_code") == code) for code, field in vocab.SERVICE_ROLES.items()]
    value = F.struct("role", "role_code", "name", "organisation_number", "group_last_changed")
    rows = evidence.with_record(rows)
    said = quotes.role_quote(F.col("raw"), F.col("name"), F.col("organisation_number"), F.col("role"), F.col("role_code"))
    how = {"method": "brreg_roles_json_v1", "locator": "$.rollegrupper[*].roller[*]", "span": said}
    return union(build(rows.filter(c), "org", "leadership", field, value, identity, "role_code", "effective_date", **how) for field, c in cases)


def workplaces(locations: DataFrame) -> DataFrame:
    value = F.struct("organisation_number", "name", "address", "municipality", "industry", "registered_employees")
    rows = evidence.with_record(locations)
    at = F.coalesce(F.col("pos").cast("string"), F.lit("*")) if "pos" in locations.columns else F.lit("*")
    said = quotes.quote_json(F.col("raw"), "organisasjonsnummer", ids.json_string(F.col("organisation_number")), suffix=F.concat(F.lit(" ("), F.coalesce("name", F.lit("None")), F.lit(")")))
    return build(rows, "org", "registered_workplaces", "registered_workplace", value, F.col("organisation_number"), method="brreg_subunits_json_v1", locator=F.concat(F.lit("$._embedded.underenheter["), at, F.lit("]")), span=said)


def group_relationships(links: DataFrame) -> DataFrame:
    """A claim per parent and per subsidiary, as its field says."""
    value = F.struct("organisation_number", "name", "ownership_basis", "link_type", "as_of")
    links = evidence.with_record(links).withColumn("effective_date", F.col("as_of"))
    said = quotes.quote_json(F.col("raw"), "organisasjonsnummer", ids.json_string(F.col("organisation_number")), suffix=F.concat(F.lit(" ("), "relation", F.lit(": "), F.coalesce("name", F.lit("None")), F.lit(")")))
    how = {"method": "brreg_group_structure_v1", "locator": "$..children", "span": said}
    return union(build(links.filter(F.col("relation") == r), "org", "group_relationships", r, value, _texts(F.lit(r), F.col("organisation_number")), "effective_date", **how) for r in ("parent", "subsidiary"))


def activity(jobs: DataFrame, role_dates: DataFrame, filings: DataFrame, dates: int = 10) -> DataFrame:
    """Ads, role changes and filed accounts.

    An ad makes an open job, a hiring signal (its alias) and a dated event. jobs: org, uuid, title, published, public_url and
    what else is shown of an ad; role_dates: org, role_change_dates ascending, of which the last ones count; filings: org, year.
    """
    day = F.left(F.coalesce("published", F.lit("")), F.lit(10))
    ads = jobs.withColumns({"effective_date": F.nullif(day, F.lit("")), "signal": F.lit("job_ad")})
    shown = [c for c in ("title", "job_title", "published", "expires", "application_due", "engagement_type", "extent", "positions", "work_locations", "public_url") if c in jobs.columns]
    post = F.struct(day.alias("date"), "title", F.col("public_url").alias("url"))
    changed = evidence.with_record(role_dates).select("org", *evidence.RECORD, F.explode(F.slice("role_change_dates", F.greatest(F.size("role_change_dates") - dates + 1, F.lit(1)), F.lit(dates))).alias("effective_date"))
    seen = F.nullif(F.regexp_substr("raw", F.concat(F.lit(r'"time"\s*:\s*"\Q'), "effective_date", F.lit(r'\E[^"]*"'))), F.lit(""))
    stamp = F.struct(F.coalesce(seen, F.concat(F.lit('"time": "'), "effective_date", F.lit('"'))).alias("text"), seen.isNotNull().alias("exact"))
    filed = evidence.with_record(filings).select("org", *evidence.RECORD, F.col("year").cast("string").alias("reporting_period")).filter("reporting_period <> ''")
    event = lambda title, **parts: F.struct(*[v.alias(k) for k, v in parts.items()], title.alias("title"))
    employer = F.concat(F.lit("employer orgnr "), F.coalesce(F.col("employer_orgnr").cast("string") if "employer_orgnr" in jobs.columns else F.lit(None).cast("string"), F.lit("None")))
    beside = lambda *more: evidence.rendered(F.concat(F.coalesce("title", F.lit("None")), F.lit(" ("), *more, employer, F.lit(")")))
    how = {"method": "nav_feed_entry_json_v1", "locator": "$.ad_content"}
    return union((
        build(ads, "org", "jobs", "open_job", F.struct(*shown), _texts(F.lit("nav"), F.col("uuid")), "effective_date", "title", span=evidence.rendered(employer), **how),
        build(ads, "org", "jobs", {"hiring_signal": "open_job"}, F.col("public_url"), _texts(F.lit("job_ad"), F.col("uuid")), "effective_date", "signal", span=beside(), **how),
        build(ads, "org", "dated_activity", "job_posted", post, _texts(F.lit("job_posted"), F.col("uuid")), "effective_date", span=beside(F.lit("published "), day, F.lit("; ")), **how | {"locator": "$.ad_content.published"}),
        build(changed, "org", "dated_activity", "registered_role_change", event(F.lit("Registered roles updated in Brønnøysund"), date=F.col("effective_date")), _texts(F.lit("registered_role_change"), F.col("effective_date")), "effective_date", method="brreg_role_update_log_v1", locator="$[*].time", span=stamp),
        build(filed, "org", "dated_activity", "annual_accounts_filed", event(F.concat(F.lit("Annual accounts for "), "reporting_period", F.lit(" submitted")), date=F.lit(None).cast("string"), year=F.col("reporting_period")), _texts(F.lit("annual_accounts_filed"), F.col("reporting_period")), "reporting_period", method="brreg_entity_json_v1", locator="$.sisteInnsendteAarsregnskap", span=quotes.quote_json(F.col("raw"), "sisteInnsendteAarsregnskap", ids.json_string(F.col("reporting_period")))),
    ))


def web_presence(sites: DataFrame, profiles: DataFrame, careers: DataFrame, news: DataFrame) -> DataFrame:
    """Claims of the sites that passed the identity gate, and the declared address of those that did not.

    sites: org, final_url, publishable, listed, score, scope, brand, description. profiles: org, platform, url. careers: org,
    url. news: org, title, date, published_at, url. A page on another's site gives its address only; a site that may be a
    group's gives no ads or news, and profiles only with a Norwegian handle.
    """
    passed = sites.filter(F.coalesce("publishable", F.lit(False)))
    foreign, group = F.col("scope") == "page_on_third_party_site", F.col("scope") == "possibly_group_or_international"
    confidence = F.when(foreign | group, 0.8).otherwise(F.coalesce("score", F.lit(0.9)))
    own = passed.withColumns({"confidence": confidence, "address": url.without_default_port(F.col("final_url"))})
    named = own.filter(~foreign)
    scope = passed.select("org", "scope").distinct()
    handle = F.substring_index("url", "/", -1)
    linked = profiles.join(scope, "org").filter(~foreign & (~group | handle.rlike(vocab.NORWAY_HANDLE)))
    local = lambda rows: rows.join(scope, "org").filter(~foreign & ~group)
    told = local(news).withColumn("effective_date", F.col("date"))
    declared = sites.filter(~F.coalesce("publishable", F.lit(False)) & F.col("listed") & F.col("final_url").isNotNull())
    relation = "declared in the official register; exact-entity identity not verified (possible brand, parent or franchise site)"
    proof = text.clip(F.col("proof")) if "proof" in sites.columns else F.lit(None).cast("string")
    why = F.col("reasons") if "reasons" in sites.columns else F.lit(None).cast("string")
    tail = F.when(group, "; site scope: possibly a group or international site (no organisation number on site, non-.no domain)").when(foreign, "; site scope: a page naming this company on a site under another name (chain, directory or platform); only the URL is published").otherwise("")
    held = F.struct(F.concat(F.coalesce(why, F.lit("")), F.when(proof.isNotNull(), F.concat(F.lit("; on the site: “"), proof, F.lit("”"))).otherwise(""), tail).alias("text"), (proof.isNotNull() & (tail == "")).alias("exact"))
    scoped = F.struct(F.coalesce(proof, F.concat_ws(": ", url.host(F.col("final_url")), why)).alias("text"), proof.isNotNull().alias("exact"))
    gate = {"method": "identity_gate"}
    cited = lambda rows: evidence.with_record(rows) if "source_url" in rows.columns else evidence.with_record(rows.withColumn("source_url", F.col("url")))
    page = F.concat(F.lit("careers page linked from the verified company website: "), "url")
    found_in = F.concat(F.coalesce("declared_in", F.lit("a[href]")), F.lit(" on the verified company website: "), "url") if "declared_in" in profiles.columns else F.concat(F.lit("a[href] on the verified company website: "), "url")
    where = F.coalesce("declared_in", F.lit("a[href]")) if "declared_in" in profiles.columns else F.lit("a[href]")
    line = F.concat("title", F.lit(" ("), F.concat_ws(": ", F.col("locator"), F.col("date")) if "locator" in news.columns else F.col("date"), F.lit(")"))
    fixed = lambda rows, family, field, value, **how: build(rows, "org", family, field, value, F.lit(field), **how)
    return union((
        build(own, "org", "official_website", "official_website", F.col("address"), F.lit("official_website"), locator="html (identity gate)", span=held, confidence=F.col("confidence"), **gate),
        fixed(own, "public_brand", "website_scope", F.col("scope"), locator="identity_markers", span=scoped, **gate),
        fixed(named, "public_brand", "website_brand_title", F.left("brand", F.lit(200)), locator="html>head>title", span=evidence.verbatim(F.left("brand", F.lit(200))), **gate),
        fixed(named, "public_brand", "self_description", F.left("description", F.lit(600)), locator='meta[name="description"]', span=evidence.verbatim(F.col("description")), **gate),
        fixed(declared, "public_brand", "registry_declared_site", F.struct(url.without_default_port(F.col("final_url")).alias("url"), F.lit(relation).alias("relation")), method="registry_hjemmeside_v1", locator="$.hjemmeside", confidence=F.lit(0.6), span=quotes.quote_json(F.col("raw"), "hjemmeside", fallback=ids.json_string(F.col("final_url"))) if "raw" in sites.columns else None),
        build(linked, "org", "company_profiles", {"company_profile": None, "social_profile": "company_profile"}, F.col("url"), _texts(F.col("platform"), F.col("url")), "platform", locator=where, span=evidence.rendered(found_in), **gate),
        build(cited(local(careers).withColumn("signal", F.lit("careers_page"))), "org", "jobs", "hiring_signal", F.col("url"), _texts(F.lit("careers_page"), F.col("url")), "signal", method="site_page_markup_v1", locator="a[href]", span=evidence.rendered(page)),
        build(cited(told), "org", "dated_activity", {"dated_news": None, "dated_activity": "dated_news"}, F.concat("title", F.lit(" ("), F.coalesce("published_at", "date"), F.lit(")")), _texts(F.lit("website_news"), F.col("url")), "effective_date", "title", method="site_page_markup_v1", locator=F.col("locator") if "locator" in news.columns else None, span=evidence.verbatim(line)),
    ))


def union(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
