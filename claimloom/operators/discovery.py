"""Sites of companies that no register names, in stages: each stage works on what the one before left unresolved.

Guesses come first: the domain of the registered e-mail address, then domains made of the name; only those that resolve are
probed, in order, within a budget of probes and of crawls. Then results of a search, on domains named after the company. A
candidate is probed by its home page; if that is promising, some of its pages are read, and the site must pass the gate: the
registered number on it, or the exact name with the registered address or phone; a domain that the company has declared to the
register may pass as a listed site does. What budgets let through is looked at together, and what comes after the first verified
candidate of a company does not count as tried.

Defined cases: companies that are resolved, closed or of a form without sites are not guessed for; equal candidates count once, at
their first place; a host that is not in the table of resolving hosts has no DNS; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import url, vocab
from claimloom.operators import resolve, site
from claimloom.session import deal, store

#: Hosts probed and sites crawled for guesses, roots looked at of a search, and pages of a category that a crawl reads.
PROBES, CRAWLS, ROOTS, PAGES = 4, 2, 3, 3
#: A home page of this score is worth a crawl.
PROMISING = 0.85


def _before(column: Column) -> Column:
    """The sum over a company's earlier candidates."""
    return F.coalesce(F.sum(column.cast("int")).over(Window.partitionBy("org").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _home_of(pages: DataFrame) -> DataFrame:
    return pages.filter("challenge is not null").select(F.col("key").alias("site"), F.when(F.col("challenge"), "blocked").otherwise("available").alias("state"))


def guesses(companies: DataFrame, hosts: DataFrame) -> DataFrame:
    """(org, rank, way, target, site, probes): domains that unresolved companies may own, in order. probes: hosts of it that resolve."""
    form = F.coalesce(F.upper("form"), F.lit("")).isin(*vocab.SKIP_GUESS_FORMS)
    # domains of names cost by the company, and companies come in few partitions
    open_ = deal(companies.filter(~F.coalesce("resolved", F.lit(False)) & ~F.coalesce("closed", F.lit(False)) & ~form), "org", slim=True)
    mail = F.lower(F.trim("email_domain"))
    own = F.when(F.contains(mail, F.lit(".")) & ~mail.isin(*vocab.GENERIC_MAIL_DOMAINS), mail)
    listed = F.array_distinct(F.array_compact(F.concat(F.array(own), url.domain_candidates(F.col("name")))))
    rows = open_.select("org", own.alias("_mail"), F.posexplode(listed).alias("rank", "target"))
    rows = rows.withColumn("way", F.when(F.col("target").eqNullSafe(F.col("_mail")), "registry_email_domain").otherwise("name_derived_domain")).drop("_mail")
    there = hosts.select(F.regexp_replace(F.lower("host"), r"^www\.", "").alias("target"), F.lower("host").alias("host")).distinct().groupBy("target").agg(F.count("*").alias("probes"))  # with www. and without
    rows = rows.join(there, "target", "left").withColumn("probes", F.coalesce("probes", F.lit(0)))
    return rows.withColumn("site", url.page_key(F.concat(F.lit("https://"), F.col("target"), F.lit("/"))))


def roots(companies: DataFrame, results: DataFrame) -> DataFrame:
    """(org, rank, way, target, site, probes): roots of search results (org, rank, url, title, snippet) on domains named after the company."""
    # scores cost by the result; stored, as the filters below would be evaluated before rows are dealt
    rows = store(deal(results.join(companies.select("org", "name", "municipality"), "org"), "org", slim=True))
    rows = rows.withColumn("_s", resolve.search_score(F.col("name"), F.col("org"), F.col("municipality"), F.col("url"), F.col("title"), F.col("snippet")))
    host = url.bare_host(F.col("url"))
    rows = rows.filter((F.col("_s.score") > 0) & ~url.blocked(host) & resolve.own_domain(url.host(F.col("url")), F.col("name")))
    rows = rows.withColumn("target", F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), F.lit("/"))).groupBy("org", "target").agg(F.min(F.struct(-F.col("_s.score"), "rank")).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("org").orderBy("_o", "target"))
    return rows.select("org", (rank - 1).alias("rank"), F.lit("search_discovered_website").alias("way"), "target", url.page_key(F.col("target")).alias("site"), F.lit(1).alias("probes")).filter(F.col("rank") < ROOTS)


def judged(companies: DataFrame, candidates: DataFrame, pages: DataFrame, probes: int, crawls: int, any_marker: bool) -> DataFrame:
    """candidates with result, score and verified, those only that were tried: all up to the first that is verified."""
    tried = candidates.join(_home_of(pages), "site", "left")
    cost = F.when(F.col("state") == "available", F.least("probes", F.lit(1))).otherwise(F.col("probes"))
    tried = store(tried.withColumn("_spent", _before(cost)).filter(F.col("_spent") < probes))
    ready = tried.filter("probes > 0 and state = 'available'")
    known = ready.select("org", "rank", "site", "way").join(companies.select("org", "name", "phones", "street", "postal"), "org")
    known = known.withColumns({"url": F.concat(F.lit("https://"), "site", F.lit("/")), "listed": F.col("way") == "registry_email_domain"})
    home = site.identity(known, ready.select("site", F.col("site").alias("key"), F.lit(0).alias("place"), F.lit("home").alias("category")).distinct(), pages)
    seen = F.size("markers") > 0 if any_marker else F.array_contains("markers", "organisation_number")
    home = home.select("org", "site", (seen | (F.col("score") >= PROMISING)).alias("promising"))
    rows = store(tried.join(home, ["org", "site"], "left").withColumn("promising", F.coalesce("promising", F.lit(False))).withColumn("_crawled", _before(F.col("promising"))).filter(F.col("_crawled") < crawls))

    chosen = rows.filter("promising").join(known.select("org", "site", "name", "url", "listed", "phones", "street", "postal"), ["org", "site"])
    _, alive = site.open_homes(chosen.select("url"), pages)
    told = site.open_categories(alive, pages, PAGES)
    whole = site.identity(chosen, site.visited_pages(alive, told), pages)
    number = F.array_contains("markers", "organisation_number")
    exact = (F.col("score") == 0.95) & (F.array_contains("markers", "address") | F.array_contains("markers", "phone"))
    gate = whole.join(chosen.select("org", "site", "listed"), ["org", "site"]).select(
        "org", "site", F.when(number, 1.0).when(exact, 0.95).when(F.col("listed") & F.col("publishable"), F.least(F.lit(0.93), F.col("score"))).alias("score"))
    rows = rows.join(gate, ["org", "site"], "left").withColumn("verified", F.col("score").isNotNull())
    result = (
        F.when(F.col("probes") == 0, "no DNS").when(F.col("state").isNull(), "source_error").when(F.col("state") != "available", F.col("state"))
        .when(~F.col("promising"), "homepage does not name the company").when(F.col("verified"), "verified").otherwise("identity not verified")
    )
    rows = rows.withColumn("_done", _before(F.col("verified"))).filter("_done = 0")
    return rows.select("org", "rank", "way", "target", "site", result.alias("result"), "score", "verified")


def cascade(companies: DataFrame, hosts: DataFrame, results: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, attempts). companies: org, name, form, closed, resolved, email_domain, municipality, phones, street, postal; hosts:
    host, those that resolve; results: org, rank, url, title, snippet; pages: site.facts() of what was fetched.

    found: org, way, site, score; attempts: org, stage, rank, way, target, result.
    """
    first = store(judged(companies, guesses(companies, hosts), pages, PROBES, CRAWLS, any_marker=False))
    left = companies.filter(~F.coalesce("resolved", F.lit(False))).join(first.filter("verified").select("org"), "org", "left_anti")
    second = store(judged(left, roots(left, results), pages, ROOTS, ROOTS, any_marker=True))
    both = first.withColumn("stage", F.lit("guess")).unionByName(second.withColumn("stage", F.lit("search")))
    return both.filter("verified").select("org", "way", "site", "score"), both.select("org", "stage", "rank", "way", "target", "result")
