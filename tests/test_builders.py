"""Claims by source, group trees, dated items and profiles of pages, and the ways of finding sites and ads."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import html, tree, url
from claimloom.operators import builders, metrics, normalise, resolve

DAY = "2025-06-30"


def on_page(spark, markup, column):
    """UDF results need a column, not a literal."""
    return spark.createDataFrame([(markup,)], "html string").select(column.alias("x")).first()["x"]


def test_objects_of_a_document(spark):
    body = json.dumps({"a": [{"k": 1, "b": {"k": 2}}, {"c": [{"k": None}]}]})
    got = spark.createDataFrame([(body,), ("{",), (None,), ("",)], "j string").select(tree.objects_with(F.col("j"), "k").alias("x")).collect()
    assert [[json.loads(o)["k"] for o in r["x"]] for r in got] == [[1, 2], [], [], []]


def test_group_links_at_any_depth(spark):
    node = lambda child, parent, **more: {"organisasjonsnummer": child, "parentOrganisasjonsnummer": parent, "navn": f"N{child}", "parentNavn": f"N{parent}", **more}
    body = json.dumps({"top": {"children": [node("1", "9"), {"deeper": [node("2", "1", dato="old"), node("2", "1", dato="new"), node("4", "3")]}]}})
    links = normalise.group_links(spark.createDataFrame([("1", body), ("5", None)], "org string, body string"), "org")
    rows = links.orderBy("rank").collect()
    assert [(r["relation"], r["organisation_number"], r["name"], r["as_of"]) for r in rows] == [("parent", "9", "N9", None), ("subsidiary", "2", "N2", "new")]
    assert {r["field"] for r in builders.group_relationships(links).collect()} == {"parent", "subsidiary"}


def test_dates_and_obligation(spark):
    body = '[{"time":"2025-02-01T10:00"},{"time":"2024-01-01T00:00"},{"time":"2025-02-01T11:00"},{"time":null}]'
    got = normalise.role_events(spark.createDataFrame([("1", body), ("2", None)], "org string, body string"), "org").collect()
    assert [r["role_change_dates"] for r in got] == [["2024-01-01", "2025-02-01"], []]
    forms = spark.createDataFrame([("as", None), ("ENK", None), ("ENK", "2024"), (None, None)], "f string, y string").select(normalise.accounting_obligation(F.col("f"), F.col("y")).alias("x")).collect()
    assert [r["x"] for r in forms] == ["required_by_legal_form", "threshold_or_activity_dependent", "filing_observed", "special_rule_or_review_required"]


@pytest.mark.parametrize(
    "href, wanted",
    [("/a", "https://x.no/a"), ("b.html", "https://x.no/p/b.html"), ("https://y.no/", "https://y.no/"), ("//z.no/c", "https://z.no/c"), ("mailto:a@b", None), ("#top", "https://x.no/p/q"), ("../up", None)],
)
def test_links_are_joined(spark, href, wanted):
    assert spark.range(1).select(url.join(F.lit("https://x.no/p/q"), F.lit(href))).first()[0] == wanted


def test_profiles_of_a_page(spark):
    page = """<a href="https://www.facebook.com/Acme/">f</a><a href='x' data-href="https://facebook.com/acme"></a>
      <script type="application/ld+json">{"@type": "Organization", "sameAs": ["https://linkedin.com/company/acme", "https://facebook.com/ACME"]}</script>
      <script type="application/ld+json">{"@type": "Person", "sameAs": "https://x.com/someone"}</script><script type="application/ld+json">not json</script>
      <meta property="article:publisher" content="https://instagram.com/acme">"""
    got = on_page(spark, page, html.social_links(F.col("html")))
    assert [(x["platform"], x["declared_in"]) for x in got] == [("facebook", "a[href]"), ("instagram", 'meta[property="article:publisher"]'), ("linkedin", "ld+json:sameAs")]
    assert on_page(spark, None, html.social_links(F.col("html"))) in ([], None)


def test_dated_items_and_articles(spark):
    listing = """<ul><li><a href="/nyheter/stor-nyhet">Stor nyhet om Acme</a> <time datetime="2025-05-02T10:00">2. mai</time></li><li><a href="/x">kort</a><time datetime="2025-05-03"></time></li></ul>
      <script type="application/ld+json">[{"@type": "NewsArticle", "headline": "Fra merkingen", "datePublished": "2025-05-01", "url": "https://x.no/nyheter/fra-merkingen#a"}]</script>"""
    got = on_page(spark, listing, html.dated_items(F.col("html"), F.lit("https://x.no/nyheter"), F.lit(DAY).cast("date")))
    assert [(x["date"], x["title"], x["url"]) for x in got] == [("2025-05-02", "Stor nyhet om Acme", "https://x.no/nyheter/stor-nyhet"), ("2025-05-01", "Fra merkingen", "https://x.no/nyheter/fra-merkingen")]
    article = '<meta property="article:published_time" content="2025-04-01T08:00:00Z"><h1>En lang overskrift</h1>'
    item = on_page(spark, article, html.article_item(F.col("html"), F.lit("https://x.no/nyheter/en-sak"), F.lit(DAY).cast("date")))
    assert (item["date"], item["title"]) == ("2025-04-01", "En lang overskrift")
    assert on_page(spark, article, html.article_item(F.col("html"), F.lit("https://x.no/om-oss"), F.lit(DAY).cast("date"))) is None
    links = '<a href="/nyheter/en-god-sak">a</a><a href="/nyheter/en-god-sak/">b</a><a href="/nyheter">c</a><a href="https://y.no/nyheter/en-annen-sak">d</a>'
    assert on_page(spark, links, html.article_links(F.col("html"), F.lit("https://www.x.no/"))) == ["https://www.x.no/nyheter/en-god-sak"]
    site = "<urlset><url><loc>https://x.no/nyheter/gammel-sak</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x.no/nyheter/ny-sak-her</loc><lastmod>2025-01-01</lastmod></url><url><loc>https://x.no/produkter/a</loc></url></urlset>"
    assert on_page(spark, site, html.sitemap_articles(F.col("html"), F.lit("https://x.no/"))) == ["https://x.no/nyheter/ny-sak-her", "https://x.no/nyheter/gammel-sak"]


def test_web_presence_by_scope(spark):
    scopes = {"1": "norwegian_domain", "2": "possibly_group_or_international", "3": "page_on_third_party_site"}
    sites = spark.createDataFrame([(o, f"HTTPS://S{o}.no:443/", True, True, 0.95, s, "Brand", "Vi lager ting") for o, s in scopes.items()] + [("4", "https://s4.no/", False, True, 0.3, None, None, None)], "org string, final_url string, publishable boolean, listed boolean, score double, scope string, brand string, description string")
    profiles = spark.createDataFrame([(o, "facebook", f"https://facebook.com/{h}") for o in scopes for h in ("acme", "acme-norge")], "org string, platform string, url string")
    careers = spark.createDataFrame([(o, f"https://s{o}.no/jobb") for o in scopes], "org string, url string")
    news = spark.createDataFrame([(o, "Nytt kontor", "2025-05-01", None, f"https://s{o}.no/n") for o in scopes], "org string, title string, date string, published_at string, url string")
    rows = builders.web_presence(sites, profiles, careers, news).collect()
    by = {(r["org"], r["field"], r["value_json"]): r for r in rows}
    fields = lambda o: sorted(r["field"] for r in rows if r["org"] == o)
    assert fields("1") == sorted(["official_website", "website_scope", "website_brand_title", "self_description", "company_profile", "social_profile", "company_profile", "social_profile", "hiring_signal", "dated_news", "dated_activity"])
    assert fields("2") == sorted(["official_website", "website_scope", "website_brand_title", "self_description", "company_profile", "social_profile"])
    assert fields("3") == ["official_website", "website_scope"] and fields("4") == ["registry_declared_site"]
    assert by["1", "official_website", '"https://s1.no/"']["confidence"] == 0.95 and by["2", "official_website", '"https://s2.no/"']["confidence"] == 0.8
    assert by["1", "dated_activity", '"Nytt kontor (2025-05-01)"']["alias_of"] == "dated_news" and by["1", "dated_news", '"Nytt kontor (2025-05-01)"']["alias_of"] is None


def test_ads_gate_and_discovery(spark):
    names = spark.createDataFrame([("1", "Lindberg Elektro AS"), ("2", "Nordlys Fiske AS")], "org string, name string")
    ads = spark.createDataFrame([("a", "Lindberg Elektro", "ACTIVE", "2025-01-01"), ("b", "Lindberg Elektro", "ACTIVE", "2025-01-02")], "uuid string, business_name string, status string, modified string")
    entries = spark.createDataFrame([("a", 200, "1"), ("b", 200, "8")], "uuid string, code int, employer_orgnr string")
    none = spark.createDataFrame([], "org string, unit string")
    jobs, report = resolve.match_jobs(names, ads, entries, none, feed_complete=False)
    assert [r["uuid"] for r in jobs.collect()] == ["a"]
    assert {r["org"]: (r["checked"], r["matched"], r["rejected"], r["status"]) for r in report.collect()} == {"1": (2, 1, 1, "available"), "2": (0, 0, 0, "source_error")}
    assert {r["status"] for r in resolve.match_jobs(names, ads, entries, none, feed_complete=True)[1].collect()} == {"available"}
    sites = spark.createDataFrame([("1", "Acme Ventilasjon AS", True), ("2", "Acme Ventilasjon AS", False)], "org string, name string, publishable boolean")
    links = spark.createDataFrame([(o, "facebook", f"https://facebook.com/{h}") for o in "12" for h in ("acmeventilasjon", "other")], "org string, platform string, url string")
    assert [(r["org"], r["url"]) for r in resolve.gate(sites, links).filter("publishable").collect()] == [("1", "https://facebook.com/acmeventilasjon")]
    found = spark.createDataFrame([("1", "guess", 1, "u1", 0.9, False), ("1", "guess", 2, "u2", 0.9, False), ("1", "guess", 3, "u3", 0.9, True), ("1", "search", 1, "u4", 0.9, True)], "org string, way string, rank int, url string, score double, publishable boolean")
    assert [r["url"] for r in resolve.discover(found, {"guess": 2, "search": 2}, ("guess", "search")).collect()] == ["u4"]


def test_counts_and_differences(spark):
    log = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", "h1")], "purpose string, host string")
    assert {(r["kind"], r["name"]): r["n"] for r in metrics.request_counts(log, 1).collect()} == {("purpose", "a"): 2, ("purpose", "b"): 1, ("host", "h1"): 2}
    diff = spark.createDataFrame([(2, "p", "x", "y"), (1, "p", "u", "v"), (1, "q", None, "z")], "k int, path string, before string, after string")
    assert {r["path"]: (r["records"], r["example"]["before"]) for r in metrics.differing_fields(diff, "k").collect()} == {"p": (2, "u"), "q": (1, None)}
