"""Links and labels of markup as it comes, suffixes, whole sites, identity and discovery, streams of listings."""

import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from claimloom.functions import html, text, tree, url
from claimloom.operators import discovery, domains, resolve, site
from claimloom.streaming import changelog

AS_OF = date(2024, 6, 30)


def one(spark, value, body="x"):
    return spark.createDataFrame([(body,)], "h string").select(value(F.col("h")).alias("v")).first()["v"]


def test_links_of_any_quoting(spark):
    page = """<a href='/om-oss'>Om oss</a><A class=x HREF=/kontakt>Kontakt <b>oss</b></A><a data-href="/no" href="/ja">Ja</a><a name=top>Topp</a><abbr href="/x">x</abbr><a href="/uten">Uten slutt<a href="/siste">Siste"""
    assert [tuple(x) for x in one(spark, html.links, page)] == [("/om-oss", "Om oss"), ("/kontakt", "Kontakt oss"), ("/ja", "Ja"), ("/uten", "Uten slutt"), ("/siste", "Siste")]
    assert one(spark, html.hrefs, """<a href='/a'><link href="/b"><a href=/c>""") == ["/a", "/b", "/c"]


@pytest.mark.parametrize("body", ["<a href='/x'>" * 8000, "<script>" * 8000, "<title>" * 8000, "<script type=application/ld+json>" * 4000, "<a " * 20000, "<style>" * 8000])
def test_unclosed_tags_take_linear_time(spark, body):
    none = F.lit(None).cast("string")
    every = lambda c: F.struct(F.size(html.links(c)), F.length(html.title(c)), F.size(html.marker_snippets(c, F.lit("999999999"), F.array(F.lit("22334455")), F.lit("Storgata"), F.lit("0155"))), F.size(html.json_ld(c)), F.length(html.strip_tags(c)), none)
    one(spark, every)
    began = time.time()
    one(spark, every, body)
    assert time.time() - began < 6


@pytest.mark.parametrize("path,careers", [("/join-us", True), ("/join/us", False), ("/bli/med", False), ("/ledige-stillinger", True), ("/ledige/plasser", False), ("/bestilling", False), ("/jobber", False), ("/om/jobb", True), ("/stillinger_ledige", True)])
def test_careers_paths(spark, path, careers):
    assert one(spark, url.names_careers, path) is careers


def test_fold_of_rare_letters(spark):
    assert one(spark, text.fold, "Ærlig Ößtrø Ñandú ﬁn ½ ① 𝐀𝐁 Å㎏ Ⅷ 中") == "aerlig otro nandu fin 12 1 ab akg viii "
    assert one(spark, text.fold, None) == "" and one(spark, text.fold, "PLAIN") == "plain"


def test_strings_under_keys_at_any_depth(spark):
    body = '[{"name":"A","x":{"legalName":"B","name":{"name":"C"}},"alternateName":["D",{"name":"E"}]},{"y":[{"name":"F"}]}]'
    assert one(spark, lambda c: tree.strings_of(c, "name", "legalName", "alternateName"), body) == ["A", "B", "C", "E", "F"]
    assert one(spark, lambda c: tree.strings_of(c, "name"), "not json") == [] and one(spark, lambda c: tree.strings_of(c, "name"), None) == []


def test_domains_by_a_table_of_suffixes(spark):
    rules = spark.createDataFrame([(r,) for r in ("com", "nz", "govt.nz", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "no", "// comment", "", None, "COM")], "rule string")
    cases = {
        "a.govt.nz": "a.govt.nz", "x.a.govt.nz": "a.govt.nz", "govt.nz": None, "nz": None, "b.c.kawasaki.jp": "b.c.kawasaki.jp", "c.kawasaki.jp": None, "a.b.c.kawasaki.jp": "b.c.kawasaki.jp",
        "city.kawasaki.jp": "city.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "www.ck": "www.ck", "a.www.ck": "www.ck", "a.b.ck": "a.b.ck", "b.ck": None, "WWW.Example.COM.": "example.com",
        "host.unlisted": "host.unlisted", "10.0.0.1": None, "a..no": None, "": None,
    }
    hosts = spark.createDataFrame([(h, 1) for h in [*cases, "a.govt.nz"]] + [(None, 2)], "host string, suffix int")
    got = {r["host"]: r["domain"] for r in domains.registered_domains(hosts, rules).collect()}
    assert got == cases
    kept = domains.with_domain(hosts, rules)
    assert kept.columns == ["host", "suffix", "domain"] and kept.count() == len(cases) + 2


def page(head="", body=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


FILL = "<p>" + "Vi lager ting som folk trenger, hver dag. " * 4 + "</p>"


def documents(spark, pages):
    return site.facts(spark.createDataFrame(list(pages.items()), "url string, html string"), F.lit(AS_OF))


def test_a_site_is_composed_in_rounds(spark):
    dated = '<article><h2>En nyhet om noe</h2><time datetime="2024-05-01"></time><a href="/aktuelt/forste-nyhet">x</a></article><article><h2>Noe som ikke har vært</h2><time datetime="2030-01-01"></time></article>'
    pages = {
        "https://firma.no/": page("<title>Firma</title>", "<a href=/om-oss>Om</a><a href='/nyheter'>Nytt</a><a href='/kontakt'>K</a><a href='https://andre.no/jobb'>J</a><a href='https://www.linkedin.com/company/firma'>in</a>" + FILL),
        "https://firma.no/om-oss": page("<title>Om</title>", '<a href="/nyheter/en-artikkel">les</a><a href="https://x.com/firma">x</a>'),
        "https://firma.no/nyheter": page("<title>Nytt</title>", dated + '<a href="/nyheter/en-artikkel#a">igjen</a><a href="/nyheter/borte-vekk">borte</a>'),
        "https://firma.no/nyheter/en-artikkel": page('<meta property="article:published_time" content="2024-06-01T10:00:00Z">', "<h1>Artikkel nummer en</h1>"),
        "https://firma.no/aktuelt/forste-nyhet": page('<meta property="article:published_time" content="2024-05-01">', "<h1>En nyhet om noe</h1>"),
        "https://firma.no/sitemap.xml": '<?xml version="1.0"?><sitemapindex><sitemap><loc>https://firma.no/kart.xml</loc></sitemap><sitemap><loc>https://andre.no/kart.xml</loc></sitemap></sitemapindex>',
        "https://firma.no/kart.xml": '<?xml version="1.0"?><urlset><url><loc>https://firma.no/nyheter/fra-kartet</loc><lastmod>2024-01-01</lastmod></url></urlset>',
        "https://firma.no/nyheter/fra-kartet": page('<meta property="article:published_time" content="2023-01-01">', "<h1>Funnet i et kart</h1>"),
        "https://stengt.no/": page("<title>Just a moment...</title>"),
    }
    seeds = spark.createDataFrame([("firma.no",), ("http://www.firma.no",), ("stengt.no",), ("borte.no",), ("http://127.0.0.1/",), (None,), ("",)], "url string")
    sites, visited = site.compose(seeds, documents(spark, pages))
    by = {r["site"]: r for r in sites.collect()}
    assert {k: r["status"] for k, r in by.items()} == {"firma.no": "available", "stengt.no": "blocked", "borte.no": "source_error", "127.0.0.1": "blocked"}
    firma = by["firma.no"]
    assert [p["category"] for p in firma["pages"]] == ["about", "news"] and firma["errors"] == ["https://firma.no/kontakt"] and firma["careers"] == []
    assert [(x["date"], x["title"], x["url"]) for x in firma["news"]] == [
        ("2024-06-01", "Artikkel nummer en", "https://firma.no/nyheter/en-artikkel"), ("2024-05-01", "En nyhet om noe", "https://firma.no/aktuelt/forste-nyhet"), ("2023-01-01", "Funnet i et kart", "https://firma.no/nyheter/fra-kartet")]
    assert firma["news"][1]["source"] == "https://firma.no/nyheter"  # the listing, not the article, as it was seen first
    assert {s["platform"] for s in firma["social"]} == {"linkedin", "x"}
    # home, three pages, two documents of the sitemap, four articles of which one is not there
    assert firma["requests"] == 1 + 3 + 2 + 4
    assert {r["key"] for r in visited.collect()} == {"firma.no", "firma.no/om-oss", "firma.no/nyheter"}
    # a budget of pages and articles
    less, _ = site.compose(seeds, documents(spark, pages), most_pages=1, most_articles=1)
    small = {r["site"]: r for r in less.collect()}["firma.no"]
    assert [p["category"] for p in small["pages"]] == ["about"] and [x["title"] for x in small["news"]] == ["Artikkel nummer en"]


def test_no_pages_no_sites(spark):
    nothing = documents(spark, {"https://x.no/": ""}).limit(0)
    sites, visited = site.compose(spark.createDataFrame([("x.no",)], "url string"), nothing)
    assert [r["status"] for r in sites.collect()] == ["source_error"] and visited.count() == 0


def test_identity_reads_the_whole_site(spark):
    graph = '<script type="application/ld+json">{"@graph":[{"@type":"Organization","sub":{"legalName":"Nordlys Verft AS"}}]}</script>'
    pages = {
        "https://a.no/": page("<title>Hjem</title>" + graph, FILL), "https://b.no/": page("<title>Hjem</title>", "<a href=/kontakt>Kontakt</a>" + FILL), "https://b.no/kontakt": page("", "Org.nr. 999 888 777"),
        "https://c.no/": page("<title>Hjem</title>", "<a href=/om-oss>Om</a>" + FILL), "https://c.no/om-oss": page("", "Nordlys og Verft i nord"), "https://d.no/": page("<title>Hjem</title>", "<a href=/om-oss>Om</a>" + FILL), "https://d.no/om-oss": page("<title>This domain is for sale</title>", "Nordlys Verft"),
    }
    schema = "org string, name string, url string, listed boolean, phones array<string>, street string, postal string"
    companies = spark.createDataFrame([(str(999888777 if h == "b" else k), "Nordlys Verft AS", f"{h}.no", True, None, None, None) for k, h in enumerate("abcd")], schema)
    made = documents(spark, pages)
    _, visited = site.compose(companies, made)
    got = {r["site"]: (r["score"], r["publishable"], r["markers"]) for r in site.identity(companies, visited, made).collect()}
    assert got == {"a.no": (0.95, True, []), "b.no": (1.0, True, ["organisation_number"]), "c.no": (0.85, False, []), "d.no": (0.1, False, [])}


def test_labels_of_hosts(spark):
    assert [one(spark, resolve.host_label, h) for h in ("www.nordlys-verft.no", "x.firma.co.uk", "a-b-as.no", "no", "")] == ["nordlysverft", "co", "", "", ""]


def test_discovery_goes_on_where_a_stage_fails(spark):
    pages = {
        "https://nordlysverft.no/": page("<title>Nordlys Verft</title>", "<a href=/kontakt>Kontakt</a>" + FILL), "https://nordlysverft.no/kontakt": page("", "Ring 22 33 44 55"),
        "https://fjellogdal.com/": page("<title>Annet</title>", FILL), "https://havgard.org/": page("<title>Havgard Drift</title>", "<a href=/kontakt>Kontakt</a>" + FILL), "https://havgard.org/kontakt": page("", "999888777"),
    }
    schema = "org string, name string, form string, closed boolean, resolved boolean, email_domain string, municipality string, phones array<string>, street string, postal string"
    companies = spark.createDataFrame([
        ("111111111", "Nordlys Verft AS", "AS", False, False, "gmail.com", None, ["22334455"], None, None), ("222222222", "Fjell og Dal AS", "AS", False, False, None, None, None, None, None),
        ("999888777", "Havgard Drift AS", "AS", True, False, None, None, None, None, None), ("333333333", "Ferdig AS", "AS", False, True, None, None, None, None, None),
    ], schema)
    hosts = spark.createDataFrame([("www.nordlysverft.no",), ("nordlysverft.no",), ("fjelldal.com",), ("fjellogdal.com",)], "host string")
    results = spark.createDataFrame([("999888777", 1, "https://proff.no/999888777", "Havgard Drift AS", ""), ("999888777", 2, "https://havgard.org/om", "Havgard Drift AS", ""), ("333333333", 1, "https://ferdig.no/", "Ferdig AS", "")], "org string, rank int, url string, title string, snippet string")
    found, tried = discovery.cascade(companies, hosts, results, documents(spark, pages))
    assert {(r["org"], r["way"], r["site"], r["score"]) for r in found.collect()} == {("111111111", "name_derived_domain", "nordlysverft.no", 0.95), ("999888777", "search_discovered_website", "havgard.org", 1.0)}
    rows = [(r["org"], r["stage"], r["target"], r["result"]) for r in tried.collect()]
    assert [r for r in rows if r[0] == "111111111"] == [("111111111", "guess", "nordlysverft.no", "verified")]
    assert {r[3] for r in rows if r[0] == "222222222"} <= {"no DNS", "source_error", "homepage does not name the company"} and not [r for r in rows if r[0] == "333333333" or "proff" in r[2]]
    assert discovery.cascade(companies.limit(0), hosts, results, documents(spark, pages))[1].count() == 0


def test_only_complete_listings_prove_absence(spark, tmp_path):
    schema = "id string, run int"
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    complete = [True, False, True, True]
    listings = [["a", "b", "c"], ["a"], ["a", "d"], ["a", "b"]]
    seen = []
    for run, ids in enumerate(listings):
        spark.createDataFrame([(i, run) for i in ids], schema).coalesce(1).write.mode("append").parquet(folder)
        feed = changelog.read_feed(spark, folder, spark.createDataFrame([], schema).schema)
        changelog.upsert(feed, state, ["id"], ["run"], str(tmp_path / "cp"), complete=lambda n: complete[n], buckets=3, listing=True).awaitTermination()
        rows = changelog.read_state(spark, state, feed.schema, tombstones=True).collect()
        seen.append({r["id"]: r["gone_in"] for r in rows})
        assert {r["id"] for r in changelog.read_state(spark, state, feed.schema).collect()} == {r["id"] for r in rows if r["gone_in"] is None}
    assert seen == [{"a": None, "b": None, "c": None}, {"a": None, "b": None, "c": None}, {"a": None, "b": 2, "c": 2, "d": None}, {"a": None, "b": None, "c": 2, "d": 3}]
    assert len(list((tmp_path / "state-status").glob("version=*"))) <= 2


def test_rows_behind_the_watermark_are_left_out_and_counted(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    days = [["2024-01-01", "2024-01-02"], ["2024-01-20"], ["2024-01-21", "2024-01-02"], ["2024-01-22", "2024-01-01", "2024-01-16"]]
    for part in days:
        spark.createDataFrame([(f"{d} 12:00:00", "k") for d in part], "t string, key string").select(F.to_timestamp("t").alias("ts"), "key").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    query = changelog.window_counts(changelog.read_feed(spark, folder, schema), state, "ts", "key", str(tmp_path / "cp"), "5 days")
    query.awaitTermination()
    assert changelog.late_rows(query) == 1
    got = {r["start"].strftime("%m-%d"): r["n"] for r in changelog.read_state(spark, state, spark.createDataFrame([], "start timestamp, key string, n long").schema).collect()}
    # the third file's row of the second day was in time: when it came, only the first file had moved the watermark
    assert sum(got.values()) == 8 - 1 and got["01-02"] == 2 and got["01-01"] == 1 and got["01-16"] == 1
