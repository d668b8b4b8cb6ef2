"""Quotes of sources, feeds of both kinds, snippets of pages and addresses with dots."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import html, quotes, text, url

DAY = "2025-06-30"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def day():
    return F.lit(DAY).cast("date")


RAW = '{"navn" : "Acme AS", "antall":  12.0, "aktiv": true, "kode": {"navn": "X"}, "tom": null, "navn":"Acme"}'


@pytest.mark.parametrize(
    "key, expected, wanted",
    [
        ("navn", None, ('"navn" : "Acme AS"', True)),
        ("navn", '"Acme"', ('"navn":"Acme"', True)),
        ("antall", "12", ('"antall": 12.0', True)),
        ("aktiv", "true", ('"aktiv": true', True)),
        ("aktiv", "1", ('"aktiv": 1', False)),
        ("kode", '{"navn":"X"}', ('"kode": {"navn": "X"}', True)),
        ("tom", None, ('"tom": null', True)),
        ("mangler", '"y"', ('"mangler": "y"', False)),
        ("mangler", None, ('"mangler": null', False)),
    ],
)
def test_quotes(spark, key, expected, wanted):
    got = value(spark, quotes.quote_json(F.lit(RAW), key, None if expected is None else F.lit(expected)))
    assert (got["text"], got["exact"]) == wanted


def test_quotes_of_nothing(spark):
    got = value(spark, quotes.quote_json(F.lit(None).cast("string"), "a", F.lit("1"), suffix=F.lit(" · s")))
    assert (got["text"], got["exact"]) == ('"a": 1 · s', False)
    assert value(spark, quotes.anchor_quote(F.lit('{"a":"x","orgnr" : "888567232"}'), F.lit("888567232"))) == '"orgnr" : "888567232"'
    assert value(spark, quotes.record_span(F.lit("{}"), F.lit("1"), F.lit("https://r"))) == "record for organisation number 1 returned by https://r"


def test_index_of_quotes(spark):
    rows = spark.createDataFrame([(1, '{"id" : "a", "x": [{"id":"b"},{"id":"a"}]}'), (2, None), (3, '{"id":"q\\"r"}')], "k int, body string")
    got = {(r["k"], r["value"]): r["quote"] for r in quotes.index_quotes(rows, ["k"], "body", "id").collect()}
    assert got == {(1, "a"): '"id" : "a"', (1, "b"): '"id":"b"', (3, 'q\\"r'): '"id":"q\\"r"'}


@pytest.mark.parametrize(
    "name, org, wanted",
    [
        ("Kari Lindberg", None, ('"etternavn": "Lindberg" · rolle: Leder (LEDE)', True)),
        ("Ola van  Dyck", None, ('"etternavn":"van Dyck" · rolle: Leder (LEDE)', True)),
        ("Per Ås", None, ('"navn": "Per Ås" · rolle: Leder (LEDE)', False)),
        ("Revisor AS", "987", ('"organisasjonsnummer":"987" · rolle: Leder (LEDE)', True)),
    ],
)
def test_quotes_of_roles(spark, name, org, wanted):
    raw = '[{"etternavn":"Berg"},{"etternavn": "Lindberg"},{"etternavn":"van Dyck"},{"organisasjonsnummer":"987"}]'
    got = value(spark, quotes.role_quote(F.lit(raw), F.lit(name), F.lit(org).cast("string"), F.lit("Leder"), F.lit("LEDE")))
    assert (got["text"], got["exact"]) == wanted


def test_proof_and_rights(spark):
    rows = [("https://a.no/", "phone", "tlf 22"), ("https://a.no/om", "address", "Storgata 1"), ("https://a.no/x", "address", "later")]
    found = spark.createDataFrame([(rows,), ([],), (None,)], "s array<struct<url:string,marker:string,text:string>>").select(quotes.site_proof(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in found] == ["Storgata 1 (https://a.no/om)", None, None]
    classes = spark.createDataFrame([("official_registry",), ("official_job_register_nav",), (None,), ("mine",)], "c string").select(quotes.source_rights(F.col("c"), quotes.RIGHTS | {"mine": "own"}).alias("x"))
    assert [r["x"].split(",")[0].split(" ")[0] for r in classes.collect()] == ["Brønnøysund", "NAV", "public", "own"]


def test_feeds_of_both_kinds(spark):
    rss = """<?xml version="1.0"?><rss><channel><title>Feed</title>
      <item><title>No date</title><link>/a</link></item>
      <item><title><![CDATA[A & B]]></title><link>https://x.no/b#c</link><pubDate>Tue, 06 May 2025 23:30:00 +0200</pubDate></item>
      <item><title>Elsewhere</title><link>https://y.no/</link><pubDate>Tue, 06 May 2025 23:30:00 GMT</pubDate></item>
      <item><title>C &amp; D</title><link>../d</link><dc:date>2025-06-01T08:00:00Z</dc:date></item></channel></rss>"""
    got = value(spark, html.feed_items(F.lit(rss), day(), F.lit("https://www.x.no/news/feed")))
    assert [tuple(i) for i in got] == [
        ("2025-06-01", "2025-06-01T08:00:00Z", "C & D", "https://www.x.no/d", "rss:item/pubDate"),
        ("2025-05-06", "2025-05-06T23:30:00+02:00", "A & B", "https://x.no/b", "rss:item/pubDate"),
    ]
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">One</title><link rel="self" href="https://x.no/self"/><link href="/one"/><updated>2025-05-01</updated></entry>
      <entry><title>Two</title><link rel="enclosure" href="/two"/><published>2025-05-01T10:00:00Z</published><updated>2025-05-09</updated></entry>
      <entry><title>Later</title><link href="/three"/><published>2025-08-01</published></entry></feed>"""
    got = value(spark, html.feed_items(F.lit(atom), day(), F.lit("https://x.no/feed")))
    assert [(i["date"], i["published_at"], i["title"], i["url"]) for i in got] == [("2025-05-01", None, "One", "https://x.no/one"), ("2025-05-01", "2025-05-01T10:00:00Z", "Two", "https://x.no/two")]
    assert value(spark, html.feed_items(F.lit("<rss><item>"), day(), F.lit("https://x.no/"))) == []


def test_declared_feeds(spark):
    page = """<link rel="stylesheet" href="a.css"><link rel="alternate" type="application/rss+xml" href="/comments/feed"><link rel="alternate" type="application/rss+xml" title="Comments" href="/c">
      <link rel="alternate" type="application/rss+xml" href="https://other.no/feed"><link rel='alternate' type='application/atom+xml' href='feed.atom'>"""
    assert value(spark, html.declared_feed_url(F.lit(page), F.lit("https://www.x.no/om/"))) == "https://www.x.no/om/feed.atom"
    assert value(spark, html.declared_feed_url(F.lit("<p>"), F.lit("https://x.no/"))) is None


def test_snippets_and_markers(spark):
    page = "<script>999 999 999</script><p>" + "x" * 100 + " Org.nr.&nbsp;888&nbsp;567&nbsp;232, tlf 22.33.44.55</p><p>Storgata 1, 0155 Oslo</p>"
    args = (F.lit(page), F.lit("888567232"), F.array(F.lit("+47 22334455")), F.lit("storgata"), F.lit("0155"))
    found = {s["marker"]: s["text"] for s in value(spark, html.marker_snippets(*args))}
    assert set(found) == {"organisation_number", "phone", "address"}
    assert "888 567 232, tlf" in found["organisation_number"] and found["organisation_number"].startswith("x") and len(found["organisation_number"]) <= 60 + 11 + 40
    assert "22.33.44.55" in found["phone"] and "Storgata 1, 0155 Oslo" in found["address"]
    other = (F.lit("<p>2233 pairs of 4455; 10155 Storgata</p>"), *args[1:])
    assert value(spark, html.identity_markers(*other)) == [] and value(spark, html.marker_snippets(*other)) == []


@pytest.mark.parametrize("href, wanted", [("../up", "https://x.no/p/up"), ("../../../a/./b?q=..#f", "https://x.no/a/b?q=..#f"), ("./c/..", "https://x.no/p/q/"), ("?n=2", "https://x.no/p/q/r?n=2"), ("mailto:a", None), ("", "https://x.no/p/q/r")])
def test_links_with_dots(spark, href, wanted):
    assert value(spark, url.absolute(F.lit("https://x.no/p/q/r"), F.lit(href))) == wanted


def test_keys_of_people_and_profiles(spark):
    assert value(spark, text.person(F.array(F.lit("Kari"), F.lit("Ås")))) == "kari ås"
    assert value(spark, url.handle(F.lit("https://www.Facebook.com/Acme/?x=1"))) == "facebook.com/acme"
