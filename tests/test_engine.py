"""Decision tables, refresh scenarios and the query language."""

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from claimloom.functions import html, ids, text, url
from claimloom.operators import claims, index, metrics, normalise, refresh, resolve, summary
from claimloom.plans import query_language as ql
from claimloom.sources import readers, sinks
from claimloom.streaming import changelog

CLAIM = "org string, claim_key string, family string, field string, value_json string, value_hash string, alias_of string, signal string, role_code string, stale boolean, evidence_ids array<string>"
STATE = "org string, family string, state string"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names_and_keys(spark):
    v = lambda c: value(spark, c)
    assert v(text.name_tokens(F.lit("Håst Rør AS og Æble"))) == ["hast", "ror", "aeble"]
    assert v(text.ad_tokens(F.lit("J.A. Invest AS"))) == ["j", "a", "invest"]
    assert not v(text.distinctive(text.ad_tokens(F.lit("J.A. Invest AS")))) and v(text.distinctive(text.ad_tokens(F.lit("Lindberg Bygg"))))
    assert v(text.compact_name(F.lit("A Place To Stay Norway AS"))) == "aplacetostay"
    assert v(text.amount_text(F.lit(-1_400_000.0))) == "NOK -1.4 m" and v(text.amount_text(F.lit(2e9), F.lit("USD"))) == "USD 2.0 bn"
    assert v(ids.json_double(F.lit(79869075.0))) == "79869075.0" and v(ids.json_double(F.lit(0.25))) == "0.25"
    assert v(ids.claim_key(F.lit("1"), F.lit("f"), F.lit("g"), F.lit('"A  B"'))) == '1|f|g|"a b"'
    a, b = v(ids.change_id(F.lit("k"), F.lit("t"), F.lit(None), F.lit("h"))), v(ids.change_id(F.lit("k"), F.lit("t"), F.lit("None"), F.lit("h")))
    assert a == b and a.startswith("chg-") and len(a) == 20


@pytest.mark.parametrize(
    "address, category, static",
    [("https://x.no/", None, True), ("https://x.no/om-oss", "about", True), ("https://x.no/bestilling", None, False), ("https://x.no/ledige-stillinger", "careers", True), ("https://career.x.no/a", "careers", False), ("https://x.no/nyheter/stor-sak", "news", False), ("https://x.no/utstilling", None, False)],
)
def test_pages(spark, address, category, static):
    assert value(spark, F.struct(url.page_category(F.lit(address)), url.is_static_page(F.lit(address)))) == (category, static)


def test_addresses(spark):
    v = lambda c: value(spark, c)
    assert v(url.normalize_homepage(F.lit("www.X.no?a=1#b"))) == "https://www.X.no/" and v(url.normalize_homepage(F.lit("ftp://x.no"))) is None
    assert v(url.without_default_port(F.lit("HTTPS://Ex.NO:443/A?b"))) == "https://ex.no/A?b"
    assert v(url.social_profile(F.lit("https://www.linkedin.com/company/acme/about")))["url"] == "https://linkedin.com/company/acme"
    assert v(url.social_profile(F.lit("https://facebook.com/sharer/x"))) is None and v(url.social_profile(F.lit("https://x.com/a/b"))) is None
    assert v(url.registered_domain(F.lit("a.b.co.uk"))) == "b.co.uk" and not v(url.public(F.lit("http://192.168.1.1/")))
    assert v(url.domain_candidates(F.lit("Work System Norway AS")))[:2] == ["worksystemnorway.no", "work-system-norway.no"]


def test_markup(spark):
    v = lambda c: value(spark, c)
    day = F.lit("2025-06-01").cast("date")
    assert v(html.strip_tags(F.lit("<script>x</script><p>a <b>b</b></p>"))) == "a b"
    assert v(html.is_bot_challenge(F.lit("Just a moment..."), F.lit("wait"))) and not v(html.is_bot_challenge(F.lit("Momentum"), F.lit("wait")))
    assert v(text.iso_date(F.lit("on 2025-05-31T10:00"), day)) == "2025-05-31" and v(text.iso_date(F.lit("2025-06-09"), day)) is None and v(text.iso_date(F.lit("2025-02-31"), day)) is None
    feed = "<rss><channel><item><title>Old</title><link>u1</link><pubDate>Mon, 05 May 2025 10:00:00 +0200</pubDate></item><item><title>New</title><link>u2</link><pubDate>Tue, 06 May 2025 10:00:00 GMT</pubDate></item></channel></rss>".replace("GMT", "+0000")
    assert [(x["date"], x["url"]) for x in v(html.feed_items(F.lit(feed), day))] == [("2025-05-06", "u2"), ("2025-05-05", "u1")]
    marks = v(html.identity_markers(F.lit("<p>Org.nr. 888 567 232, tlf 22 33 44 55, Storgata 1, 0155 Oslo</p>"), F.lit("888567232"), F.array(F.lit("+47 22334455")), F.lit("Storgata"), F.lit("0155")))
    assert marks == ["organisation_number", "phone", "address"]


@pytest.mark.parametrize(
    "name, title, body, markers, listed, host, score",
    [
        ("Acme Ventilasjon AS", "Domain for sale", "", [], False, "acme.no", 0.1),
        ("Acme Ventilasjon AS", "Acme Ventilasjon", "hei", [], False, "a.no", 0.95),
        ("Acme AS", "Acme", "kort", [], False, "acme.no", 0.3),
        ("Acme AS", "Acme", "x" * 120, [], False, "acme.no", 0.95),
        ("Acme Ventilasjon Teknikk AS", "Velkommen", "vi", ["organisation_number"], False, "b.no", 1.0),
        ("Acme Ventilasjon AS", "Hjem", "vi", [], True, "acmeventilasjon.no", 0.93),
        ("Work System Norway AS", "Hjem", "vi", ["phone"], True, "worksystem.no", 0.96),
        ("Acme Ventilasjon Teknikk Drift AS", "acme ventilasjon", "teknikk", [], False, "b.no", 0.85),
        ("Fjell B.I.L.", "Fjell", "x" * 200, [], False, "fjell.no", 0.3),
    ],
)
def test_website_ladder(spark, name, title, body, markers, listed, host, score):
    got = value(spark, resolve.website_identity(F.lit(name), F.lit("999999999"), F.lit(title), F.lit(body), F.lit(host), F.array(*map(F.lit, markers)).cast("array<string>"), F.lit(listed)))
    assert got["score"] == pytest.approx(score) and got["publishable"] == (score >= 0.9)


def test_search_results(spark):
    rows = spark.createDataFrame([("https://acme.no/", "Acme Ventilasjon", "i Oslo", 2), ("https://proff.no/acme", "Acme Ventilasjon 999999999", "", 1), ("https://acmeventilasjon.no/", "Acme Ventilasjon", "i Oslo", 3)], "url string, title string, snippet string, rank int")
    s = resolve.search_score(F.lit("Acme Ventilasjon AS"), F.lit("999999999"), F.lit("Oslo"), F.col("url"), F.col("title"), F.col("snippet"))
    scored = rows.withColumn("s", s).select("*", "s.*").withColumn("org", F.lit(1))
    assert {r["url"]: r["score"] for r in scored.collect()} == {"https://acme.no/": 0.55, "https://proff.no/acme": 0.0, "https://acmeventilasjon.no/": 0.85}
    assert [r["url"] for r in resolve.best_candidate(scored, ["org"]).collect()] == ["https://acmeventilasjon.no/"]


def test_ads(spark):
    names = spark.createDataFrame([("1", "Lindberg Elektro AS"), ("2", "J.A. Invest AS")], "org string, name string")
    ads = spark.createDataFrame([("a", "Lindberg Elektro", "ACTIVE", "2025-01-01"), ("b", "Lindberg Elektro avd Bergen", "ACTIVE", "2025-01-02"), ("c", "Lindberg Elektro", "INACTIVE", "2025-01-03"), ("d", "Invest AS", "ACTIVE", "2025-01-03")], "uuid string, business_name string, status string, modified string")
    got = [(r["org"], r["uuid"], r["kind"]) for r in resolve.candidate_ads(names, ads).orderBy("org", "rank").collect()]
    assert got == [("1", "a", 0), ("1", "b", 1), ("2", "d", 0)]  # the employer gate rejects the last
    jobs = spark.createDataFrame([("u1", "1", "1"), ("u2", "9", "1"), ("u3", "7", "1")], "uuid string, employer_orgnr string, org string")
    gate = {r["uuid"]: r["matched_via"] for r in resolve.employer_gate(jobs, spark.createDataFrame([("1", "7")], "org string, unit string")).collect()}
    assert gate == {"u1": "exact_organisation_number", "u2": None, "u3": "registered_subunit"}


def run(spark, before, after, p_state=None, c_state=None):
    row = lambda k, family, h, **x: ("1", k, family, x.get("field", family), h, h, x.get("alias"), x.get("signal"), x.get("role"), x.get("stale"), ["e" + h])
    make = lambda rows: spark.createDataFrame([row(*r[:3], **(r[3] if len(r) > 3 else {})) for r in rows], CLAIM)
    states = lambda given: spark.createDataFrame([("1", f, (given or {}).get(f, "available")) for f in ("jobs", "leadership", "annual_accounts", "official_website", "company_profiles", "dated_activity", "filing_history", "legal_identity")], STATE)
    return refresh.apply(make(before), make(after), states(p_state), states(c_state))


@pytest.mark.parametrize(
    "before, after, p_state, c_state, actions, kinds",
    [
        ([("k", "jobs", "a")], [("k", "jobs", "a")], None, None, {"k": "unchanged"}, []),
        ([("k", "leadership", "a")], [("m", "leadership", "b")], None, None, {"k": "removed", "m": "added"}, ["new_role", "removed_role"]),
        ([("k", "leadership", "a")], [], None, {"leadership": "failed"}, {"k": "stale"}, []),
        ([("k", "annual_accounts", "a", {"field": "revenue"})], [("k", "annual_accounts", "b", {"field": "revenue"})], None, None, {"k": "changed"}, ["changed_revenue"]),
        ([], [("k", "jobs", "a")], {"jobs": "blocked"}, None, {"k": "backfilled"}, []),
        ([], [("k", "company_profiles", "a")], None, None, {"k": "backfilled"}, []),
        ([], [("k", "jobs", "a", {"alias": "cl-1"})], None, None, {"k": "alias_added"}, []),
        ([("k", "official_website", "a")], [], None, None, {"k": "stale"}, []),
        ([("k", "official_website", "a", {"stale": True})], [], None, None, {"k": "removed"}, ["removed_website"]),
        ([("k", "company_profiles", "a", {"stale": True, "alias": "cl-1"})], [], None, None, {"k": "removed"}, ["removed_company_profile"]),
        ([("k", "jobs", "a", {"alias": "cl-1"})], [], None, None, {"k": "dropped"}, []),
        ([("k", "dated_activity", "a", {"field": "dated_news"})], [], None, None, {"k": "historical"}, []),
        ([("k", "filing_history", "a")], [], None, {"filing_history": "ambiguous"}, {"k": "stale"}, []),
        ([("k", "legal_identity", "a")], [], None, None, {"k": "stale"}, []),
    ],
)
def test_refresh_ladder(spark, before, after, p_state, c_state, actions, kinds):
    out = run(spark, before, after, p_state, c_state)
    assert {r["claim_key"]: r["action"] for r in out.actions.collect()} == actions
    assert sorted(r["change_type"] for r in out.changes.collect()) == kinds
    gone = {k for k, a in actions.items() if a in ("removed", "dropped")}
    assert {r["claim_key"] for r in out.claims.collect()} == set(actions) - gone


def test_log_and_materiality(spark):
    out = run(spark, [("k", "leadership", "a", {"role": "MEDL"})], [("k", "leadership", "b", {"role": "MEDL"}), ("n", "legal_identity", "c", {"field": "postal_address"})])
    assert {r["change_type"]: r["material"] for r in out.changes.collect()} == {"changed_leadership": False, "new_identity_fact": False}
    assert refresh.merge_log(out.changes, out.changes).count() == 2


def test_claims_and_states(spark):
    people = spark.createDataFrame([("1", "Acme", 0, False, None), ("2", "", None, None, 2.5)], "org string, legal_name string, registered_employees int, bankrupt boolean, share double")
    got = claims.identify(claims.unpivot(people, "org", {c: "legal_identity" for c in people.columns[1:]})).collect()
    assert {(r["org"], r["field"], r["value_json"]) for r in got} == {("1", "legal_name", '"Acme"'), ("1", "registered_employees", "0"), ("1", "bankrupt", "false"), ("2", "share", "2.5")}
    states = claims.finalize(people, claims.unpivot(people, "org", {"legal_name": "legal_identity"}), spark.createDataFrame([("2", "jobs", "blocked")], STATE))
    by = {(r["org"], r["family"]): r["state"] for r in states.collect()}
    assert (by["1", "legal_identity"], by["2", "jobs"], by["2", "leadership"], len(by)) == ("available", "blocked", "not_available", 22)
    assert {r["org"]: r["state"] for r in claims.overall(states).collect()} == {"1": "available", "2": "failed"}


def test_normalisers(spark):
    body = '{"organisasjonsnummer":"888567232","navn":"ACME AS","antallAnsatte":5,"harRegistrertAntallAnsatte":false,"epostadresse":"a@X.no","forretningsadresse":{"adresse":["Storgata 1"],"postnummer":"0155","poststed":"OSLO"}}'
    r = normalise.entity(spark.createDataFrame([(body,)], "body string")).first()
    assert (r["registered_employees"], r["business_address"], r["email_domain"], r["street"]) == (None, "Storgata 1, 0155 OSLO", "x.no", "Storgata")
    roles = '{"rollegrupper":[{"type":{"kode":"DAGL"},"sistEndret":"2024-01-01","roller":[{"type":{"kode":"DAGL","beskrivelse":"Daglig leder"},"person":{"navn":{"fornavn":"Tor","etternavn":"Aas"}}},{"type":{"kode":"REVI"},"enhet":{"navn":["BIG","AS"]},"fratraadt":true}]}]}'
    assert [(x["name"], x["inactive"]) for x in normalise.roles(spark.createDataFrame([("1", roles)], "org string, body string"), "org").collect()] == [("Tor Aas", False), ("BIG AS", True)]


def test_index_summary_and_language(spark):
    rows = [("1", 0, "legal_identity", "legal_name", '"ACME AS"', None), ("1", 1, "legal_identity", "legal_form", '"AS"', None), ("1", 2, "legal_identity", "municipality", '"OSLO"', None), ("1", 3, "legal_identity", "registered_employees", "12", None), ("1", 4, "annual_accounts", "revenue", '{"account_type": "SELSKAP", "amount": 1200000.0, "currency": "NOK"}', "2023-01-01..2023-12-31"), ("1", 5, "annual_accounts", "revenue", '{"account_type": "SELSKAP", "amount": 1000000.0, "currency": "NOK"}', "2022-01-01..2022-12-31"), ("1", 6, "annual_accounts", "annual_result", '{"account_type": "SELSKAP", "amount": -5000.0, "currency": "NOK"}', "2023-01-01..2023-12-31")]
    c = spark.createDataFrame(rows, "org string, pos int, family string, field string, value_json string, reporting_period string").withColumns({"claim_id": F.concat(F.lit("cl-"), "pos"), "alias_of": F.lit(None).cast("string"), "stale": F.lit(False)})
    i = index.company_index(c, spark.createDataFrame([("1", "jobs", "available")], STATE))
    r = i.first()
    assert (r["n"], r["f"], r["m"], r["e"], r["r"], r["r0"], r["p"], r["k"]) == ("ACME AS", "AS", "OSLO", 12, 1200000.0, 1000000.0, -5000.0, 7)
    said = summary.sentences(c)
    texts = [x["text"] for x in said.orderBy("pos").collect()]
    assert texts[0] == "ACME AS is a private limited company (AS), registered in Oslo." and "Revenue rose 20.0% from NOK 1.0 m in 2022 to NOK 1.2 m in 2023." in texts
    assert "Filed accounts for the period ending 2023-12-31 show revenue of NOK 1.2 m and a net loss of NOK 5 k." in texts
    p = ql.parse("Loss-making AS companies in Oslo with at least 10 staff, revenue over 1m, hiring", ["OSLO"], ["AS"])
    assert sorted(p.labels) == sorted(["loss-making", "in Oslo", "at least 10 employees", "revenue over NOK 1 m", "hiring signal", "legal form AS"]) and not p.text
    assert ql.select(i, p).count() == 1 and ql.select(i, ql.parse("companies with web traffic")).count() == 0
    assert ql.parse("web traffic").unsupported[0][0] == "web traffic" and ql.parse("in Atlantis").text == ["atlantis"]
    assert ql.route("Revenue and who is the CEO?") == ["finances", "people"]
    assert ql.answer(said, c, spark.createDataFrame([], STATE), "1", "what is the revenue")["sentences"]
    assert ql.answer(said, c, spark.createDataFrame([], STATE), "1", "owners")["unsupported"] == "owners"


def test_sources_sinks_metrics(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("orgnr\n888567232\n 888 567 232\n\nbad;x\n# no\n999999999,name\n")
    got = readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()
    assert sorted(r["org"] for r in got if r["org"]) == ["888567232", "999999999"] and [r["input"] for r in got if r["error"]] == ["bad"]
    (tmp_path / "ids.json").write_text('["888567232", "1"]')
    assert readers.read_ids(spark, str(tmp_path / "ids.json")).count() == 2
    assert value(spark, sinks.script_json(F.struct(F.lit("</script>").alias("a")))) == '{"a":"<\\/script>"}'
    q = metrics.index_quantiles(spark.createDataFrame([("a", float(x)) for x in range(10)], "k string, v double"), ["k"], "v").first()
    assert (q["p50"], q["p95"]) == (5.0, 9.0)
    env = spark.createDataFrame([("888567232", 1)], "org string, v int")
    sinks.write_run(env, str(tmp_path / "out"), "r1")
    with pytest.raises(Exception):
        sinks.write_run(env, str(tmp_path / "out"), "r1")
    assert sinks.merge_latest(env, env.withColumn("v", F.lit(2))).collect()[0]["v"] == 2


def test_stream_upsert_is_idempotent(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "uuid string, seq int, status string")
    folder = str(tmp_path / "in")
    rows(("a", 1, "ACTIVE"), ("b", 1, "ACTIVE")).coalesce(1).write.parquet(folder)
    feed = lambda: changelog.read_feed(spark, folder, rows(("a", 1, "x")).schema)
    for _ in range(2):  # a restart without new files changes nothing
        changelog.upsert(feed(), str(tmp_path / "state"), ["uuid"], ["seq"], str(tmp_path / "cp")).awaitTermination()
    rows(("a", 2, "INACTIVE")).coalesce(1).write.mode("append").parquet(folder)
    changelog.upsert(feed(), str(tmp_path / "state"), ["uuid"], ["seq"], str(tmp_path / "cp")).awaitTermination()
    last = changelog.read_state(spark, str(tmp_path / "state"), rows(("a", 1, "x")).schema)
    assert {r["uuid"]: r["status"] for r in last.collect()} == {"a": "INACTIVE", "b": "ACTIVE"}


def test_entry_contract():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and "snapshot_diff_counts" in names
