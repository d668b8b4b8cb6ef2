"""Source records (JSON bodies as text) to flat columns, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import tree, vocab
from claimloom.operators.claims import latest_per_key, top_per_key

ADDRESS = "struct<adresse:array<string>,postnummer:string,poststed:string,kommune:string,land:string>"
CODED = "struct<kode:string,beskrivelse:string>"
ENTITY = f"""struct<organisasjonsnummer:string,navn:string,organisasjonsform:{CODED},antallAnsatte:int,harRegistrertAntallAnsatte:boolean,
 forretningsadresse:{ADDRESS},postadresse:{ADDRESS},naeringskode1:{CODED},stiftelsesdato:string,registreringsdatoEnhetsregisteret:string,konkurs:boolean,
 underAvvikling:boolean,underTvangsavviklingEllerTvangsopplosning:boolean,registrertIMvaregisteret:boolean,hjemmeside:string,epostadresse:string,
 telefon:string,mobil:string,sisteInnsendteAarsregnskap:string,erIKonsern:boolean,aktivitet:array<string>,vedtektsfestetFormaal:array<string>,
 kapital:struct<belop:double,valuta:string>,historiskeNavn:array<struct<navn:string,fraDato:string,tilDato:string>>,naeringskode2:{CODED},naeringskode3:{CODED},
 registreringsdatoForetaksregisteret:string,overordnetEnhet:string,slettedato:string>"""
ACCOUNTS = """array<struct<regnskapsperiode:struct<fraDato:string,tilDato:string>,valuta:string,regnskapstype:string,
 resultatregnskapResultat:struct<driftsresultat:struct<driftsresultat:double,driftsinntekter:struct<sumDriftsinntekter:double>>,ordinaertResultatFoerSkattekostnad:double,aarsresultat:double>,
 eiendeler:struct<sumEiendeler:double>,egenkapitalGjeld:struct<egenkapital:struct<sumEgenkapital:double>,gjeldOversikt:struct<sumGjeld:double>>>>"""
ROLES = f"""struct<rollegrupper:array<struct<type:{CODED},sistEndret:string,roller:array<struct<type:{CODED},avregistrert:boolean,fratraadt:boolean,
 person:struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>>,enhet:struct<organisasjonsnummer:string,navn:array<string>>>>>>>"""
AD = """struct<uuid:string,ad_content:struct<uuid:string,title:string,jobtitle:string,published:string,expires:string,updated:string,applicationDue:string,engagementtype:string,
 extent:string,positioncount:string,employer:struct<name:string,orgnr:string,homepage:string>,workLocations:array<struct<city:string,municipal:string,county:string,postalCode:string,country:string>>>>"""


def address(a: Column) -> Column:
    """Lines, postal code and place, country; what is empty is left out."""
    place = F.nullif(F.trim(F.concat_ws(" ", a["postnummer"], a["poststed"])), F.lit(""))
    return F.nullif(F.concat_ws(", ", F.filter(a["adresse"], lambda x: x != ""), place, F.nullif(a["land"], F.lit(""))), F.lit(""))


def entity(raw: DataFrame, body: str = "body") -> DataFrame:
    e = F.from_json(body, ENTITY)
    phones = F.array_compact(F.array(e["telefon"], e["mobil"]))
    own = e["forretningsadresse"]
    day = lambda c: F.nullif(F.left(c, F.lit(10)), F.lit(""))
    former = lambda x: F.struct(day(x["fraDato"]).alias("from"), x["navn"].alias("name"), day(x["tilDato"]).alias("to"))
    return raw.select(
        "*", e["organisasjonsnummer"].alias("organisation_number"), e["navn"].alias("legal_name"), e["organisasjonsform"]["kode"].alias("legal_form"),
        F.when(e["harRegistrertAntallAnsatte"], e["antallAnsatte"]).alias("registered_employees"), address(own).alias("business_address"), address(e["postadresse"]).alias("postal_address"),
        own["kommune"].alias("municipality"), e["naeringskode1"].alias("industry"), e["stiftelsesdato"].alias("founded_date"), e["konkurs"].alias("bankrupt"),
        e["underAvvikling"].alias("under_liquidation"), e["underTvangsavviklingEllerTvangsopplosning"].alias("forced_dissolution"), e["registrertIMvaregisteret"].alias("vat_registered"),
        e["hjemmeside"].alias("registry_homepage"), F.lower(F.substring_index(e["epostadresse"], "@", -1)).alias("email_domain"), phones.alias("phones"), e["erIKonsern"].alias("in_group"),
        F.nullif(F.array_join(e["aktivitet"], " "), F.lit("")).alias("stated_activity"), F.nullif(F.array_join(e["vedtektsfestetFormaal"], " "), F.lit("")).alias("statutory_purpose"),
        e["organisasjonsform"]["beskrivelse"].alias("legal_form_label"), e["registreringsdatoEnhetsregisteret"].alias("registered_date"), e["registreringsdatoForetaksregisteret"].alias("business_register_date"),
        e["kapital"]["belop"].alias("share_capital"), F.transform(e["historiskeNavn"], former).alias("former_names"), F.array_compact(F.array(e["naeringskode2"], e["naeringskode3"])).alias("other_industries"),
        e["sisteInnsendteAarsregnskap"].alias("latest_submitted_accounts"), e["overordnetEnhet"].alias("parent_unit"), e["slettedato"].alias("deleted_date"), street(own).alias("street"), own["postnummer"].alias("postal_code"),
    )


def street(a: Column) -> Column:
    """The first line of an address up to its house number, if four letters or more."""
    s = F.trim(F.split(F.try_element_at(a["adresse"], F.lit(1)), r"\s+\d", 2)[0])
    return F.when(F.length(s) >= 4, s)


def accounts(raw: DataFrame, org: str, body: str = "body", most: int = 3) -> DataFrame:
    """The first records as given, a row each."""
    r = F.col("r")
    rows = raw.select(org, F.posexplode(F.slice(F.from_json(body, ACCOUNTS), 1, most)).alias("pos", "r"))
    result, debt = r["resultatregnskapResultat"], r["egenkapitalGjeld"]
    return rows.select(
        org, "pos", F.concat_ws("..", r["regnskapsperiode"]["fraDato"], r["regnskapsperiode"]["tilDato"]).alias("period"), r["valuta"].alias("currency"), r["regnskapstype"].alias("account_type"),
        result["driftsresultat"]["driftsinntekter"]["sumDriftsinntekter"].alias("revenue"), result["driftsresultat"]["driftsresultat"].alias("operating_result"),
        result["ordinaertResultatFoerSkattekostnad"].alias("profit_before_tax"), result["aarsresultat"].alias("annual_result"),
        r["eiendeler"]["sumEiendeler"].alias("assets"), debt["egenkapital"]["sumEgenkapital"].alias("equity"), debt["gjeldOversikt"]["sumGjeld"].alias("debt"),
    )


def roles(raw: DataFrame, org: str, body: str = "body") -> DataFrame:
    """A row per role with the name of its holder; inactive ones are marked."""
    rows = raw.select(org, F.explode(F.from_json(body, ROLES)["rollegrupper"]).alias("g")).select(org, "g", F.explode("g.roller").alias("x"))
    person = F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(F.col(f"x.person.navn.{k}")), F.lit("")) for k in ("fornavn", "mellomnavn", "etternavn")]), F.lit(""))
    return rows.select(
        org, F.coalesce(person, F.array_join("x.enhet.navn", " ")).alias("name"), F.col("x.enhet.organisasjonsnummer").alias("organisation_number"), F.col("x.type.kode").alias("role_code"),
        F.col("x.type.beskrivelse").alias("role"), F.col("g.type.kode").alias("group_code"), F.col("g.sistEndret").alias("group_last_changed"),
        (F.coalesce("x.avregistrert", F.lit(False)) | F.coalesce("x.fratraadt", F.lit(False))).alias("inactive"),
    )


def ads(raw: DataFrame, body: str = "body") -> DataFrame:
    """Job ads by an allow-list of fields: contacts are never projected."""
    a = F.from_json(body, AD)
    x = a["ad_content"]
    return raw.select(
        "*", F.coalesce(x["uuid"], a["uuid"]).alias("uuid"), x["title"].alias("title"), x["jobtitle"].alias("job_title"), x["published"].alias("published"), x["expires"].alias("expires"),
        x["updated"].alias("updated"), x["applicationDue"].alias("application_due"), x["engagementtype"].alias("engagement_type"), x["extent"].alias("extent"), x["positioncount"].alias("positions"),
        x["workLocations"].alias("work_locations"), x["employer"]["name"].alias("employer_name"), x["employer"]["orgnr"].alias("employer_orgnr"), x["employer"]["homepage"].alias("employer_homepage"),
    )


def filing_history(years: Column, files: Column) -> Column:
    """Distinct years ascending, files descending."""
    return F.struct(F.array_sort(F.array_distinct(F.filter(years, lambda y: y.rlike("^[0-9]+$")))).alias("years"), F.sort_array(files, asc=False).alias("files"))


def overlay(base: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Base rows with live values over them where there are any."""
    shared = [c for c in base.columns if c in live.columns and c != key]
    out = base.alias("b").join(live.alias("v"), key, "left")
    pick = lambda c: F.coalesce(F.when(F.col(f"v.{c}").cast("string") != "", F.col(f"v.{c}")), F.col(f"b.{c}")).alias(c) if c in shared else F.col(f"b.{c}")
    return out.select(key, *[pick(c) for c in base.columns if c != key])


def locations(raw: DataFrame, org: str, body: str = "body") -> DataFrame:
    """A row per registered workplace; the visiting address before the postal one."""
    unit = f"struct<organisasjonsnummer:string,navn:string,beliggenhetsadresse:{ADDRESS},postadresse:{ADDRESS},naeringskode1:{CODED},antallAnsatte:long>"
    rows = raw.select(org, F.posexplode(F.from_json(body, f"struct<_embedded:struct<underenheter:array<{unit}>>>")["_embedded"]["underenheter"]).alias("pos", "u"))
    place = F.coalesce("u.beliggenhetsadresse", "u.postadresse")
    return rows.select(
        org, "pos", F.col("u.organisasjonsnummer").alias("organisation_number"), F.col("u.navn").alias("name"), address(place).alias("address"), place["kommune"].alias("municipality"),
        F.col("u.naeringskode1.beskrivelse").alias("industry"), F.col("u.antallAnsatte").alias("registered_employees"),
    )


def group_links(raw: DataFrame, org: str, body: str = "body", most: int = 200) -> DataFrame:
    """Parents and subsidiaries of each company in its group's tree, at any depth; of links named twice the last counts."""
    node = "struct<organisasjonsnummer:string,navn:string,parentOrganisasjonsnummer:string,parentNavn:string,grunnlag:string,knytningsform:struct<beskrivelse:string>,dato:string>"
    rows = raw.select(F.col(org).alias("org"), F.posexplode(tree.objects_with(F.col(body), "parentOrganisasjonsnummer")).alias("pos", "j")).withColumn("e", F.from_json("j", node))
    child, parent = F.col("e.organisasjonsnummer"), F.col("e.parentOrganisasjonsnummer")
    rows = rows.filter((child != "") & (parent != "") & ((child == F.col("org")) | (parent == F.col("org"))))
    up = child == F.col("org")
    links = rows.select(
        "org", "pos", F.when(up, "parent").otherwise("subsidiary").alias("relation"), F.when(up, parent).otherwise(child).alias("organisation_number"),
        F.when(up, F.col("e.parentNavn")).otherwise(F.col("e.navn")).alias("name"), F.col("e.grunnlag").alias("ownership_basis"), F.col("e.knytningsform.beskrivelse").alias("link_type"), F.col("e.dato").alias("as_of"),
    )
    links = latest_per_key(links, ["org", "relation", "organisation_number"], ["pos"]).drop("pos")
    return top_per_key(links, ["org"], [F.col("relation"), F.col("organisation_number")], most)


def role_events(raw: DataFrame, org: str, body: str = "body") -> DataFrame:
    """The distinct dates, ascending, on which a company's roles were updated."""
    times = F.filter(F.from_json(body, "array<struct<time:string>>"), lambda e: F.coalesce(e["time"], F.lit("")) != "")
    dates = F.array_sort(F.array_distinct(F.transform(times, lambda e: F.left(e["time"], F.lit(10)))))
    return raw.select(org, F.coalesce(dates, F.array().cast("array<string>")).alias("role_change_dates"))


def accounting_obligation(legal_form: Column, latest_accounts: Column) -> Column:
    """Which rule on annual accounts applies; a form that the rule does not settle is left to review."""
    form = F.upper(F.coalesce(legal_form, F.lit("")))
    return (
        F.when(F.coalesce(latest_accounts, F.lit("")) != "", "filing_observed").when(form.isin(*vocab.ALWAYS_OBLIGED_FORMS), "required_by_legal_form")
        .when(form.isin(*vocab.THRESHOLD_FORMS), "threshold_or_activity_dependent").otherwise("special_rule_or_review_required")
    )
