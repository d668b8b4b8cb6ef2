"""Questions over the company index: a phrase becomes named predicates, and a DataFrame.

parse() is plain Python on one question; select() builds one filter that Catalyst plans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mill": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
#: English industry words and what the register's industry texts hold (parameter).
INDUSTRIES = {"construction": ("bygg", "anlegg"), "real estate": ("eiendom",), "restaurant": ("restaurant", "servering"), "software": ("programvare", "programmering"), "fishing": ("fiske",), "transport": ("transport",), "retail": ("butikkhandel", "detaljhandel")}
REFUSED = {
    "customer reviews": "reviews are not published by any checked source", "reviews": "reviews are not published by any checked source", "web traffic": "traffic is not measured", "traffic": "traffic is not measured",
    "glassdoor": "no employer ratings are read", "sentiment": "no sentiment is judged", "followers": "follower counts are not read", "best": "nothing says which is best", "owners": "owners are not in the sources",
}
PLATFORMS = ("linkedin", "facebook", "instagram", "youtube", "tiktok")
FILLER = {"companies", "company", "firms", "firm", "with", "and", "the", "a", "an", "that", "are", "is", "have", "has", "show", "me", "find", "list", "all", "of", "which", "in", "on", "by", "who", "do", "any"}
TOPICS = {
    "people": ("ceo", "chair", "board", "who", "leader", "manager", "auditor", "people", "role"), "finances": ("revenue", "profit", "result", "equity", "turnover", "account", "financ", "loss"),
    "places": ("where", "address", "location", "office", "workplace"), "hiring": ("hiring", "job", "vacanc"), "web": ("website", "linkedin", "social", "profile", "news"),
    "changes": ("change", "new since"), "group": ("parent", "subsidiar", "group"), "business": ("what does", "industry", "activity", "business"),
}
TOPIC_ORDER = ("finances", "people", "places", "hiring", "web", "changes", "group", "business")


@dataclass
class Parsed:
    filters: list[tuple[str, Column]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    unsupported: list[tuple[str, str]] = field(default_factory=list)
    top: tuple[int, str] | None = None

    @property
    def labels(self) -> list[str]:
        return [label for label, _ in self.filters]


def _number(digits: str, unit: str | None) -> float:
    return float(digits.replace(",", "").replace(" ", "")) * UNITS.get((unit or "").lower(), 1)


def parse(question: str, municipalities=(), forms=()) -> Parsed:
    """municipalities, forms: those in the data; other places stay free text."""
    out, rest = Parsed(), f" {question.lower()} "

    def take(pattern: str, make) -> None:
        nonlocal rest
        while m := re.search(pattern, rest):
            if not make(m):
                break
            rest = f"{rest[: m.start()]} {rest[m.end() :]}"

    def add(label: str, condition: Column) -> bool:
        out.filters.append((label, condition))
        return True

    for term in sorted(REFUSED, key=len, reverse=True):  # the more specific of overlapping ones
        take(rf"\b{term}\b", lambda m, t=term: out.unsupported.append((t, REFUSED[t])) or True)

    def top(m) -> bool:
        out.top = (int(m[1]), {"revenue": "r", "turnover": "r", "result": "p", "profit": "p", "employees": "e"}[m[2]])
        return True

    take(r"\btop (\d+)(?: companies)? by (revenue|turnover|result|profit|employees)\b", top)
    take(r"\b(?:growing revenue|revenue growth|growing)\b", lambda m: add("revenue up on the year before", F.col("r") > F.col("r0")))
    take(r"\bprofitable\b", lambda m: add("profitable", F.col("p") > 0))
    take(r"\bloss[- ]making\b", lambda m: add("loss-making", F.col("p") < 0))
    size = r"(?:nok\s*)?(\d[\d, ]*(?:\.\d+)?)\s*(k|m|mill|million|bn|billion|thousand)?\b"
    more, less = r"(?:over|above|more than)", r"(?:under|below|less than)"

    def revenue(sign: str):
        def make(m) -> bool:
            x = _number(m[1], m[2])
            shown = f"{x / 1e9:g} bn" if x >= 1e9 else f"{x / 1e6:g} m" if x >= 1e6 else f"{x / 1e3:g} k"
            return add(f"revenue {sign} NOK {shown}", F.col("r") > x if sign == "over" else F.col("r") < x)

        return make

    take(rf"\b(?:revenue|turnover) (?:of )?{more} {size}", revenue("over"))
    take(rf"\b(?:revenue|turnover) (?:of )?{less} {size}", revenue("under"))
    people = r"(\d+)\s*(?:employees|staff|people)"
    take(rf"\b(?:more than|over) {people}\b", lambda m: add(f"more than {m[1]} employees", F.col("e") > int(m[1])))
    take(rf"\bat least {people}\b", lambda m: add(f"at least {m[1]} employees", F.col("e") >= int(m[1])))
    take(r"\b(\d+)\+\s*(?:employees|staff|people)\b", lambda m: add(f"at least {m[1]} employees", F.col("e") >= int(m[1])))
    take(rf"\b(?:fewer than|less than|under) {people}\b", lambda m: add(f"fewer than {m[1]} employees", F.col("e") < int(m[1])))
    take(r"\bfounded (after|before) (\d{4})\b", lambda m: add(f"founded {m[1]} {m[2]}", F.col("fy") > int(m[2]) if m[1] == "after" else F.col("fy") < int(m[2])))
    take(r"\b(?:with|have|has) (?:a )?(?:verified )?website\b", lambda m: add("verified website", F.col("w").isNotNull()))
    take(r"\b(?:that are )?hiring\b", lambda m: add("hiring signal", (F.col("j") > 0) | F.coalesce(F.col("a")["jobs"] == "available", F.lit(False))))
    take(r"\b(?:with|has|have) news\b", lambda m: add("news on its website", F.col("y") > 0))
    for p in PLATFORMS:
        take(rf"\b(?:on|with) {p}\b", lambda m, p=p: add(f"{p.replace('linkedin', 'LinkedIn') if p == 'linkedin' else p.capitalize()} profile", F.array_contains("sp", p)))
    for name in sorted(municipalities, key=len, reverse=True):
        take(rf"\bin {re.escape(name.lower())}\b", lambda m, n=name: add(f"in {n.title()}", F.upper("m") == n.upper()))
    for word, terms in INDUSTRIES.items():
        take(rf"\b{word}\b", lambda m, w=word, ts=terms: add(f"industry: {w}", reduce(lambda a, b: a | b, (F.contains(F.lower("i"), F.lit(t)) for t in ts))))
    for form in forms:
        take(rf"\b{form.lower()} (?:companies|company|firms)\b", lambda m, f=form: add(f"legal form {f}", F.col("f") == f))
    out.text = [w for w in re.findall(r"[\wæøå]+", rest) if w not in FILLER]
    return out


def select(index: DataFrame, parsed: Parsed) -> DataFrame:
    """Rows that fit all predicates and words; none while a term is refused."""
    if parsed.unsupported:
        return index.filter(F.lit(False))
    seen = F.lower(F.concat_ws(" ", "n", "m", "i", "o"))
    conditions = [c for _, c in parsed.filters] + [F.contains(seen, F.lit(w)) for w in parsed.text]
    out = index.filter(reduce(lambda a, b: a & b, conditions)) if conditions else index
    if parsed.top:
        n, key = parsed.top
        return out.filter(F.col(key).isNotNull()).orderBy(F.col(key).desc(), "o").limit(n)
    return out


def without_unsupported(question: str) -> str:
    for term in sorted(REFUSED, key=len, reverse=True):
        question = re.sub(rf"\b{term}\b", " ", question, flags=re.I)
    return " ".join(question.split())


def context(index: DataFrame) -> dict[str, list[str]]:
    """Places and legal forms in the data (registers of a few hundred names)."""
    row = index.agg(F.collect_set("m").alias("m"), F.collect_set("f").alias("f")).first()
    return {"municipalities": sorted(row["m"]), "forms": sorted(row["f"])}


def route(question: str) -> list[str]:
    """Topics of a question about one company, in fixed order."""
    q = question.lower()
    return [t for t in TOPIC_ORDER if any(w in q for w in TOPICS[t])]


def answer(found: DataFrame, claims: DataFrame, states: DataFrame, org: str, question: str) -> dict:
    """Sentences, unknown families and matching claims for a question about one company (tens of rows)."""
    for term in sorted(REFUSED, key=len, reverse=True):
        if re.search(rf"\b{term}\b", question.lower()):
            return {"unsupported": term, "reason": REFUSED[term]}
    topics = route(question)
    section = {"finances": ("finances",), "people": ("people",), "places": ("people", "identity"), "hiring": ("presence",), "web": ("presence",), "group": ("identity",), "business": ("business",), "changes": ()}
    wanted = sorted({s for t in topics for s in section[t]})
    if wanted:
        rows = found.filter((F.col("org") == org) & F.col("section").isin(*wanted)).orderBy("pos").collect()
        if rows:
            return {"topics": topics, "sentences": [(r["text"], r["claim_ids"]) for r in rows]}
        family = {"finances": "annual_accounts", "people": "leadership", "places": "registered_workplaces", "hiring": "jobs", "web": "official_website", "group": "group_relationships", "business": "legal_identity"}[topics[0]]
        state = states.filter((F.col("org") == org) & (F.col("family") == family)).first()
        return {"topics": topics, "unknown": {"family": family, "state": state["state"] if state else "not_available"}}
    words = [w for w in re.findall(r"[\wæøå]+", question.lower()) if w not in FILLER]
    rows = claims.filter((F.col("org") == org) & reduce(lambda a, b: a & b, [F.contains(F.lower("value_json"), F.lit(w)) for w in words], F.lit(bool(words)))).select("claim_id").collect()
    return {"matches": [r["claim_id"] for r in rows]} if rows else {"empty": True}
