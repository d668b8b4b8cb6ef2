"""URL filters, in DataFrame operations only.

Rules on host and path come first, the longest that fits wins. What no rule covers is judged by a list of canonical URLs: a
blocked Bloom filter of the listed passes possible hits on to an exact hash join with the list, which removes its false
positives; the rest of the pages never meets the list. A block is one 64-bit word in which a URL sets PROBES bits.
The filter grows with the list, so the share that it passes does not; up to MAX_BLOCKS blocks (16 MB as a table) it is broadcast,
beyond that its blocks are dealt out by their number and the slim rows of pages go to them.

Defined cases: a null URL and one without "://" have empty host and path, no rule fits, and it is allowed; duplicates in
the list count once, nulls in it are ignored; repeated rows are judged one by one; an empty list blocks nothing; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import bloom_blocks, may_hold, materialise

#: (verdict, host, path), matched on the host and its subdomains and on the beginning of the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL, as written otherwise; both empty without a host part."""
    c = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    part = lambda k: F.regexp_extract(c, r"(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def canonical(host: Column, path: Column) -> Column:
    """The form of a URL in which it is listed: no scheme, query or fragment, no leading www. or m., no page suffix."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?<!/)(?:/|\.html?)++$", ""))


def verdict_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null without any."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, possible (passed the filter). listed: one column of canonical URLs."""
    listed = materialise(listed.toDF("listed").filter("listed is not null").distinct())
    n = listed.count()
    host, path = host_path(url_col)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rule, verdict = verdict_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_verdict"), F.when(F.col("host") != "", canonical(F.col("host"), F.col("path"))).alias("_url"))
    asked = F.when(F.col("rule").isNull(), F.col("_url"))
    rows = may_hold(rows, asked, listed, bloom_blocks(n), "possible")
    # only possible hits go through the exact join; the others, a third of which may be one host, are not shuffled
    passed = rows.filter("possible").join(listed, F.col("_url") == F.col("listed"), "left").withColumn("_listed", F.col("listed").isNotNull()).drop("listed")
    rest = rows.filter("not possible").withColumn("_listed", F.lit(False))
    both = passed.unionByName(rest)
    return both.select(id_col, "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"), "possible")
