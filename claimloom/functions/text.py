"""Text expressions: names as tokens, folding, clipping, amounts. All stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimloom.functions import vocab

def _plain() -> tuple[dict[str, str], dict[str, str]]:
    """What characters beyond ASCII are without marks (compatibility decomposition): one character for one, and several for one."""
    one, many = {"ø": "o", "Ø": "O", "å": "a", "Å": "A"}, {"æ": "ae", "Æ": "AE"}
    for c in map(chr, range(0x80, 0x20000)):
        if c not in one and c not in many and not 0xD800 <= ord(c) < 0xE000:
            seen = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if seen:
                (one if len(seen) == 1 else many)[c] = seen
    return one, many


_ONE, _MANY = _plain()


def _ranges(chars) -> str:
    """A character class of ranges: its members are tried one after the other, at every place of a text."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


_RARE = _ranges(_MANY)


def bound(values: dict[str, Column], body) -> Column:
    """body(row) with the values computed once each, however often body reads them."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), 1)


def fold(c: Column) -> Column:
    """Letters without marks, in lower case; æ is ae, and what has no plain form goes."""
    # the few characters that stand for several are looked up one by one, and only in texts that hold any
    table = F.str_to_map(F.lit("\x1e".join(map("\x1f".join, _MANY.items()))), F.lit("\x1e"), F.lit("\x1f"))

    beyond = lambda c: F.octet_length(c) > F.char_length(c)

    def spelt(b):
        # what is left beyond ASCII when single letters are done is little, so the class of rare ones meets little text
        rare = F.regexp_replace(b["c"], r"[\x00-\x7F]+", "").rlike(_RARE)
        told = F.array_join(F.transform(F.split(b["c"], ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
        return F.lower(F.when(beyond(b["c"]), F.regexp_replace(F.when(rare, told).otherwise(b["c"]), r"[^\x00-\x7F]+", "")).otherwise(b["c"]))

    single = lambda b: F.when(beyond(b["c"]), F.translate(b["c"], "".join(_ONE), "".join(_ONE.values()))).otherwise(b["c"])
    return bound({"c": bound({"c": F.coalesce(c, F.lit(""))}, single)}, spelt)


def words(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def _name_words(found: Column) -> Column:
    return F.filter(found, lambda t: ~t.isin(*vocab.NAME_STOP) & (F.length(t) > 1))


def name_tokens(c: Column) -> Column:
    """Distinctive words of a legal name: without legal forms and single letters."""
    return _name_words(words(c))


def distinct_name_tokens(folded: Column) -> Column:
    """The words that name_tokens() gives, once each, of a text that is folded already."""
    return _name_words(F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]+"), F.lit(0))))


def ad_tokens(c: Column) -> Column:
    """Words of an employer's name in an ad: single letters stay."""
    return F.filter(words(c), lambda t: ~t.isin(*vocab.AD_STOP))


def search_tokens(c: Column) -> Column:
    return F.filter(words(c), lambda t: F.length(t) > 1)


def name_key(c: Column) -> Column:
    return F.array_join(name_tokens(c), " ")


def compact_name(c: Column) -> Column:
    """A name as a domain would spell it: single letters stay, legal and country words go."""
    return F.array_join(F.filter(words(c), lambda t: ~t.isin(*vocab.NAME_STOP, *vocab.COUNTRY)), "")


def merge_initials(tokens: Column) -> Column:
    """Runs of single letters become one word."""
    return F.split(F.regexp_replace(F.array_join(tokens, " "), r"(?<=\b[a-z]) (?=[a-z]\b)", ""), " ")


def distinctive(tokens: Column) -> Column:
    """Whether the words hold one of five letters or more that is neither generic nor a number."""
    return F.exists(tokens, lambda t: (F.length(t) >= 5) & ~t.isin(*vocab.AD_GENERIC) & ~t.rlike("^[0-9]+$"))


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def clip(c: Column, n: int = 300) -> Column:
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n - 1)), F.lit("…")))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def numbers(*parts: Column) -> Column:
    """The digits of texts, a letter between those that letters or different texts part: figures of two words are no number."""
    return F.regexp_replace(F.regexp_replace(F.array_join(F.array_compact(F.array(*parts)), "x"), r"\p{L}", "x"), "[^0-9x]", "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals; ties of the number as it is held go to the even digit."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def amount_text(amount: Column, currency: Column | None = None) -> Column:
    """NOK 1.2 m and the like."""
    a = F.abs(amount)
    text = F.when(a >= 1e9, F.concat(fixed(a / 1e9, 1), F.lit(" bn"))).when(a >= 1e6, F.concat(fixed(a / 1e6, 1), F.lit(" m"))).when(a >= 1e3, F.concat(fixed(a / 1e3, 0), F.lit(" k"))).otherwise(fixed(a, 0))
    return F.concat(F.coalesce(currency, F.lit("NOK")) if currency is not None else F.lit("NOK"), F.lit(" "), F.when(amount < 0, "-").otherwise(""), text)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first letter."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(?s)\p{L}+|\P{L}+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def iso_date(c: Column, as_of: Column) -> Column:
    """The first yyyy-mm-dd in a text if it is a date no later than a day after as_of, else null."""
    d = F.try_to_date(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    return F.when(d <= F.date_add(as_of, 1), F.date_format(d, "yyyy-MM-dd"))


def rfc822_date(c: Column, as_of: Column) -> Column:
    """Date of an RSS pubDate; the weekday is dropped before parsing."""
    d = F.try_to_date(F.left(rfc822_time(c), F.lit(10)), "yyyy-MM-dd")
    return F.when(d <= F.date_add(as_of, 1), F.date_format(d, "yyyy-MM-dd"))


def rfc822_time(c: Column) -> Column:
    """An RSS pubDate as an ISO timestamp, in the zone it is written in."""
    body = F.regexp_replace(c, r"^\s*[A-Za-z]{3},\s*", "")
    zone = F.regexp_extract(body, r"([+-]\d{2}):?(\d{2})\s*$", 1)
    minutes = F.regexp_extract(body, r"([+-]\d{2}):?(\d{2})\s*$", 2)
    local = F.try_to_timestamp(F.regexp_replace(body, r"\s*(?:[+-]\d{2}:?\d{2}|GMT|UTC|UT|Z)\s*$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(zone == "", "+00:00").otherwise(F.concat(zone, F.lit(":"), minutes)))


def published_at(c: Column, as_of: Column) -> Column:
    """A timestamp exactly as written, if it states a time of day and a date that counts."""
    t = F.trim(c)
    return F.when(t.rlike(r"^20\d{2}-\d{2}-\d{2}[T ]\d{2}:\d{2}") & iso_date(t, as_of).isNotNull(), t)


def person(parts: Column) -> Column:
    """A name as a key: its parts joined, in lower case."""
    return F.lower(F.array_join(parts, " "))
