"""Language identification by Bayesian fusion of evidence.

1. Text: byte trigrams of the visible text, hashed to FEATURES cells; a naive Bayes table is counted over all training
   texts by grouped aggregation. The mean log likelihood of a text is weighed by at most EFFECTIVE trigrams, as trigrams
   of a text are far from independent. This alone gives a first posterior.
2. Declared markup language and address suffix (last label of the host): P(value | language), from the sums of first
   posteriors by value, smoothed.
3. Host prior, hierarchically smoothed: the host's sums of first posteriors lean on its registered domain's, those on the
   whole table's. A page's own posterior is taken out of its host's sums, so it never votes for itself.

The fused posterior is proportional to text x declared x suffix x host prior.

Defined cases: null or empty text has no text likelihood (it is flat) and is judged by the rest; a missing declaration,
suffix or host is evidence for nothing; a declaration is cut to its primary subtag in lower case; repeated rows are rows of
their own; an empty table gives no rows; other columns are left out. Without training texts there are no languages and
lang is null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialise

FEATURES = 1 << 15
EFFECTIVE = 40.0
#: Pseudo-counts: of a value given a language, of a host leaning on its domain, of a domain leaning on all.
VALUE_PRIOR, HOST_PRIOR, DOMAIN_PRIOR = 1.0, 5.0, 20.0
#: Languages that a model may have: its table is on the driver and every executor (128 kB a language).
MAX_LANGUAGES = 512
#: Bytes of a text that are looked at in one piece.
PIECE = 1 << 20

_SILENT = re.compile(rb"<(script|style|head)\b")
_ENTITY = re.compile(rb"&[#\w]+;")
#: Digits and ASCII marks say nothing about a language: they count as blanks.
_FOLD = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b + 32 if b < 91 else b for b in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed trigrams of a text, blanks squeezed."""
    words = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    out = np.zeros(FEATURES)
    for at in range(0, max(1, len(words) - 2), PIECE):
        b = np.frombuffer(words[at : at + PIECE + 2], np.uint8).astype(np.int64)
        if len(b) > 2:
            out += np.bincount((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 2_654_435_761 % 4_294_967_291 % FEATURES, minlength=FEATURES)
    return out


def visible(html: str) -> bytes:
    """The text of a page, without its scripts, styles, head, comments, tags and entities. One scan forward: an end that
    was not found once is not looked for again. What is not closed counts as a plain tag, a lone < as text."""
    raw = html.encode("utf-8", "replace")
    low, out, at, missing = raw.lower(), [], 0, set()
    while (start := raw.find(b"<", at)) >= 0:
        out.append(raw[at:start])
        silent = _SILENT.match(low, start)
        stop = -1
        for mark in ([b"</" + silent[1]] if silent else [b"-->"] if low.startswith(b"<!--", start) else []) + [b">"]:
            if mark not in missing:
                if (found := low.find(mark, start)) >= 0:
                    stop = found + len(mark)
                    if mark[:2] == b"</":
                        stop = low.find(b">", stop) + 1 or len(low)
                    break
                missing.add(mark)
        if stop < 0:
            out.append(raw[start:])
            at = len(raw)
            break
        at = stop
    return _ENTITY.sub(b" ", b" ".join([*out, raw[at:]]))


def train(texts: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, cell, n over all texts with a language, pre-aggregated by partition; at most languages x FEATURES rows."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                got = trigrams((text.as_py() or "").encode())
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, counts in sums.items():
            cells = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(counts[cells].astype(np.int64))], ["lang", "cell", "n"])

    labelled = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null")
    return labelled.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def load(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log P(cell | language). The table has at most languages x FEATURES rows, whatever was counted."""
    counts = materialise(counts)
    if (n := counts.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages: at most {MAX_LANGUAGES} fit the model")
    rows = counts.toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), FEATURES), 0.5)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[k, own["cell"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)) if langs else table


def likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows (last columns: _text, _markup boolean) with _ll: the weighed log likelihood by language."""
    langs, table = model
    handle = rows.sparkSession.sparkContext.broadcast(table.astype(np.float32).T.copy())
    keep = [c for c in rows.columns if c not in ("_text", "_markup")]
    schema = rows.select(*keep).withColumn("_ll", F.array().cast("array<double>")).schema

    def run(batches):
        weights = handle.value
        for b in batches:
            out = []
            for text, markup in zip(b.column("_text"), b.column("_markup").to_pylist()):
                raw = text.as_py() or ""
                counts = trigrams(visible(raw) if markup else raw.encode())
                cells = np.flatnonzero(counts)
                n = counts.sum()
                out.append((counts[cells] @ weights[cells] * (min(n, EFFECTIVE) / n)).tolist() if n else [0.0] * len(langs))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))], [*keep, "_ll"])

    return rows.mapInArrow(run, schema)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def host_of(url: str) -> Column:
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows: _text, _markup, _declared, _suffix, _host, _domain and any others, which are kept. Adds lang, confidence,
    posterior (map), text_lang and evidence counts."""
    langs, _ = model
    keep = [c for c in rows.columns if c not in ("_text", "_markup")]
    if not langs:
        empty = rows.select(*[c for c in keep if c[0] != "_"])
        return empty.select("*", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text_lang"), F.create_map().cast("map<string,double>").alias("posterior"))
    first = materialise(likelihoods(rows, model).withColumn("_p", softmax(F.col("_ll"))))
    parts = [F.element_at("_p", k + 1) for k in range(len(langs))]
    sums = lambda prefix: [F.sum(p).alias(f"{prefix}{k}") for k, p in enumerate(parts)]
    vector = lambda prefix: F.array(*[F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) for k in range(len(langs))])
    totals = lambda df, prefix: [float(x or 0) for x in df.agg(*[F.sum(f"{prefix}{k}") for k in range(len(langs))]).first()]

    def value_table(column: str, out: str) -> DataFrame:
        """P(value | language) of each value: one row per value."""
        seen = materialise(first.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums("_v")))
        total, values = totals(seen, "_v"), seen.count()
        shares = [F.log((F.col(f"_v{k}") + VALUE_PRIOR) / F.lit(t + VALUE_PRIOR * (values + 1))) for k, t in enumerate(total)]
        return seen.select(column, F.array(*shares).alias(out))

    hosts = first.filter(F.col("_host").isNotNull()).groupBy("_host", "_domain").agg(*sums("_h"))
    domains = hosts.groupBy("_domain").agg(*[F.sum(f"_h{k}").alias(f"_d{k}") for k in range(len(langs))])
    hosts = hosts.join(domains, hosts["_domain"].eqNullSafe(domains["_domain"]))
    # as a table: a join of two scans can be split where one host holds a third of the rows
    hosts = materialise(hosts.select("_host", vector("_h").alias("_hosts"), vector("_d").alias("_domains")))
    out = first.join(value_table("_declared", "_by_declared"), "_declared", "left").join(value_table("_suffix", "_by_suffix"), "_suffix", "left")
    whole = totals(first.select(*[p.alias(f"_a{k}") for k, p in enumerate(parts)]), "_a")
    out = out.join(hosts, "_host", "left").withColumn("_all", F.array(*map(F.lit, whole)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    flat = F.array(*[F.lit(0.0)] * len(langs))
    # without the row's own posterior; sums of doubles may miss zero by a little
    others = lambda c: F.zip_with(F.coalesce(F.col(c), F.col("_p")), "_p", lambda a, x: F.greatest(a - x, F.lit(0.0)))
    out = out.withColumn("_o", others("_all")).withColumn("_g", F.transform("_o", lambda x: (x + 1.0) / (total(F.col("_o")) + len(langs))))
    out = out.withColumn("_o", others("_domains")).withColumn("_d", F.zip_with("_o", "_g", lambda x, p: (x + DOMAIN_PRIOR * p) / (total(F.col("_o")) + DOMAIN_PRIOR)))
    out = out.withColumn("_o", others("_hosts")).withColumn("_prior", F.zip_with("_o", "_d", lambda x, p: (x + HOST_PRIOR * p) / (total(F.col("_o")) + HOST_PRIOR)))
    score = F.transform(F.sequence(F.lit(1), F.lit(len(langs))), lambda k: F.element_at("_ll", k) + F.log(F.element_at("_prior", k)) + F.element_at(F.coalesce("_by_declared", flat), k) + F.element_at(F.coalesce("_by_suffix", flat), k))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    out = out.withColumn("_score", score).withColumn("_fused", softmax(F.col("_score")))
    kept = [c for c in keep if c[0] != "_"]
    return out.select(
        *kept, best("_fused").alias("lang"), F.array_max("_fused").alias("confidence"), best("_p").alias("text_lang"),
        F.map_from_arrays(names, "_fused").alias("posterior"), F.col("_declared").alias("declared"), F.col("_suffix").alias("suffix"), F.col("_host").alias("host"),
    )


def evidence(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> the columns that identify() takes."""
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]{0,400}?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))
    host = host_of("url")
    labels = F.split(host, r"\.")
    return pages.select(
        "page_id", F.col("html").alias("_text"), F.lit(True).alias("_markup"), F.when(declared != "", declared).alias("_declared"),
        F.element_at(labels, -1).alias("_suffix"), host.alias("_host"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("_domain"),
    )
