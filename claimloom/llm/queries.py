"""The registered query of each operator: its intended table, whole, with production parameters."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import ann, chat, langid, linededup, media, mixing, packing, repair, simhash, tokencount, toxicity, tries, urlfilter
from claimloom.llm.common import table
from claimloom.llm.oracles import OP12_TRIES, OP13_REPAIR


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.read_back(chat.format_turns(turns))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.documents_as_media(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by all evidence, and all documents, which have no address or markup: their source is the host."""
    docs = table(spark, sf_dir, "documents")
    model = langid.load(langid.train(docs))
    pages = langid.evidence(table(spark, sf_dir, "pages")).select(F.lit("pages").alias("origin"), F.col("page_id").alias("doc_id"), "_text", "_markup", "_declared", "_suffix", "_host", "_domain")
    none = F.lit(None).cast("string")
    texts = docs.select(F.lit("documents").alias("origin"), "doc_id", F.col("text").alias("_text"), F.lit(False).alias("_markup"), none.alias("_declared"), none.alias("_suffix"), F.concat(F.lit("source:"), "source").alias("_host"), F.lit("source:").alias("_domain"))
    found = langid.identify(texts.unionByName(pages), model)
    return found.select("origin", "doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "host")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.size("_runs").alias("n_runs"), F.col("_runs").alias("runs"), F.length("text").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


#: The list of the URL query: the numbered pages of the sections of sites that are known for spam. Nothing of it comes from pages.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_UNDER, LISTED_ENDS, LISTED_SECTIONS, LISTED_LAST = ("", "blog."), ("com", "net", "org"), ("de", "en", "es", "fr"), 2499


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list, as canonical URLs."""
    parts = [[F.lit(x) for x in xs] for xs in (LISTED_UNDER, LISTED_SITES, LISTED_ENDS, LISTED_SECTIONS)]
    sections = [F.concat(a, b, F.lit(".example."), c, F.lit("/"), d, F.lit("/")) for a, b, c, d in product(*parts)]
    return spark.range(LISTED_LAST + 1).select("id", F.explode(F.array(*sections)).alias("section")).select(F.concat("section", F.col("id").cast("string")).alias("url"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against rules and a list of its own, whose size does not follow the pages."""
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed_urls(spark)).drop("possible")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.report(table(spark, sf_dir, "documents"))


def op12_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(*tries.rebuilt(table(spark, sf_dir, "conversations")))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(turns), turns)


QUERIES = {f.__name__: f for f in (op1_mix, op2_chat, op3_media, op4_ann, op5_langid, op6_toxicity, op7_linededup, op8_packing, op9_simhash, op10_urls, op11_tokens, op12_tries, op13_repair)}

_RULES = " UNION ALL ".join(f"SELECT '{w}' AS verdict, '{h}' AS h, '{p}' AS p" for w, h, p in urlfilter.RULES)

ORACLES = {
    "op12_tries": OP12_TRIES,
    "op13_repair": OP13_REPAIR,
    "op10_urls": rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
forms AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/|\.html?)+$', '') END AS canon FROM parts),
listed AS (
  SELECT u || s || '.example.' || e || '/' || d || '/' || n AS canon
  FROM (SELECT unnest({[*LISTED_UNDER]}) AS u), (SELECT unnest({[*LISTED_SITES]}) AS s), (SELECT unnest({[*LISTED_ENDS]}) AS e),
       (SELECT unnest({[*LISTED_SECTIONS]}) AS d), (SELECT unnest(range({LISTED_LAST + 1})) AS n)),
rules AS ({_RULES}),
fits AS (
  SELECT f.page_id, f.host, f.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY f.page_id ORDER BY length(r.h || r.p) DESC) AS k
  FROM forms f JOIN rules r ON (f.host = r.h OR ends_with(f.host, '.' || r.h)) AND starts_with(f.path, r.p))
SELECT f.page_id, f.host, f.path, x.rule, coalesce(x.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM forms f LEFT JOIN fits x ON x.page_id = f.page_id AND x.k = 1 LEFT JOIN listed l ON l.canon = f.canon""",
}
