"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two are linked at RADIUS = 2 or fewer differing bits. Every distinct fingerprint emits all
variants within half the radius: itself and its 64 neighbours at one bit. Two fingerprints are linked exactly if they have
a variant in common. The shuffle on variants is a sum of bit masks (which bit of the variant gives the fingerprint), so
a bucket is two numbers however many copies there are; it has at most 65 fingerprints, which are read off the mask,
deduplicated and verified. Links go to the least fingerprint of a bucket, which keeps everything connected.

Components are found by alternating large-star and small-star rounds on tables in the shared folder; nothing of them is
collected. Fingerprints stand for all their documents, so hot groups of copies are one node.

Defined cases: texts of less than SHINGLE words are one shingle; texts without words, and null texts, have fingerprint 0
and are linked like others; null ids never are a component's smallest id unless it has no other; repeated rows are rows of
one component; an empty table gives no rows; other columns are left out by components() and kept by keep_one(), which
keeps a document of every component, also where ids are null or come with several texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from claimloom.llm.common import drop, materialise, nullable_key, store

SHINGLE = 3
SEED = 42
#: Shingles whose bits are summed at a time.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number. Words end at ASCII white space; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [words] if len(words) < shingle else list(zip(*(words[k:] for k in range(shingle))))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        h = np.fromiter((xxh64_intdigest(b" ".join(g), SEED) for g in grams[at : at + BLOCK]), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return text.map(fingerprint).astype("int64")


def ball_links(nodes: DataFrame) -> DataFrame:
    """a < b: a link from every fingerprint (column fp, distinct) of a bucket to the least one in it."""
    bits = F.sequence(F.lit(-1), F.lit(63))
    # a small table comes in few partitions, and each of its rows makes 65; a given number is not made smaller at run time
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = nodes.repartition(parts, "fp").select("fp", F.explode(bits).alias("bit")).select(
        F.when(F.col("bit") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, greatest(bit, 0))"))).alias("variant"),
        F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(bit, 0))")).alias("mask"),
        (F.col("bit") < 0).cast("int").alias("self"),
    )
    buckets = variants.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("self").alias("self")).filter(F.bit_count("mask") + F.col("self") > 1)
    one = lambda i: F.expr("shiftleft(1L, 0)") if i is None else F.call_function("shiftleft", F.lit(1).cast("long"), i)
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(one(i)) != 0)
    members = F.transform(set_bits, lambda i: F.col("variant").bitwiseXOR(one(i)))
    members = F.when(F.col("self") == 1, F.concat(members, F.array("variant"))).otherwise(members)
    found = buckets.select(F.array_sort(members).alias("m")).select(F.element_at("m", 1).alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    return found.distinct().filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component), of the nodes of edges (a, b)."""
    edges, path = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    while True:
        # large star: larger neighbours of u move to the least neighbour of u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        last, (edges, path) = path, store(small)
        drop(edges.sparkSession, last)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (fp, least) with root, the least fingerprint of their component."""
    roots = connected(ball_links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    marked = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.coalesce(text_col, F.lit(""))).alias("fp")))
    labelled = rooted(materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialise(labelled.join(ids, "root").select("fp", "component_id"))
    return marked.join(known, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    found = components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id, null last; of texts of one id that with the least digest.

    Documents are told apart by a digest of id and text, so null ids and ids that come with several texts are documents of
    their own; of rows that repeat both, one stays.
    """
    own = F.unhex(F.sha2(F.concat(F.sha2(nullable_key(id_col), 256), nullable_key(text_col)), 256))
    marked = materialise(docs.select(F.col(id_col).alias("_id"), own.alias("_own"), fingerprints(F.coalesce(text_col, F.lit(""))).alias("fp")))
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_own"))
    labelled = rooted(materialise(marked.groupBy("fp").agg(least.alias("least"))))
    heads = labelled.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least._own").alias("_own"))
    heads = heads.withColumnRenamed("_own", "__own")
    return docs.withColumn("__own", own).join(heads, "__own", "left_semi").dropDuplicates(["__own"]).drop("__own")
