"""Line dedup by winnowing over line hashes, in DataFrame operations only.

The unit is a line that has a word; its hash stands for it, and a second hash of another seed is compared as well before
anything is cut: runs are the same if 128 bits of their content are. A window is the shortest run of lines from a line on that holds
MIN_WORDS words. Of each window the least hash is selected, the last of equal ones: its line is a fingerprint of the document.
Any run of MIN_WORDS words that two documents share holds a whole window of both, and that window selects the same line in
both, so a shared run always has a fingerprint in common. Most windows select the line that their neighbour has selected.

1. The selected lines, each once, are joined on their hashes. A fingerprint that one place has alone goes no further: that
   is nearly all of a text that is nobody else's.
2. From the places that are left matches are extended both ways, without pairing them off: the runs of lines around such a
   place that just hold MIN_WORDS words, those that begin at one of the lines and those that end at one, are looked up by
   their content. A run whose content has an earlier place is a repeat, whichever place that is. A longer shared run is made
   up of the runs from its lines on and the run up to its last line, all of which hold a window and so a common fingerprint:
   what these cover is all there is. Thousands of copies make thousands of rows, one for each run, and not their square.
3. Runs that touch are joined, and all lines covered are deleted.

Only ids, positions and hashes are shuffled. A Bloom filter passes the documents with deletions on to the exact join with
what is to be cut from them; the texts of the others stay where they are.

A line that is deleted has an equal line at an earlier place, and the earliest place of a line is never deleted, so every
line of the corpus survives somewhere. Places are in order of doc_id, then of the text's hash, then of the line.

Defined cases: null texts stay null and have no lines; lines without a word are never compared, and go where the
nearest lines with words on both sides go; lines are compared without white space at their ends; a text all of whose lines repeat becomes
empty, its row stays; rows repeated with the same id and text are one document, given repeatedly, and come out alike;
null ids are one id, the first; an empty table gives an empty table; other columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import MAX_BLOCKS, bloom_blocks, materialise, may_hold, word_count

MIN_WORDS = 50
DOC = ["_id", "_doc"]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _doc, _at, _hash, _check, _words: a row per line with a word. _doc tells texts of one id apart."""
    split = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_doc"), F.posexplode(F.split(text_col, "\n")).alias("_at", "_line"))
    line = F.trim("_line", F.lit(" \t\r\x0b\x0c"))
    return split.select("_id", "_doc", "_at", F.xxhash64(line).alias("_hash"), F.xxhash64(F.lit("check"), line).alias("_check"), word_count("_line").cast("int").alias("_words")).filter("_words > 0")


def measured(found: DataFrame) -> DataFrame:
    """Lines by document, each once, with their number and the words before them (_start) and up to their end (_stop)."""
    order = Window.partitionBy(*DOC).orderBy("_at")
    found = found.withColumns({"_no": F.row_number().over(order), "_stop": F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    # starts increase strictly: every line here has a word
    return found.withColumn("_start", F.col("_stop") - F.col("_words"))


def fingerprints(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _doc, _at, _hash: the lines that windows select, each once."""
    found = measured(found.repartition(*DOC).dropDuplicates([*DOC, "_at"]))
    ahead = Window.partitionBy(*DOC).orderBy("_start").rangeBetween(0, min_words - 1)
    least = F.min(F.struct(F.col("_hash").alias("h"), (-F.col("_at")).alias("at"))).over(ahead)
    windows = found.select(*DOC, least.alias("_least"), F.sum("_words").over(ahead).alias("_held")).filter(F.col("_held") >= min_words)
    # neighbouring windows mostly select the same line
    return windows.select(*DOC, (-F.col("_least.at")).alias("_at"), F.col("_least.h").alias("_hash")).dropDuplicates([*DOC, "_at"])


def shared(selected: DataFrame) -> DataFrame:
    """The places of fingerprints that more than one place has."""
    again = selected.groupBy("_hash").agg(F.count("*").alias("_places")).filter("_places > 1").drop("_places")
    # as a table: a join of two scans can be split where one line is in a third of the documents
    return selected.join(materialise(again), "_hash", "left_semi")


def extensions(found: DataFrame, places: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_a, _b, _from, _to, _n, _key, _also: the runs (numbers of their lines, and positions) around the places that just hold min_words words, from a line on and up to a line."""
    both = found.withColumn("_hit", F.lit(False)).unionByName(places.withColumns({"_check": F.lit(None).cast("long"), "_words": F.lit(None).cast("int"), "_hit": F.lit(True)}))
    both = both.repartition(*DOC).groupBy(*DOC, "_at").agg(F.max("_hash").alias("_hash"), F.max("_check").alias("_check"), F.max("_words").alias("_words"), F.max("_hit").alias("_hit"))
    # documents without any such place are done
    both = measured(both.withColumn("_any", F.max("_hit").over(Window.partitionBy(*DOC))).filter("_any").drop("_any"))
    ahead = Window.partitionBy(*DOC).orderBy("_start").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*DOC).orderBy("_stop").rangeBetween(1 - min_words, 0)
    run = lambda over: F.struct(F.min("_no").over(over).alias("_a"), F.max("_no").over(over).alias("_b"), F.min("_at").over(over).alias("_from"), F.max("_at").over(over).alias("_to"), F.sum("_words").over(over).alias("_held"), F.max("_hit").over(over).alias("_hit"), F.collect_list("_hash").over(over).alias("_inside"), F.collect_list("_check").over(over).alias("_checks"))
    both = both.select(*DOC, "_words", run(ahead).alias("_ahead"), run(behind).alias("_behind"))
    # a run that ends here and is the shortest from its first line too is there already
    twice = F.when(F.col("_behind._held") - F.col("_words") >= min_words, F.col("_behind"))
    both = both.select(*DOC, F.explode(F.array("_ahead", twice)).alias("_run")).select(*DOC, "_run.*").filter((F.col("_held") >= min_words) & F.col("_hit"))
    return both.select(*DOC, "_a", "_b", "_from", "_to", F.size("_inside").alias("_n"), F.xxhash64("_inside").alias("_key"), F.xxhash64("_checks").alias("_also"))


def repeats(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_id, _doc, _from, _to: the runs of lines that repeat an earlier place, joined where they touch."""
    places = shared(materialise(fingerprints(found, min_words)))
    around = materialise(extensions(found, places, min_words))
    key, place = ["_n", "_key", "_also"], F.struct(*DOC, "_from")
    firsts = around.groupBy(*key).agg(F.min(place).alias("_first"), F.count("*").alias("_places")).filter("_places > 1").drop("_places")
    return joined(around.join(materialise(firsts), key).filter(~place.eqNullSafe(F.col("_first"))).select(*DOC, "_a", "_b", "_from", "_to"))


def joined(runs: DataFrame) -> DataFrame:
    """Runs joined where they touch: where no line with a word is between them."""
    order = Window.partitionBy(*DOC).orderBy("_a", "_b")
    reached = F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", F.when(F.col("_a") <= reached + 1, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*DOC, "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with the repeated lines deleted from the text. report: also _n_lines, _n_deleted and _runs."""
    found = materialise(lines(docs, id_col, text_col))
    cuts = repeats(found, min_words).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("_from", "_to"))).alias("__runs"))
    cuts = materialise(cuts.withColumnsRenamed({"_id": "__id", "_doc": "__doc"}))
    own = docs.withColumn("__h", F.xxhash64(text_col))
    rows = may_hold(own, F.when(F.col(text_col).isNotNull(), F.col("__h")), cuts.select("__doc"), bloom_blocks(cuts.count(), MAX_BLOCKS), "__passes")
    passed, rest = rows.filter("__passes"), rows.filter("not __passes")
    cut = passed.join(cuts, passed[id_col].eqNullSafe(cuts["__id"]) & (passed["__h"] == cuts["__doc"]), "left").drop("__id", "__doc")
    out = cut.unionByName(rest.withColumn("__runs", F.lit(None).cast(cuts.schema["__runs"].dataType))).drop("__h", "__passes")
    split = F.split(F.col(text_col), "\n")
    # what is kept are the slices between the runs: the cost is lines plus runs
    starts = F.concat(F.array(F.lit(0)), F.transform("__runs", lambda r: r["_to"] + 1))
    stops = lambda parts: F.concat(F.transform("__runs", lambda r: r["_from"]), F.array(F.size(parts)))
    kept = F.transform(F.array(split), lambda parts: F.array_join(F.flatten(F.zip_with(starts, stops(parts), lambda a, b: F.slice(parts, a + 1, F.greatest(b - a, F.lit(0))))), "\n"))
    cleaned = F.when(F.col("__runs").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.element_at(kept, 1))
    if not report:
        return out.withColumn(text_col, cleaned).drop("__runs")
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split))
    gone = F.coalesce(F.aggregate("__runs", F.lit(0), lambda a, r: a + r["_to"] - r["_from"] + 1), F.lit(0))
    out = out.withColumns({"_n_lines": n, "_n_deleted": gone, "__cleaned": cleaned, "_runs": F.coalesce("__runs", F.array().cast("array<struct<_from:int,_to:int>>"))})
    return out.withColumn(text_col, F.col("__cleaned")).drop("__cleaned", "__runs")
