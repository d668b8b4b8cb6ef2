"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its share of every moment is its weight over the sum of all
weights; the integral of the share is its demand curve. Targets follow from the mean shares, no source is repeated more
than ``repeat_cap`` times, and what a capped source cannot give is shared out again by weight. A document that starts at
cumulative word c of its source is trained on when the source's demand reaches c: the curve is inverted there. Documents
are then range-sorted by that position.

Prefix sums over a source run in two levels (buckets of a content hash, then rows of a bucket), so that a source with a
third of all rows is spread over sqrt(rows) buckets and no task sees a whole source.

Defined cases: a null text has size 0 and a null source is a source of its own, last in order; documents of size 0 take
part but no words come from them; repeated rows are separate documents that share a key (which of them is first does not
change the rows that come out); an empty table gives an empty table; other columns are carried along untouched.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, nullable_key, word_count

#: A weight schedule: knots (time, weight), linear in between. Schedules of a mix: a list that sources take in turn.
Schedule = tuple[tuple[float, float], ...]
#: Mean weights that sources in order take in turn, and by how much a schedule of the curriculum rises or falls about its mean.
WEIGHTS, TILT = (1.0, 2.0, 3.0), 0.5
#: Steps of the numeric integral of the shares.
STEPS = 64


def weight_at(knots: Schedule, t: float) -> float:
    """The weight of a schedule at time t; flat before the first and after the last knot."""
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t < t1:
            return w0 if t <= t0 else w0 + (w1 - w0) * (t - t0) / (t1 - t0)
    return knots[-1][1]


def users_of(schedules: int, sources: int) -> list[int]:
    """How many sources take each schedule."""
    return [len(range(k, sources, schedules)) for k in range(schedules)]


def curriculum(sources: int, weights=WEIGHTS, tilt: float = TILT) -> list[Schedule]:
    """Ramps for so many sources: every second source fades out, the others come in, about their mean weights.

    All ramps lean by one correction more, so that weights add up to the same at any time and mean shares are the weights'.
    """
    period = len(weights) * (1 + len(weights) % 2)
    mean = [weights[k % len(weights)] for k in range(period)]
    users = users_of(period, sources)
    lean = [tilt if k % 2 else -tilt for k in range(period)]
    off = sum(u * w * x for u, w, x in zip(users, mean, lean)) / max(sum(u * w for u, w in zip(users, mean)), 1.0)
    return [((0.0, w * (1 - x + off)), (1.0, w * (1 + x - off))) for w, x in zip(mean, lean)]


def integrals(schedules: list[Schedule], sources: int) -> tuple[list[float], list[list[float]]]:
    """Of each schedule the mean share of one source, and the demand curve: the part of it used up by each time step."""
    grid = [[weight_at(k, i / STEPS) for i in range(STEPS + 1)] for k in schedules]
    users = users_of(len(schedules), sources)
    totals = [sum(g[i] * u for g, u in zip(grid, users)) for i in range(STEPS + 1)]
    shares, curves = [], []
    for g in grid:
        share = [w / t if t > 0 else 0.0 for w, t in zip(g, totals)]
        curve = [0.0]
        for a, b in zip(share, share[1:]):
            curve.append(curve[-1] + (a + b) / (2 * STEPS))
        shares.append(curve[-1])
        curves.append([x / curve[-1] if curve[-1] > 0 else 0.0 for x in curve])
    return shares, curves


def source_targets(sizes: DataFrame, weights: list[float], repeat_cap: float = 3.0) -> DataFrame:
    """(_src, _source_size) -> with _turn (whose schedule it takes) and _target, from the mean shares of schedules.

    One row per source comes in, so the single-partition windows here see a table of sources, never documents: four numbers
    a source.
    """
    s = sizes.withColumn("_turn", ((F.row_number().over(Window.orderBy("_src")) - 1) % len(weights)).cast("int"))
    s = s.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_turn") + 1))
    s = s.withColumn("_cap", F.lit(float(repeat_cap)) * F.col("_source_size"))
    s = s.withColumn("_ratio", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")).otherwise(F.lit(float("inf"))))
    fill = Window.orderBy("_ratio", "_src")
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_total", F.sum("_source_size").over(everything))
    s = s.withColumn("_level", F.when(left > 0, (F.col("_total") - before) / left))
    # the first source in order of cap by weight that stays under its cap sets the level for all after it
    s = s.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap")))
    return s.select("_src", "_source_size", "_turn", target.alias("_target"))


def time_reached(part: Column, curve: Column) -> Column:
    """The time at which a demand curve (at STEPS + 1 even steps) reaches a part of its target: the curve inverted."""
    step = F.least(F.lit(STEPS), F.greatest(F.lit(1), F.size(F.filter(curve, lambda g: g <= part))))

    def between(k):
        low, high = F.element_at(curve, k), F.element_at(curve, k + 1)
        return (k - 1 + F.when(high > low, (part - low) / (high - low)).otherwise(F.lit(0.0))) / STEPS

    # bound to a name by an array of one, so that the curve is searched once
    return F.element_at(F.transform(F.array(step), between), 1)


def content_key(docs: DataFrame, id_col: str) -> Column:
    """A hash of all columns that have one."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if c != id_col and "map<" not in kind and "variant" not in kind], F.lit(0))


def positions(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size=None, key: Column | None = None, schedules=curriculum, repeat_cap: float = 3.0) -> DataFrame:
    """docs with _size, _source_size, _target, _copies and _positions (times in 0..1 of its copies, ascending).

    size: a Column, words of the text if not given; key: what tells rows of one id apart, a hash of the other columns if not
    given; schedules: a list that sources in order take in turn, or a function of
    the number of sources that gives it. A document is taken in a pass over its source if the middle of it
    lies within the target, so that a source's sum is off by half a document at most.
    """
    size = word_count("text") if size is None else size
    row = F.xxhash64(F.col(id_col), content_key(docs, id_col) if key is None else key)
    docs = docs.select("*", size.alias("_size"), nullable_key(source_col).alias("_src"), row.alias("_row"))
    n = docs.count()
    buckets = max(1, math.isqrt(n))
    docs = docs.withColumn("_bucket", F.pmod("_row", F.lit(buckets)).cast("int"))
    sums = docs.groupBy("_src", "_bucket").agg(F.sum("_size").alias("_words"))
    sums = materialise(sums)
    sources = materialise(sums.groupBy("_src").agg(F.sum("_words").alias("_source_size")))
    known = sources.count()
    shares, curves = integrals(schedules(known) if callable(schedules) else list(schedules), known)
    targets = source_targets(sources, shares, repeat_cap)
    w = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_words").over(w), F.lit(0))).drop("_words").join(targets, "_src")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_row", F.col(id_col), "_size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(offsets, ["_src", "_bucket"])
    middle = F.col("_offset") + F.col("_before") + F.col("_size") / 2
    passes = F.floor((F.col("_target") - middle) / F.nullif(F.col("_source_size"), F.lit(0))) + 1
    copies = F.greatest(F.lit(0), F.least(F.lit(math.ceil(repeat_cap)), F.coalesce(passes, F.lit(0)))).cast("int")
    docs = docs.withColumn("_copies", copies).withColumn("_middle", middle)
    # read from a literal once a row, not once a use
    docs = docs.withColumn("_curve", F.element_at(F.from_json(F.lit(json.dumps(curves)), "array<array<double>>"), F.col("_turn") + 1))
    curve = F.col("_curve")
    when_reached = lambda e: time_reached((e * F.col("_source_size") + F.col("_middle")) / F.col("_target"), curve)
    places = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), when_reached)).otherwise(F.array().cast("array<double>"))
    return docs.withColumn("_positions", places).drop("_src", "_bucket", "_before", "_offset", "_middle", "_turn", "_curve")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size=None, **how) -> DataFrame:
    """The documents in training order: one row per copy taken, range-sorted by position; the columns of docs."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")  # whatever its columns are called
    slim = docs.select(whole, F.col(id_col).alias("id"), F.col(source_col).alias("source"), (word_count("text") if size is None else size).alias("size"), content_key(docs, id_col).alias("key"))
    placed = positions(slim, id_col="id", source_col="source", size=F.col("size"), key=F.col("key"), **how).select("whole", "_row", F.explode("_positions").alias("_position"))
    return placed.repartitionByRange("_position", "_row").sortWithinPartitions("_position", "_row").select("whole.*")


def mix_report(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """A row per document with what the mix takes of it, in training order (documents not taken come last)."""
    slim = materialise(docs.select(id_col, source_col, word_count("text").alias("size"), F.xxhash64("text").alias("_text")))
    placed = positions(slim, id_col=id_col, source_col=source_col, size=F.col("size"), **how)
    placed = placed.select(
        F.col(id_col), "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"), F.try_element_at("_positions", F.lit(1)).alias("position"), "_row",
    )
    return placed.repartitionByRange(F.col("position").asc_nulls_last(), "_row").sortWithinPartitions(F.col("position").asc_nulls_last(), "_row").drop("_row")
