"""Structure repair of conversations: the cheapest edits that make turns alternate, found by a fold in Spark SQL.

A sound conversation is empty, or an optional system turn and then user and assistant in turn, ending with the assistant. Window
functions flag the faults of each turn; the turns of a conversation, as slim structs in order, are folded by aggregate() over
four structs (cost, audit), one for each thing that can have been written last: nothing, a system turn, a user's, an
assistant's. least() of structs keeps the cheaper edits and, at equal cost, the audit that is least by code point. Of two audits
of equal cost over the same turns neither begins with the other (an insertion costs something), so the least of the whole is made
of least parts, and the fold is exact.

The fold goes by segments of SEGMENT turns, each folded once for every thing that may have come before it; a second, short fold
puts segments together. So no task gets all turns of a conversation, and strings do not grow by one character at a time.
apply_edits() streams sorted turns past their audit and writes the repaired turns.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, which blank and repeated turns need, Insert (an empty turn of the
user or the assistant) 3; a truncated turn that is not deleted costs 3 more.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; turns are ordered by number, nulls
first, ties by role and text; a turn whose role begins with none of s, u and a can't be kept as it is; a repeated row is a
duplicate; texts of any length are looked at whole; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from functools import reduce

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import BLANKS
from claimloom.llm.turns import HEAD, numbered, ordered, text_key

#: Turns that are folded at a time.
SEGMENT = 256
#: Turns among which repeats are sought before the first of each such block are compared.
BLOCK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More than any cost.
NEVER = 1 << 60

STATES = ("none", "system", "user", "assistant")
STEP = "struct<cost:bigint,audit:string>"


def _clean(turns: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def flagged(turns: DataFrame) -> DataFrame:
    """A slim row per turn: conv_id, pos, turn, initial, and its first fault: blank, duplicate or truncated."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    slim = _clean(turns).select(
        "conv_id", "turn", "role", F.left("text", F.lit(HEAD)).alias("head"), text_key("role", "text").alias("key"),
        (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )
    rows = numbered(slim).select("conv_id", "turn", "pos", "key", F.left("role", F.lit(1)).alias("initial"), "blank", "open")
    block = F.floor((F.col("pos") - 1) / BLOCK)
    near = F.row_number().over(Window.partitionBy("conv_id", "key", block).orderBy("pos")) > 1
    rows = rows.withColumn("_near", near)
    # the first of each block meet; the others, which are repeats, stay among themselves
    far = F.row_number().over(Window.partitionBy("conv_id", "key", F.when(F.col("_near"), block)).orderBy("pos")) > 1
    repeat = F.col("_near") | far
    return rows.select("conv_id", "turn", "pos", "initial", "blank", (~F.col("blank") & repeat).alias("duplicate"), (~F.col("blank") & ~repeat & F.col("open")).alias("truncated"))


def _step(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(step: Column, cost: Column | int, letter: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _step(step["cost"] + as_column(cost), F.concat(step["audit"], as_column(letter)))


def _inserted(acc: Column) -> dict[str, Column]:
    """The four after at most one insertion; two in a row never pay."""
    user = F.least(acc["user"], *(_then(acc[s], INSERT, "I") for s in ("none", "system", "assistant")))
    return {"none": acc["none"], "system": acc["system"], "user": user, "assistant": F.least(acc["assistant"], _then(acc["user"], INSERT, "I"))}


def _turn(acc: Column, t: Column) -> Column:
    """The four after another turn."""
    opened, deleted = _inserted(acc), {s: _then(acc[s], DELETE, "D") for s in STATES}
    late = {s: _then(x, DELETE, "D") for s, x in opened.items()}
    extra = F.when(t["truncated"], TRUNCATED).otherwise(0)
    barred = F.when(t["must_go"], F.lit(NEVER)).otherwise(extra)

    def kept(before: str, initial: str) -> Column:
        same = t["initial"] == initial
        return _then(opened[before], barred + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"))

    system = _then(acc["none"], F.when(t["initial"] == "s", barred).otherwise(F.lit(NEVER)), "K")
    user = F.least(deleted["user"], late["user"], *(kept(s, "u") for s in ("none", "system", "assistant")))
    assistant = F.least(deleted["assistant"], late["assistant"], kept("user", "a"))
    return F.struct(deleted["none"].alias("none"), F.least(deleted["system"], system).alias("system"), user.alias("user"), assistant.alias("assistant"))


def _four(cost_of) -> Column:
    return F.struct(*(_step(cost_of(s), F.lit("")).alias(s) for s in STATES))


def _fold(turns: Column, entry: Column) -> Column:
    """The four at the end of a segment that is entered in one of STATES."""
    return F.aggregate(turns, _four(lambda s: F.when(entry == s, 0).otherwise(NEVER)), _turn)


def audits(flags: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost and audit from flagged()."""
    segment = F.floor((F.col("pos") - 1) / SEGMENT).alias("segment")
    rows = flags.select("*", segment)
    here = Window.partitionBy("conv_id", "segment").orderBy("pos")
    pair = F.concat(F.lag("initial").over(here), F.col("initial"))
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(here).eqNullSafe(F.col("turn"))
    rows = rows.withColumns({"illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "fresh": fresh})
    count = lambda c: F.count_if(c).alias(c)
    turn = F.struct("pos", "initial", (F.col("blank") | F.col("duplicate")).alias("must_go"), "truncated")
    segments = rows.groupBy("conv_id", "segment").agg(
        *(count(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")), F.min("turn").alias("low"), F.max("turn").alias("high"),
        F.min_by("initial", "pos").alias("first"), F.max_by("initial", "pos").alias("last"), F.sort_array(F.collect_list(turn)).alias("turns"),
    )
    entries = F.when(F.col("segment") == 0, F.array(F.lit("none"))).otherwise(F.array(*map(F.lit, STATES)))
    folded = segments.withColumn("exits", F.transform(entries, lambda e: _fold(F.col("turns"), e))).drop("turns")

    fields = ("segment", "exits", "blank", "duplicate", "truncated", "illegal", "fresh", "low", "high", "first", "last")
    whole = folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("s"))

    def join(acc: Column, seg: Column) -> Column:
        entry = lambda k: F.coalesce(F.get(seg["exits"], F.lit(k)), _four(lambda _: F.lit(NEVER)))
        outs = [entry(k) for k in range(len(STATES))]

        def exit_by(s: str) -> Column:
            return F.least(*(_step(F.least(acc[e]["cost"] + outs[k][s]["cost"], F.lit(NEVER)), F.concat(acc[e]["audit"], outs[k][s]["audit"])) for k, e in enumerate(STATES)))

        return F.struct(*(exit_by(s).alias(s) for s in STATES))

    def close(acc: Column) -> Column:
        return F.least(acc["none"], acc["assistant"], _then(acc["user"], INSERT, "I"))

    total = lambda c: F.aggregate(F.col(f"s.{c}"), F.lit(0).cast("long"), lambda a, x: a + x)
    # where one segment ends and the next begins
    seams = F.arrays_zip(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("a"), F.slice("s", 2, F.size("s")).alias("b"))
    bad = F.size(F.filter(seams, lambda z: ~F.concat(z["a"]["last"], z["b"]["first"]).isin("su", "ua", "au")))
    twice = F.size(F.filter(seams, lambda z: z["a"]["high"] == z["b"]["low"]))
    low, high = F.array_min("s.low"), F.array_max("s.high")
    start = _four(lambda s: F.lit(0 if s == "none" else NEVER))
    done = whole.select(
        "conv_id", F.coalesce(high - low + 1 - total("fresh") + twice, F.lit(0)).cast("long").alias("gaps"),
        *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")), (total("illegal") + bad).alias("illegal"),
        F.aggregate("s", start, join, close).alias("_best"),
    )
    return done.select("*", F.col("_best.cost").alias("cost"), F.col("_best.audit").alias("audit")).drop("_best")


def apply_edits(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, turn_no, role, text), a conversation's rows together and in order.

    A conversation is one task's stream, of any length; its audit comes first in it.
    """
    rows = _clean(turns).withColumns({"head": F.left("text", F.lit(HEAD)), "key": text_key("role", "text"), "audit": F.lit(None).cast("string")})
    plans = edits.select("conv_id", *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("head", "string"), ("key", "binary"))), "audit")
    both = rows.unionByName(plans).withColumn("_row", F.col("audit").isNull())
    dealt = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_row", *ordered()).select("conv_id", "audit", "role", "text")

    def run(batches):
        conv, audit, at, due, n, out = None, "", 0, "user", 0, []

        def write(role, text):
            nonlocal due, n
            out.append((conv, n, role, text))
            n += 1
            if not role.startswith("s"):
                due = "assistant" if due == "user" else "user"

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                write(due, "")
                at += 1

        for b in batches:
            for c, plan, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if plan is not None:
                    inserted()
                    conv, audit, at, due, n = c, plan, 0, "user", 0
                    continue
                inserted()
                edit = audit[at]
                at += 1
                if edit == "K":
                    write(role, text)
                elif edit == "R":
                    write(due, text)
            if out:
                yield _batch(out)
                out = []
        inserted()
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "conv_id long, turn_no long, role string, text string")


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "turn_no", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of role:text by line. Expects the order of apply_edits()."""

    def run(batches):
        conv, state = None, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

        for b in batches:
            for c, n, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if n == 0:
                    if state is not None:
                        yield close()
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
        if state is not None:
            yield close()

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Turns with faults, by the checksum of conversation and turn: dropped, emptied, without ends, repeated, said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = _clean(turns).withColumn("_kind", F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.filter(F.col("_kind") != 0).select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy"))
    return rows.drop("_copy")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(turns: DataFrame, original: DataFrame) -> DataFrame:
    """A row for every conversation of original: faults of its turns, cheapest edits, digest of what they make."""
    edits = audits(flagged(turns))
    made = digests(apply_edits(turns, edits))
    key = lambda df: df.withColumnRenamed("conv_id", "_key")
    same = F.col("conv_id").eqNullSafe(F.col("_key"))
    out = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = out.join(key(edits), same, "left").drop("_key").join(key(made), same, "left").drop("_key")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
