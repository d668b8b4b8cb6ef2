"""Turns of conversations in order, wherever the rows of a conversation lie."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import store

#: Characters of a text that decide between rows of one turn and role; beyond them its digest does.
HEAD = 64


def text_key(*parts: str | Column) -> Column:
    """16 bytes that stand for strings that are not null: their MD5, the lengths of all but the last included."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    sizes = [F.char_length(c).cast("string") for c in cols[:-1]]
    return F.unhex(F.md5(F.concat_ws("\n", *sizes, *cols)))


def ordered() -> list[Column]:
    """The order of turns for columns turn, role, head and key: by turn, nulls first, ties by role and text."""
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "head", "key")]


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id long, turn, role, head, key, ...) with ``pos``, the place of a row in its conversation, from 1.

    Rows are dealt by ranges of conversation and turn, so a conversation of any length is spread over partitions. Each partition
    numbers its own rows; a conversation that goes on from one partition to the next is made up for by one number a partition,
    the only thing that passes the driver. The dealt rows are stored, so that no recomputation can deal them anew.
    """
    order = [F.col("conv_id").asc_nulls_first(), *ordered()]
    dealt = rows.select("conv_id", *[c for c in rows.columns if c != "conv_id"]).repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    names = [*dealt.columns, "_n", "_part"]

    def number(batches):
        part, last, n = TaskContext.get().partitionId(), object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            values = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
            absent = pc.is_null(keys).to_numpy(zero_copy_only=False)
            new = np.ones(len(values), dtype=bool)
            new[1:] = (values[1:] != values[:-1]) | (absent[1:] != absent[:-1])
            new[0] = (None if absent[0] else int(values[0])) != last
            at = np.arange(len(values))
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + 1 + n, at - start + 1)
            last, n = (None if absent[-1] else int(values[-1])), int(place[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(values), part), pa.int32())], names)

    held, _ = store(dealt.mapInArrow(number, f"{kinds}, _n long, _part int"))
    spark = rows.sparkSession
    key = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("id"), F.col("_n").alias("n"))
    ends = held.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last")).orderBy("_part").collect()  # a row a partition
    shifts, before, total = [], None, 0
    for r in ends:
        first, last = r["first"][:2], r["last"][:2]
        shift = total if first == before else 0
        if shift:
            shifts.append((r["_part"], first[1], shift))
        before, total = last, r["last"]["n"] + (shift if first == last else 0)
    if not shifts:
        return held.withColumnRenamed("_n", "pos").drop("_part")
    known = F.broadcast(spark.createDataFrame(shifts, "_p int, _conv long, _shift long"))  # at most a row a partition
    found = held.join(known, (F.col("_part") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return found.withColumn("pos", F.col("_n") + F.coalesce("_shift", F.lit(0))).drop("_n", "_part", "_p", "_conv", "_shift")
