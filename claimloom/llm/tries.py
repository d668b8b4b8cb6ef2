"""The prefix trie of conversations: which turns they share from their start on, and what sharing them would save.

A node is a distinct sequence of turns; its members are the conversations that begin with it. Every row knows its prefix by a
running XOR of 128-bit hashes of (depth, turn), which blocks of BLOCK turns make of long conversations too.

Light parts: the rows below a node of at most HEAVY rows are one task's work at most. They are dealt by the prefix at which
their part begins (the shard), and each partition builds succinct tries of some whole parts at a time, level by level in numpy: a
LOUDS bit vector (for each node, in level order, a one for each child and then a zero) with flat arrays of labels. tries() is
that table. nodes() reads it: parents follow from the bits by rank and select, and a pass over the levels in reverse adds every
node's leaves and savings to its parent (add.at).

Heavy upper levels, with more than HEAVY rows below (the root always), are merged apart, with aggregations only: roots of shards
and heavy nodes hand what they contribute to their least member's row, a running sum takes it up along the heavy rows of that
conversation, and one grouped sum puts it at the nodes. A conversation alone on a heavy path needs none of that.
Ids of conversations that end at a heavy node are joined in ranges of CHUNK ids before they are hashed in order.

Defined cases: null roles and texts are empty; turns are ordered by number, nulls first, ties by role and text; repeated rows are
turns of their own; rows without a conversation's id take no part; families of
negative ids are counted from 0 down; conversations without turns are members of the root; texts of
any length count whole; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise
from claimloom.llm.turns import HEAD, numbered, text_key

#: Rows below a node from which on it is merged apart, and rows that tries are built of together.
HEAVY, TOGETHER = 1 << 16, 1 << 16
#: Turns of a conversation that a running XOR goes over at a time.
BLOCK = 4096
#: The width of a range of ids that is joined before it is hashed.
CHUNK = 1 << 16
#: Conversations that are rebuilt from the same one, and its turns that are shared at most.
FAMILY, SHARED = 100, 5

NO_ENDS = hashlib.sha256(b"").hexdigest()
TRIE = "bits binary, labels binary, depth long, depths array<long>, chars array<long>, members array<long>, least array<long>, end_node array<int>, end_conv array<long>, root_qa array<long>, root_qb array<long>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, is_root boolean, qa long, qb long"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos, key (16 bytes for role and text), chars; a slim row per turn."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).filter(F.col("conv_id").isNotNull())
    slim = rows.select("conv_id", "turn", "role", F.left("text", F.lit(HEAD)).alias("head"), text_key("role", "text").alias("key"), F.char_length("text").cast("long").alias("chars"))
    return numbered(slim).select("conv_id", "pos", "key", "chars")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, chars) and (conv_id, size) of conversations as they are."""
    rows = turns_in_order(turns)
    return rows.withColumnRenamed("pos", "depth"), rows.groupBy("conv_id").agg(F.max("pos").alias("size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As whole(), of conversations whose first turns are those of the first of their family of FAMILY ids, as many as a checksum says."""
    rows = turns_in_order(turns)
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = rows.filter((F.col("pos") <= SHARED) & (F.col("conv_id") == first)).groupBy(F.col("conv_id").alias("_first"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("_head"))  # at most SHARED each
    convs = rows.groupBy("conv_id").agg(F.max("pos").alias("_own"))
    convs = convs.withColumns({"_h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1), "_first": first}).join(heads, "_first", "left")
    head = F.slice(F.coalesce("_head", F.array().cast("array<struct<pos:bigint,key:binary,chars:bigint>>")), F.lit(1), F.col("_h").cast("int"))
    convs = convs.select("conv_id", "_h", "_own", head.alias("_head")).withColumn("_b", F.size("_head").cast("long"))
    lent = convs.select("conv_id", F.explode("_head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.key", "t.chars")
    own = rows.join(convs.select("conv_id", "_h", "_b"), "conv_id").filter(F.col("pos") > F.col("_h"))
    own = own.select("conv_id", (F.col("_b") + F.col("pos") - F.col("_h")).alias("depth"), "key", "chars")
    return lent.unionByName(own), convs.select("conv_id", (F.col("_b") + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).alias("size"))


def prefixes(sequences: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with the prefix that ends at them (pa, pb), the one before (qa, qb), and the size of their conversation."""
    rows = sequences.join(sizes, "conv_id").withColumn("_block", F.floor((F.col("depth") - 1) / BLOCK))
    rows = rows.withColumns({"_a": F.xxhash64("depth", "key"), "_b": F.xxhash64(F.lit("second"), "key", "depth")})
    here = Window.partitionBy("conv_id", "_block").orderBy("depth")
    rows = rows.withColumns({"_pa": F.bit_xor("_a").over(here), "_pb": F.bit_xor("_b").over(here)})
    blocks = rows.filter(F.col("size") > BLOCK).groupBy("conv_id", "_block").agg(F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_block", F.bit_xor("_a").over(before).alias("_ca"), F.bit_xor("_b").over(before).alias("_cb"))
    rows = rows.join(blocks, ["conv_id", "_block"], "left")
    carried = lambda c, carry: F.col(c).bitwiseXOR(F.coalesce(carry, F.lit(0).cast("long")))
    rows = rows.select("conv_id", "depth", "size", "key", "chars", carried("_pa", "_ca").alias("pa"), carried("_pb", "_cb").alias("pb"), "_a", "_b")
    return rows.withColumns({"qa": F.col("pa").bitwiseXOR(F.col("_a")), "qb": F.col("pb").bitwiseXOR(F.col("_b"))}).drop("_a", "_b")


def heavy_nodes(rows: DataFrame) -> DataFrame:
    """Nodes with more than HEAVY rows below: depth, pa, pb, qa, qb, n_convs, least, chars."""
    found = rows.groupBy("depth", "pa", "pb").agg(
        F.sum(F.col("size") - F.col("depth") + 1).alias("_rows"), F.count("*").alias("n_convs"), F.min("conv_id").alias("least"),
        F.min("chars").alias("chars"), F.min("qa").alias("qa"), F.min("qb").alias("qb"),
    )
    return found.filter(F.col("_rows") > HEAVY).drop("_rows")


class Trie:
    """A forest in level order: its bits, and per node (the one above the roots first) what tries() stores."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        ones = np.flatnonzero(bits)
        # the k-th one is node k + 1; the zeros before it are the nodes that are done, so their number is its parent
        self.parent = np.concatenate([[-1], ones - np.arange(len(ones))]).astype(np.int64)
        self.degree = np.bincount(self.parent[1:], minlength=len(self.parent))
        self.level_starts = [0, 1]
        first_child = np.concatenate([[1], 1 + np.cumsum(self.degree)])
        while self.level_starts[-1] < len(self.parent):
            self.level_starts.append(int(first_child[self.level_starts[-1]]))
            if self.level_starts[-1] == self.level_starts[-2]:
                raise ValueError("not a tree")

    def rollup(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        out = values.copy()
        for k in range(len(self.level_starts) - 1, 1, -1):
            level = slice(self.level_starts[k - 1], self.level_starts[k])
            np.add.at(out, self.parent[level], out[level])
        return out


def louds(degree: np.ndarray) -> np.ndarray:
    """The bit vector of nodes in level order with so many children."""
    bits = np.ones(int(degree.sum()) + len(degree), dtype=np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return bits


def _build(conv, depth, size, labels, chars, root, qa, qb) -> dict:
    """The forest of rows sorted by root and conversation. root numbers the shards from 0."""
    new = np.ones(len(conv), dtype=bool)
    new[1:] = (conv[1:] != conv[:-1]) | (root[1:] != root[:-1])
    member = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    level = depth - depth[start][member]
    at = np.zeros(len(start), dtype=np.int64)  # the node that a conversation has come to
    by_level = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2))
    parent, first_row, node_of_row, n = [np.array([-1])], [np.array([0])], np.zeros(len(conv), dtype=np.int64), 1
    for k in range(len(bounds) - 1):
        rows = by_level[bounds[k] : bounds[k + 1]]
        above = at[member[rows]] if k else root[rows]
        order = np.lexsort((labels[rows, 1], labels[rows, 0], above))
        rows, above = rows[order], above[order]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (above[1:] != above[:-1]) | (labels[rows[1:]] != labels[rows[:-1]]).any(axis=1)
        nodes = n + np.cumsum(fresh) - 1
        at[member[rows]] = nodes
        node_of_row[rows] = nodes
        parent.append(above[fresh] if k else np.zeros(int(fresh.sum()), dtype=np.int64))
        first_row.append(rows[fresh])
        n += int(fresh.sum())
    parent, first_row = np.concatenate(parent), np.concatenate(first_row)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, node_of_row, conv)
    ends = np.flatnonzero(depth == size)
    ends = ends[np.lexsort((conv[ends], node_of_row[ends]))]
    roots = first_row[1 : 1 + int((parent[1:] == 0).sum())]
    return {
        "bits": np.packbits(bits := louds(np.bincount(parent[1:], minlength=n))).tobytes(), "labels": labels[first_row[1:]].tobytes(), "depth": len(bits), "depths": depth[first_row[1:]],
        "chars": chars[first_row[1:]], "members": np.bincount(node_of_row, minlength=n)[1:], "least": least[1:], "end_node": node_of_row[ends].astype(np.int32), "end_conv": conv[ends],
        "root_qa": qa[roots], "root_qb": qb[roots],
    }


_KINDS = {"binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def tries(light: DataFrame) -> DataFrame:
    """LOUDS tries of rows (conv_id, depth, size, key, chars, qa, qb) by the shard they are in (da, db); a row per trie.

    A trie holds whole shards, some of them together where they are small; depth is the length of its bits. Its flat arrays are in
    level order, without the node above the roots.
    """
    names = ("da", "db", "conv_id", "depth", "size", "key", "chars", "qa", "qb")
    dealt = light.repartition("da", "db").sortWithinPartitions("da", "db", "conv_id", "depth").select(*names)
    schema = [x.split() for x in TRIE.split(", ")]

    def run(batches):
        held, count = [], 0

        def built(rows):
            if len(rows["conv_id"]):
                found = _build(rows["conv_id"], rows["depth"], rows["size"], rows["key"], rows["chars"], rows["root"], rows["qa"], rows["qb"])
                yield pa.RecordBatch.from_arrays([pa.array([found[name]], _KINDS[kind]) for name, kind in schema], [name for name, _ in schema])

        def joined():
            rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            new = np.ones(len(rows["conv_id"]), dtype=bool)
            new[1:] = (rows["da"][1:] != rows["da"][:-1]) | (rows["db"][1:] != rows["db"][:-1])
            rows["root"] = np.cumsum(new) - 1
            return rows, int(np.flatnonzero(new)[-1])  # where the last shard begins, which may go on

        for b in batches:
            if not b.num_rows:
                continue
            rows = {c: b.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names) if c != "key"}
            rows["key"] = np.frombuffer(b"".join(b.column(names.index("key")).to_pylist()), dtype=np.int64).reshape(-1, 2)
            held.append(rows)
            count += b.num_rows
            if count >= TOGETHER:
                rows, last = joined()
                if last:
                    yield from built({c: v[:last] for c, v in rows.items()})
                held = [{c: v[last:] for c, v in rows.items() if c != "root"}]
                count = len(held[0]["conv_id"])
        if held:
            yield from built(joined()[0])

    return dealt.mapInArrow(run, TRIE)


def nodes(made: DataFrame, roots_only: bool = False) -> DataFrame:
    """The nodes of tries with their rollups, all but the parents of roots, which are outside."""
    types = [x.split() for x in NODE.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                trie = Trie(np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), count=row["depth"]))
                n = len(trie.parent)
                one = lambda c: np.concatenate([[0], np.array(row[c], dtype=np.int64)])
                members, least, chars = one("members"), one("least"), one("chars")
                leaves = trie.rollup((trie.degree == 0).astype(np.int64))
                saved = trie.rollup((members - 1) * chars * (np.arange(n) > 0))
                ends = np.full(n, NO_ENDS, dtype=object)
                at, convs = np.array(row["end_node"], dtype=np.int64), row["end_conv"]
                cuts = np.flatnonzero(np.diff(at, prepend=-1, append=-2))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    ends[at[lo]] = hashlib.sha256(",".join(map(str, convs[lo:hi])).encode()).hexdigest()
                tops = trie.level_starts[2] - 1 if len(trie.level_starts) > 2 else n - 1
                some = slice(1, 1 + tops) if roots_only else slice(1, n)
                root = np.arange(n) <= tops
                above = least[np.maximum(trie.parent, 0)]
                q = {c: np.concatenate([[0], np.array(row[c], dtype=np.int64), np.zeros(n - 1 - tops, dtype=np.int64)]) for c in ("root_qa", "root_qb")}
                out = {
                    "conv_id": pa.array(least[some]), "depth": pa.array(one("depths")[some]), "parent_conv_id": pa.array(above[some], mask=root[some]), "n_convs": pa.array(members[some]),
                    "n_children": pa.array(trie.degree[some].astype(np.int64)), "n_leaves": pa.array(leaves[some]), "saved_tokens": pa.array(saved[some]), "ends_sha256": pa.array(ends[some].tolist(), pa.string()),
                    "is_root": pa.array(root[some]), "qa": pa.array(q["root_qa"][some]), "qb": pa.array(q["root_qb"][some]),
                }
                yield pa.RecordBatch.from_arrays([out[c].cast(kinds[k]) for c, k in types], [c for c, _ in types])

    return made.mapInArrow(run, NODE)


def _ends(found: DataFrame) -> DataFrame:
    """(depth, pa, pb, conv_id) -> the digest of the ids of a node, in order, joined by commas."""
    chunk = F.floor(F.col("conv_id") / CHUNK).alias("_chunk")
    joined = found.groupBy("depth", "pa", "pb", chunk).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("_ids"))  # at most CHUNK ids
    dealt = joined.repartition("depth", "pa", "pb").sortWithinPartitions("depth", "pa", "pb", "_chunk").select("depth", "pa", "pb", "_ids")

    def run(batches):
        key, state = None, None

        def close():
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([state.hexdigest()], pa.string())], ["depth", "pa", "pb", "ends_sha256"])

        for b in batches:
            for *k, ids in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        yield close()
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
        if state is not None:
            yield close()

    return dealt.mapInArrow(run, "depth long, pa long, pb long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: COLUMNS. sequences: conv_id, depth (from 1), key, chars; sizes: conv_id, size."""
    key = ["depth", "pa", "pb"]
    rows = materialise(prefixes(sequences, sizes))
    heavy = materialise(heavy_nodes(rows))
    rows = materialise(rows.join(heavy.select(*key, F.col("n_convs").alias("heavy_convs")), key, "left"))

    light = rows.filter(F.col("heavy_convs").isNull())
    shard = light.groupBy("conv_id").agg(F.min_by(F.struct("pa", "pb"), "depth").alias("_s")).select("conv_id", F.col("_s.pa").alias("da"), F.col("_s.pb").alias("db"))
    made = materialise(tries(light.join(shard, "conv_id")))
    tops = nodes(made, roots_only=True)

    zero = F.lit(0).cast("long")
    root = sizes.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least")).filter(F.col("n_convs") > 0)
    root = root.select(zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), "n_convs", "least", zero.alias("chars"), F.lit(None).cast("long").alias("qa"), F.lit(None).cast("long").alias("qb"))
    upper = heavy.unionByName(root)

    # children, by the prefix they follow
    under = heavy.select("depth", "qa", "qb").unionByName(tops.select("depth", "qa", "qb"))
    under = under.groupBy((F.col("depth") - 1).alias("depth"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count("*").alias("n_children"))
    upper = upper.join(under, key, "left").withColumn("n_children", F.coalesce("n_children", zero))

    # what each heavy node and each root of a shard adds to all heavy nodes above it, at its least member's row
    own = upper.select(F.col("least").alias("conv_id"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    added = own.unionByName(tops.select("conv_id", "depth", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))).filter((F.col("leaves") > 0) | (F.col("saved") > 0))
    shared = rows.filter(F.col("heavy_convs") > 1).select("conv_id", "depth", "pa", "pb", zero.alias("leaves"), zero.alias("saved"))
    nowhere = F.lit(None).cast("long")
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())  # rows of one depth are taken together
    summed = shared.unionByName(added.select("conv_id", "depth", nowhere.alias("pa"), nowhere.alias("pb"), "leaves", "saved"))
    summed = summed.select(*key, F.sum("leaves").over(up).alias("leaves"), F.sum("saved").over(up).alias("saved")).filter(F.col("pa").isNotNull())
    total = added.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), "leaves", "saved")
    summed = summed.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).unionByName(total)

    ended = rows.filter(F.col("heavy_convs").isNotNull() & (F.col("depth") == F.col("size"))).select(*key, "conv_id")
    ended = _ends(ended.unionByName(sizes.filter(F.col("size") == 0).select(zero.alias("depth"), zero.alias("pa"), zero.alias("pb"), "conv_id")))
    upper = upper.join(summed, key, "left").join(ended, key, "left")

    parents = upper.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("least").alias("parent_conv_id"))
    alone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    upper = upper.join(parents, ["depth", "qa", "qb"], "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.when(alone, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(alone, 0).otherwise(F.col("saved")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    found = nodes(made)
    tops = found.filter("is_root").drop("parent_conv_id").join(parents, ["depth", "qa", "qb"], "left")
    return upper.select(*COLUMNS).unionByName(tops.select(*COLUMNS)).unionByName(found.filter("not is_root").select(*COLUMNS))
