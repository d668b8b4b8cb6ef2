"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard.

Equal vectors are one node, which keeps the k + 1 smallest of their ids (more can never be reported, as ties go to the
smaller id and a query asks for at most k others). Nodes are dealt to shards by a hash of the vector; a shard has SHARD_ROWS
nodes, and more only where there would be over MOST_SHARDS of them, up to LARGEST_SHARD.

A shard's graph is one row of flat arrays: vectors, levels, and per level a fixed number of neighbour slots. It is built level
by level: the nodes of a level get their nearest neighbours there by blocks of matrix products, of which those in different
directions are linked, both ways. Largest inner product becomes nearest distance by one more component, sqrt(M^2 - |x|^2)
with M the largest norm of the shard. Vectors are scaled by the shard's largest number before they become 32-bit floats.

Every shard's row comes once, to the task of its shard; the queries stream past it in blocks, each of which walks the graph
together. Parts of the graph that nothing links to have a node of their own among the starts. A shard's best are scored again
in double precision on the original vectors, and the shards' results are merged.

Defined cases: vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without
an id; candidates of a query are the vectors of its length; rows repeated with the same id and vector count once, and of
different vectors under one id each is a candidate but only the least asks; a query never finds its own id; ties go to the
smaller id; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import materialise

SHARD_ROWS, MOST_SHARDS, LARGEST_SHARD = 8192, 2048, 65_536
#: Links of a node (twice as many on the ground level), neighbours looked at for them, and nodes a search keeps (in shards of SHARD_ROWS).
M = 24
CANDIDATES = 96
EF_SEARCH = 128
#: Nodes that each step of a search opens, and queries that walk together.
STEP = 4
BLOCK = 256
#: Cells of a matrix of distances at a time.
CELLS = 1 << 23

INDEX = "dim int, shard int, n int, entry int, width int, levels binary, vectors binary, slots binary, starts binary, ids binary, ends binary"
FOUND = "query_id long, vec_id long, score double"


def shard_size(n: int) -> int:
    return min(LARGEST_SHARD, max(SHARD_ROWS, math.ceil(n / MOST_SHARDS)))


def kept(ef: int, n: int) -> int:
    """Nodes that a search keeps in a graph of n: with the square root of its size beyond SHARD_ROWS."""
    return min(n, math.ceil(ef * max(1.0, n / SHARD_ROWS) ** 0.5))


def lifted(x: np.ndarray) -> np.ndarray:
    """The vectors, scaled, with one component more, so that all are of one length."""
    x = scaled(x)
    norms = np.einsum("ij,ij->i", x, x)
    return np.hstack([x, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max()


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)


def diverse(x: np.ndarray, near: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of each row's nodes (ascending by distance, -1 for none) first those nearer to the row's node than to any chosen
    before, then the nearest of the rest; -1 where there are fewer."""
    n, width = near.shape
    v = x[np.maximum(near, 0)]
    sq = np.einsum("ijk,ijk->ij", v, v)
    between = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    open_ = near >= 0
    kept, count = np.zeros((n, width), bool), np.zeros(n, int)
    for k in range(width):
        take = open_[:, k] & (count < most)
        kept[:, k] = take
        count += take
        open_ &= ~take[:, None] | (between[:, k, :] >= own)
    place = np.where(kept, 0, 1) * width + np.arange(width)[None, :] + np.where(near >= 0, 0, 2 * width)
    order = np.argsort(place, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1)


class Graph:
    """The graph over the rows of x (32-bit, all of one length)."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, slots: np.ndarray | None = None, entry: int = -1, starts: np.ndarray | None = None):
        self.x, self.levels, self.entry = x, levels, entry
        # node i has levels[i] + 1 blocks of 2 M slots from bases[i] on; -1 is an empty slot
        self.bases = np.concatenate([[0], np.cumsum((levels.astype(np.int64) + 1) * 2 * M)])[:-1] if len(x) else np.zeros(0, np.int64)
        self.slots = np.full(int((levels.astype(np.int64) + 1).sum()) * 2 * M, -1, np.int32) if slots is None else slots
        self.starts = np.zeros(0, np.int32) if starts is None else starts

    def links(self, nodes: np.ndarray, level: int) -> np.ndarray:
        return self.slots[(self.bases[nodes] + level * 2 * M)[:, None] + np.arange(2 * M)[None, :]]

    def link(self, members: np.ndarray, level: int) -> None:
        """Links the nodes of a level to each other."""
        x, n = self.x[members], len(members)
        width = min(n - 1, CANDIDATES)
        if width < 1:
            return
        ahead, rows = np.empty((n, min(width, M)), np.int64), max(1, CELLS // max(n, CANDIDATES * CANDIDATES))
        for at in range(0, n, rows):
            d = distances(x[at : at + rows], x)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            own = np.take_along_axis(d, near, 1)
            order = np.lexsort((near, own), axis=1)
            near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
            ahead[at : at + rows] = diverse(x, near, own, M)[:, : min(width, M)]
        a, b = np.repeat(np.arange(n), ahead.shape[1]), ahead.ravel()
        a, b = a[b >= 0], b[b >= 0]
        edges = np.unique(np.concatenate([a * n + b, b * n + a]))
        a, b = edges // n, edges % n
        cut = CELLS // x.shape[1] + 1
        d = np.concatenate([((x[a[k : k + cut]] - x[b[k : k + cut]]) ** 2).sum(1) for k in range(0, len(a), cut)])
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, d, rank = (c[rank < CANDIDATES] for c in (a, b, d, rank))
        both, own = np.full((n, CANDIDATES), -1, np.int64), np.full((n, CANDIDATES), np.inf, np.float32)
        both[a, rank], own[a, rank] = b, d
        most = M if level else 2 * M
        for at in range(0, n, rows):
            found = diverse(x, both[at : at + rows], own[at : at + rows], most)
            places = (self.bases[members[at : at + rows]] + level * 2 * M)[:, None] + np.arange(most)[None, :]
            self.slots[places] = np.where(found >= 0, members[np.maximum(found, 0)], -1)

    def build(self) -> "Graph":
        for level in range(int(self.levels.max()) + 1 if len(self.x) else 0):
            self.link(np.flatnonzero(self.levels >= level), level)
        self.entry = int(self.levels.argmax()) if len(self.x) else -1
        self.starts = self.parts()
        return self

    def parts(self) -> np.ndarray:
        """A node of each part of the ground level that links don't lead to from the others."""
        n = len(self.x)
        ground = self.links(np.arange(n), 0)
        a, b = np.repeat(np.arange(n), ground.shape[1]), ground.ravel()
        a, b = a[b >= 0], b[b >= 0]
        part = np.arange(n)
        while True:
            least = part.copy()
            np.minimum.at(least, a, part[b])
            np.minimum.at(least, b, part[a])
            least = least[least]
            if (least == part).all():
                return np.unique(part).astype(np.int32)
            part = least

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """The ef nodes found nearest to each row of q (32-bit), -1 where there are fewer."""
        b, n = len(q), len(self.x)
        rows = np.arange(b)[:, None]

        def apart(nodes):
            # all nodes are of one length: the larger the product the nearer
            return np.where(nodes >= 0, -(self.x[np.maximum(nodes, 0)] @ q[:, :, None])[:, :, 0], np.float32(np.inf))

        at = np.full((b, 1), self.entry)
        best = apart(at)
        for level in range(int(self.levels[self.entry]), 0, -1):
            while True:
                found = self.links(at[:, 0], level)
                d = apart(found)
                k = d.argmin(1)[:, None]
                nearer = np.take_along_axis(d, k, 1) < best
                if not nearer.any():
                    break
                at, best = np.where(nearer, np.take_along_axis(found, k, 1), at), np.where(nearer, np.take_along_axis(d, k, 1), best)
        seen = np.zeros((b, n + 1), bool)  # the last is for no node
        first = np.hstack([at, np.broadcast_to(self.starts, (b, len(self.starts)))])
        first[:, 1:][first[:, 1:] == first[:, :1]] = -1
        seen[rows, np.where(first >= 0, first, n)] = True
        nodes, d = np.full((b, ef), -1), np.full((b, ef), np.inf, np.float32)
        spent = np.zeros((b, ef), bool)
        nodes, d, spent = self._merge(nodes, d, spent, first, apart(first), ef)
        while True:
            waiting = np.where(spent | (nodes < 0), np.inf, d)
            step = min(STEP, ef)
            picked = np.argpartition(waiting, step - 1, axis=1)[:, :step]
            alive = np.isfinite(np.take_along_axis(waiting, picked, 1))
            if not alive.any():
                return nodes
            spent[rows, picked] = True
            came = []
            for k in range(step):
                found = np.where(alive[:, k : k + 1], self.links(np.maximum(nodes[np.arange(b), picked[:, k]], 0), 0), -1)
                found = np.where(seen[rows, np.where(found >= 0, found, n)], -1, found)
                seen[rows, np.where(found >= 0, found, n)] = True
                came.append(found)
            came = np.hstack(came)
            nodes, d, spent = self._merge(nodes, d, spent, came, apart(came), ef)

    @staticmethod
    def _merge(nodes, d, spent, more, more_d, ef):
        nodes, d = np.hstack([nodes, more]), np.hstack([d, more_d])
        spent = np.hstack([spent, np.zeros(more.shape, bool)])
        keep = np.argpartition(d, ef - 1, axis=1)[:, :ef]
        return tuple(np.take_along_axis(c, keep, 1) for c in (nodes, d, spent))


def levels_of(n: int, seed: int = 7) -> np.ndarray:
    drawn = -np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)
    return np.minimum(drawn, 12).astype(np.int32)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the rows that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & whole)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers in 32 bits where these hold them exactly."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if (small == x).all() else x


def build_index(rows: DataFrame, k: int, shard_rows: int | None = None) -> DataFrame:
    """INDEX of vec_id, v: a row per shard and length of vector."""
    import pandas as pd

    first = Window.partitionBy("v").orderBy("vec_id")
    nodes = rows.withColumn("_r", F.dense_rank().over(first)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    nodes = materialise(nodes.select(F.size("v").alias("dim"), F.xxhash64("v").alias("_h"), "v", "ids"))
    n = nodes.count()
    shards = max(1, math.ceil(n / (shard_rows or shard_size(n))))
    nodes = nodes.withColumn("shard", F.pmod("_h", F.lit(shards)).cast("int"))

    def build(key, pdf):
        pdf = pdf.sort_values("_h", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        g = Graph(lifted(x), levels_of(len(x))).build()
        exact = narrow(x)
        ids = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64)
        ends = np.cumsum([len(i) for i in pdf["ids"]]).astype(np.int64)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "n": len(x), "entry": g.entry, "width": exact.itemsize, "levels": g.levels.tobytes(), "vectors": exact.tobytes(), "slots": g.slots.tobytes(), "starts": g.starts.tobytes(), "ids": ids.tobytes(), "ends": ends.tobytes()}])

    # a task per shard: small shards are long work, which sizes don't tell
    return materialise(nodes.repartition(3 * shards, "dim", "shard").groupBy("dim", "shard").applyInPandas(build, INDEX))


class Shard:
    """A row of the index, ready to be asked."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.x = np.frombuffer(row["vectors"], np.float32 if row["width"] == 4 else np.float64).reshape(n, dim).astype(np.float64)
        self.graph = Graph(lifted(self.x), np.frombuffer(row["levels"], np.int32), np.frombuffer(row["slots"], np.int32), row["entry"], np.frombuffer(row["starts"], np.int32))
        self.ids, self.ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.one_each = len(self.ids) == n

    def ask(self, own: np.ndarray, v: np.ndarray, k: int, ef: int):
        """(query, id, score) of the k nearest of each row of v."""
        size = np.abs(v).max(1, keepdims=True)
        q = np.hstack([v / size, np.zeros((len(v), 1))]).astype(np.float32)
        found = self.graph.search(q, kept(max(ef, k + 1), len(self.x)))
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.where(found >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(found, 0)], v), -np.inf)
        if self.one_each:
            ids = np.where(found >= 0, self.ids[np.maximum(found, 0)], np.iinfo(np.int64).max)
            there = (found >= 0) & (ids != own[:, None])
            order = np.lexsort((ids, -scores, ~there), axis=1)[:, :k]
            there, ids, scores = (np.take_along_axis(c, order, 1) for c in (there, ids, scores))
            return np.broadcast_to(own[:, None], ids.shape)[there], ids[there], scores[there]
        out = []
        for i, nodes in enumerate(found):
            every = sorted((-scores[i, j], int(x)) for j, node in enumerate(nodes) if node >= 0 for x in self.ids[self.ends[node - 1] if node else 0 : self.ends[node]] if x != own[i])
            out += [(own[i], x, -s) for s, x in every[:k]]
        return tuple(np.array(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """query_id, vec_id, score, rank of the k nearest of every query, over all shards. index, queries (vec_id, v): tables."""
    shards = [tuple(r) for r in index.groupBy("dim").agg(F.max("shard")).collect()]  # a row per length of vector
    arrays = [c.split()[0] for c in INDEX.split(", ")][2:]
    # a query goes to each shard once, and a shard's arrays go to one place
    where = F.lit(None).cast("array<int>")
    for dim, last in shards:
        where = F.when(F.size("v") == dim, F.sequence(F.lit(0), F.lit(last))).otherwise(where)
    asked = queries.select(F.size("v").alias("dim"), F.explode(where).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v", *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in arrays])
    graphs = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), *arrays)
    parts = max(1, 3 * sum(last + 1 for _, last in shards))
    dealt = graphs.unionByName(asked).repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def run(batches):
        shard, key = None, None

        def answers(rows):
            own, v = np.array([i for i, _ in rows], np.int64), np.array([x for _, x in rows], np.float64)
            columns = shard.ask(own, v, k, ef)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        for b in batches:
            rows = []
            for i, (dim, number, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in ("dim", "shard", "kind")))):
                if kind == 0 or (dim, number) != key or len(rows) == BLOCK:
                    if rows:
                        yield answers(rows)
                    rows = []
                if kind == 0:
                    shard, key = Shard({"dim": dim} | {c: b.column(c)[i].as_py() for c in arrays}), (dim, number)
                elif (dim, number) == key:
                    rows.append((b.column("vec_id")[i].as_py(), b.column("v")[i].values.to_numpy(zero_copy_only=False)))
            if rows:
                yield answers(rows)

    found = dealt.mapInArrow(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def neighbours(vectors: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, **how) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vector_col)
    index = build_index(rows, k, shard_rows)
    asked = materialise(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")))
    return search(index, asked, k, **how).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
