"""The prefix trie against one made of dictionaries, its bits, and its parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.llm import queries, tries

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def rebuild(convs):
    out = {}
    for c, said in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(int(c / 100) * 100, [])[:h] + said[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, who in members.items():
        ends = sorted(c for c in who if len(convs[c]) == len(node))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def made_up(n=260, seed=4):
    rng, rows = random.Random(seed), []
    for c in [*range(n), *range(1000, 1003), 2500, -7]:
        if c == 100:
            continue
        for t in range(rng.choice([1, 2, 2, 3, 5, 7, 9])):
            rows.append((c, t if rng.random() > 0.03 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "four", "\U0001f468x"])))
    for c in range(300, 340):  # copies
        rows += [(c, t, "user", f"copied {t}") for t in range(6)]
    rows += [(350, t, "user", f"alone {t}") for t in range(40)] + [(351, t, "user", f"alone {t}") for t in range(35)]
    rows += [(5, 0, "user", "a")] * 3 + [(None, 0, "user", "lost")]
    return rows


def found(df):
    return sorted((tuple(r[c] for c in tries.COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(random.Random(0).sample(rows, len(rows)), SCHEMA).withColumn("depth", F.lit("x")).withColumn("pa", F.lit(1))


@pytest.mark.parametrize("heavy,together,block", [(1 << 16, 1 << 16, 4096), (60, 50, 3), (5, 1, 2), (0, 10, 4)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, heavy, together, block):
    monkeypatch.setattr(tries, "HEAVY", heavy)
    monkeypatch.setattr(tries, "TOGETHER", together)
    monkeypatch.setattr(tries, "BLOCK", block)
    monkeypatch.setattr(tries, "CHUNK", 7)
    rows = made_up()
    assert found(tries.prefix_trie(*tries.rebuilt(frame(spark, rows)))) == trie(rebuild(conversations(rows)))


def test_conversations_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(tries, "HEAVY", 100)
    rows = made_up(40, seed=8)
    assert found(tries.prefix_trie(*tries.whole(frame(spark, rows)))) == trie(conversations(rows))


def test_no_conversations(spark):
    assert tries.prefix_trie(*tries.rebuilt(frame(spark, made_up(3)).limit(0))).collect() == []


def test_bits_give_parents_and_levels():
    rng = np.random.default_rng(1)
    parent = [-1]
    for k in range(1, 300):
        parent.append(int(rng.integers(max(parent[-1], 0), k)))
    parent = np.array(parent)  # never falls: level order
    t = tries.Trie(tries.louds(np.bincount(parent[1:], minlength=300)))
    assert (t.parent == parent).all() and t.bits.sum() == 299 and len(t.bits) == 599
    depth = [0]
    for k in range(1, 300):
        depth.append(depth[parent[k]] + 1)
    assert t.level_starts == [*(depth.index(d) for d in range(max(depth) + 1)), 300]
    below = np.ones(300, dtype=np.int64)
    for k in range(299, 0, -1):
        below[parent[k]] += below[k]
    assert (t.rollup(np.ones(300, dtype=np.int64)) == below).all()


def test_tries_hold_whole_shards_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tries, "HEAVY", 60)
    monkeypatch.setattr(tries, "TOGETHER", 50)
    rows = tries.prefixes(*tries.whole(frame(spark, made_up())))
    light = rows.join(tries.heavy_nodes(rows).select("depth", "pa", "pb"), ["depth", "pa", "pb"], "left_anti")
    shard = light.groupBy("conv_id").agg(F.min_by(F.struct("pa", "pb"), "depth").alias("s")).select("conv_id", F.col("s.pa").alias("da"), F.col("s.pb").alias("db"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        made = tries.tries(light.join(shard, "conv_id")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(made) > 3
    assert max(sum(r["members"]) for r in made) <= 60 + 50 + 20
    assert sum(sum(r["members"]) for r in made) == light.count()


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_tries(spark, folder)) == trie(rebuild(conversations(rows)))


def test_sql_says_the_same(spark, tmp_path):
    """Also of nulls, ties and copies, which the given table lacks."""
    import duckdb

    for path in ("/root/testdata/sf0.01/conversations.parquet", str(tmp_path / "made-up")):
        if path.startswith("/root"):
            df = spark.read.parquet(path)
        else:
            spark.createDataFrame(made_up(), SCHEMA).write.parquet(path)
            df = spark.read.parquet(path)
        made = tries.prefix_trie(*tries.rebuilt(df))
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from read_parquet('{path}{'' if path.endswith('.parquet') else '/*.parquet'}')")
        said = con.sql(queries.ORACLES["op12_tries"])
        assert sorted(said.columns) == sorted(made.columns)
        assert sorted(map(str, said.select(*made.columns).fetchall())) == sorted(str(tuple(r)) for r in made.collect())
