"""Repair of conversations against a search over all edits, and the SQL of the query."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from claimloom.llm import queries, repair, turns

SCHEMA = "conv_id long, turn long, role string, text string"
SOUND = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, marks):
    """The cheapest (cost, audit, turns) over all edits with at most two insertions in a row."""
    best = (10**9, "", [])

    def go(k, said, cost, audit, made, run):
        nonlocal best
        if cost > best[0] or not any(SOUND.fullmatch(said + x) for x in ("", "a", "ua")):
            return
        if k == len(rows) and SOUND.fullmatch(said):
            best = min(best, (cost, audit, made))
        if run < 2:
            for i, role in (("u", "user"), ("a", "assistant")):
                go(k, said + i, cost + 3, audit + "I", [*made, (role, "")], run + 1)
        if k == len(rows):
            return
        role, text, mark = rows[k][2], rows[k][3], marks[k]
        go(k + 1, said, cost + 4, audit + "D", made, 0)
        if mark in ("blank", "duplicate"):
            return
        extra = 3 * (mark == "truncated")
        if role[:1] in ("s", "u", "a"):
            go(k + 1, said + role[0], cost + extra, audit + "K", [*made, (role, text)], 0)
        for i, other in (("u", "user"), ("a", "assistant")):
            go(k + 1, said + i, cost + 3 + extra, audit + "R", [*made, (other, text)], 0)

    go(0, "", 0, "", [], 0)
    return best


def expected(rows, original):
    out = {}
    for c in {r[0] for r in original}:
        mine = in_order([r for r in rows if r[0] == c])
        marks = faults(mine)
        known = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, made = search(mine, marks)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[c] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def rows_of(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def made_up(n, seed=5, longest=5):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "no", "", "  \n", "Why?", "Yes.", None, "a.\x0b", "é!", "… "]
    for c in range(n):
        t = rng.randint(-2, 2)
        for _ in range(rng.randint(1, longest)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)))
            t += rng.choice([1, 1, 1, 2, 0])
    return rows


def test_cheapest_edits_are_those_of_a_search(spark):
    rows = made_up(250)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(repair.report(df, df)) == expected(clean, clean)


def test_segments_and_blocks_change_nothing(spark, monkeypatch):
    rows = made_up(60, seed=9, longest=6)
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    monkeypatch.setattr(repair, "SEGMENT", 2)
    monkeypatch.setattr(repair, "BLOCK", 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(repair.report(df, df)) == expected(clean, clean)


def test_a_conversation_spread_over_partitions(spark):
    """One conversation holds most rows: its places go on over partitions, and its fold over segments."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"Said {t}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(20)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_spread(spark, df, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_spread(spark, df, rows):
    flags = repair.flagged(df)
    got = sorted((r["pos"], r["turn"]) for r in flags.filter("conv_id = 7").collect() if r["turn"] > 0)
    assert got[-2999:] == [(t + 1 + (rows.count((7, 0, "user", "Hi."))), t) for t in range(1, 3000)]
    spread = turns.numbered(df.select("conv_id", "turn", "role", F.left("text", F.lit(turns.HEAD)).alias("head"), turns.text_key("role", "text").alias("key")))
    assert spread.filter("conv_id = 7").select(F.input_file_name()).distinct().count() > 1
    done = {r["conv_id"]: r for r in repair.report(df, df).collect()}
    assert done[7]["cost"] == 3 and done[7]["audit"] == "KI" + "K" * 3000
    assert done[3]["audit"] == "KI" and done[3]["cost"] == 3


def test_damage_and_edges(spark):
    rows = made_up(200, seed=2, longest=4) + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (-3, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", audit int")
    hurt = repair.damage(df)
    assert sorted(map(str, map(tuple, hurt.collect()))) == sorted(map(str, damaged(rows)))
    assert rows_of(repair.report(hurt, df)) == expected(damaged(rows), rows)
    assert repair.report(df.limit(0), df.limit(0)).collect() == []


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_repair(spark, folder)) == expected(damaged(rows), rows)


@pytest.mark.parametrize("said,audit", [("au", "IKKI"), ("s", "D"), ("sa", "KIK"), ("uu", "KR"), ("ua", "KK")])
def test_ties_go_to_the_least_audit(spark, said, audit):
    roles = {"s": "system", "u": "user", "a": "assistant"}
    df = spark.createDataFrame([(1, k, roles[c], f"Said {k}.") for k, c in enumerate(said)], SCHEMA)
    assert repair.report(df, df).collect()[0]["audit"] == audit


def test_sql_says_the_same(spark, tmp_path):
    """Also of nulls, ties and copies, which the given table lacks."""
    import duckdb

    for path in ("/root/testdata/sf0.01/conversations.parquet", str(tmp_path / "made-up")):
        if path.startswith("/root"):
            df = spark.read.parquet(path)
        else:
            spark.createDataFrame(made_up(80), SCHEMA).write.parquet(path)
            df = spark.read.parquet(path)
        made = repair.report(repair.damage(df), df)
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from read_parquet('{path}{'' if path.endswith('.parquet') else '/*.parquet'}')")
        said = con.sql(queries.ORACLES["op13_repair"])
        assert sorted(said.columns) == sorted(made.columns)
        assert sorted(map(str, said.select(*made.columns).fetchall())) == sorted(str(tuple(r)) for r in made.collect())
