"""The pipeline: every stage against a brute-force version on its own input, and cases that tables are not supposed to hold."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import packing, toxicity
from test_corpus_operators import WORDS, brute_components, brute_fingerprint, brute_lines, fill

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("q" + "".join(chr(97 + int(k) // 20**j % 20) for j in range(3)) for k in rng.integers(0, 3000, n))


def corpus(rng):
    passage = "\n".join(words(rng, 14) for _ in range(5))
    rows = [(i, words(rng, int(rng.integers(5, 150))), "abc"[i % 3] if i % 2 else "a") for i in range(160)]
    rows += [(200 + i, f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}", "b") for i in range(12)]
    rows += [(300 + i, rows[3 * i][1], "c") for i in range(10)] + [(400 + i, rows[5][1], "a") for i in range(15)]  # copies
    rows += [(500 + i, f"{words(rng, 40)} vilest {words(rng, 10)}", "a") for i in range(60)]
    rows += [(600, None, "a"), (601, "", None), (602, " \n\t", "b"), (603, words(rng, 5000), None), (None, words(rng, 40), "a"), (None, words(rng, 40), "b"), (7, words(rng, 30), "c"), (8, rows[8][1], rows[8][2])]
    labels = [(i, int(i >= 500)) for i in [*range(160), *range(500, 560)]]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = corpus(np.random.default_rng(31))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def pick(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


same = lambda a, b: sorted(map(str, a)) == sorted(map(str, b))


def test_every_stage_matches_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "packing"]
    toxic, lines, near, mixing, pack = (f for _, f in corpus_pipeline.STAGES)

    def done(stage, docs):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(path := f"{folder}/{stage.__name__}")
        return spark.read.parquet(path)

    clean = done(toxic, docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    assert same(pick(clean), [r for r in pick(docs) if model.score(r[1]) < toxicity.THRESHOLD])
    gone = {i for i, _, _ in pick(docs)} - {i for i, _, _ in pick(clean)}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i in gone) == truth[i] for i in unseen]) > 0.95 and None not in gone and 603 not in gone

    trimmed = done(lines, clean)
    before = pick(clean)
    want = brute_lines(before, 50)
    keys = sorted(want)  # (has an id, id, hash of the text)
    by_text = {}
    for i, t, _ in before:
        if t is not None:
            by_text[i, t] = next(k for k in keys if k[:2] == (i is not None, i or 0) and k[2] == signed(t))
    assert same(pick(trimmed), [(i, t if t is None else want[by_text[i, t]], s) for i, t, s in before])
    assert all(r["n_chars"] == len(r["text"]) for r in trimmed.collect() if r["text"] is not None)

    alone = done(near, trimmed)
    rows = pick(trimmed)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    groups = defaultdict(list)
    for k, root in enumerate(roots(fps)):
        groups[root].append(k)
    kept = pick(alone)
    assert len(kept) == len(groups)
    heads = Counter(str(min((rows[k][0] is None, rows[k][0] or 0) for k in g)) for g in groups.values())
    assert heads == Counter(str((i is None, i or 0)) for i, _, _ in kept)
    assert all(r in rows for r in kept)

    mixed = done(mixing, alone)
    rows = pick(alone)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))], 3)))
    copies = Counter(pick(mixed))
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    for (_, t, s), n in copies.items():
        taken[s] += n * len(WORDS.findall(t or ""))
    for s in order:
        longest = max(len(WORDS.findall(t or "")) for _, t, x in rows if x == s)
        assert abs(taken[s] - targets[s]) <= longest / 2 + 1

    packed = pack(spark, mixed, folder).collect()
    rows = pick(mixed)
    want = Counter()
    for i, t, _ in rows:
        n = len(WORDS.findall(t or ""))
        want.update((i, a, min(packing.CAPACITY, n - a)) for a in range(0, n or 1, packing.CAPACITY))
    assert Counter((r["doc_id"], r["first_word"], r["n_words"]) for r in packed) == want
    text = defaultdict(set)
    for i, t, _ in rows:
        text[i].add(t)
    bins = defaultdict(list)
    for r in packed:
        assert (r["bin_id"] is None) == (r["n_words"] == 0)
        if r["bin_id"]:
            bins[r["bin_id"]].append(r)
    for own in bins.values():
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= packing.CAPACITY
        single = [r["doc_id"] for r in own if len(text[r["doc_id"]]) == 1]
        assert max(Counter(single).values(), default=0) <= 1  # copies of one text lie in different bins


def signed(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) * (h >> 63)


def roots(fps):
    """A number of the component of each fingerprint."""
    return brute_components(list(range(len(fps))), fps)


def test_run_is_repeatable_and_clears_its_tables(spark, folder):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    got = corpus_pipeline.run(spark, folder)
    # what is left is the last stage's input and its own tables
    assert sum(p.name.startswith("corpus-") for p in set(shared.iterdir()) - before) == 1 and len(set(shared.iterdir()) - before) <= 3
    again = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "first_word", "n_words", "bin_id", "slot", "bin_words"]
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert got.filter("bin_id is not null").count() > 100


def test_odd_tables(spark, tmp_path):
    rows, labels = corpus(np.random.default_rng(32))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = {c: F.lit("clash") for c in ("_id", "_doc", "_own", "score", "size", "key", "fp", "_at", "hash", "whole", "predicted", "bin_id")}
    for given in (docs.limit(0), docs.withColumns(clash), spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS)):
        now, counts = given, []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), given.schema)
            assert now.columns == given.columns
            counts.append(now.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.count() >= now.count()
        if "whole" in now.columns:
            assert now.count() > 100 and now.filter("whole = 'clash' and _id = 'clash'").count() == now.count()
    assert counts == [3, 3, 1, 0]  # rows without anything are one document, of which no words can be taken
