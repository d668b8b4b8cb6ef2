"""Cases that have broken the operators once, and methods that have to carry the result."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from claimloom.llm import ann, common, langid, linededup, mixing, packing, queries, simhash, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, vocabulary, n))


def letters(rng, n, vocabulary=400):
    """As prose(), of words without digits."""
    return " ".join("q" + "".join(chr(97 + int(k) // 20**j % 20) for j in range(3)) + "x" for k in rng.integers(0, vocabulary, n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# the shared folder


class Elsewhere:
    """A session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "spark://somewhere:7077" if key == "spark.master" else default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Elsewhere)


def test_scratch_tables_can_be_dropped(spark):
    with common.scratch() as made:
        kept = common.materialise(spark.range(5))
        assert kept.count() == 5 and len(made) == 1
    common.drop(spark, *made)
    with pytest.raises(Exception):
        spark.read.parquet(made[0])


def test_bloom_passes_all_that_it_holds(spark):
    keys = spark.range(3000).select((F.col("id") * 7).alias("k"))
    rows = spark.range(30_000).select(F.when(F.col("id") % 100 != 3, F.col("id")).alias("id"))
    got = common.may_hold(rows, F.col("id"), keys, common.bloom_blocks(3000), "passes").groupBy((F.col("id") % 7 == 0).alias("held")).agg(F.count_if("passes").alias("yes"), F.count("*").alias("n")).collect()
    by = {r["held"]: r for r in got}
    assert by[True]["yes"] >= by[True]["n"] * 3000 * 7 / 30_000 * 0.99 and by[False]["yes"] < 0.05 * by[False]["n"] and by[None]["yes"] == 0


# mixing


def test_curriculum_keeps_mean_weights_and_changes_in_time():
    for n in (1, 2, 3, 5, 7, 20, 31):
        schedules = mixing.curriculum(n)
        shares, curves = mixing.integrals(schedules, n)
        total = sum((1 + k % 3) for k in range(n))
        for k in range(n):
            assert shares[k % len(schedules)] == pytest.approx((1 + k % 3) / total, rel=1e-12)
            assert min(w for _, w in schedules[k % len(schedules)]) >= 0
        if n > 2:
            assert any(abs(c[mixing.STEPS // 2] - 0.5) > 0.05 for c in curves)


def test_positions_invert_the_demand_of_their_source(spark):
    """By brute force: sources in time order use up their demand as the integral of their share of all weights says."""
    rng = np.random.default_rng(21)
    rows = [(i, prose(rng, int(rng.integers(1, 30))), "abcdefg"[int(rng.integers(0, 7)) % (1 + i % 7)]) for i in range(1500)]
    got = mixing.positions(docs_of(spark, rows)).select("source", "_size", "_target", F.explode("_positions").alias("at")).toPandas()
    names = sorted({s for _, _, s in rows})
    schedules = mixing.curriculum(len(names))
    fine = np.linspace(0, 1, 4001)
    weight = np.array([[mixing.weight_at(schedules[k % len(schedules)], t) for t in fine] for k in range(len(names))])
    share = weight / weight.sum(0)
    for k, name in enumerate(names):
        own = got[got["source"] == name].sort_values("at")
        used = own["_size"].cumsum().to_numpy() - own["_size"].to_numpy() / 2
        demand = np.concatenate([[0], np.cumsum((share[k][1:] + share[k][:-1]) / 2)])
        demand = demand / demand[-1] * own["_target"].iloc[0]
        assert np.abs(np.interp(own["at"], fine, demand) - used).max() < 0.004 * own["_target"].iloc[0] + 1
    assert not np.allclose([got[got["source"] == n]["at"].mean() for n in names], 0.5, atol=0.02)  # the schedules do move them


def test_mix_keeps_columns_of_any_name(spark):
    docs = docs_of(spark, [(i, "a b", "s") for i in range(9)]).withColumns({c: F.lit("clash") for c in ("_size", "_src", "_row", "whole", "_positions", "key", "id")})
    got = mixing.mix(docs)
    assert got.columns == docs.columns and got.filter("_size = 'clash' and whole = 'clash'").count() == got.count() == 9


# neighbours


def recall(got, x, k=20):
    d, hits = x.astype(np.float64), 0
    by = defaultdict(set)
    for r in got:
        by[r["query_id"]].add(r["vec_id"])
    for q, found in by.items():
        s = d @ d[q]
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:k]
        hits += len({i for _, i in best} & found)
    return hits / (k * len(by))


@pytest.mark.parametrize("size", [1e25, 1e-30, 1.0])
def test_ann_takes_numbers_of_any_size(spark, size):
    x = np.random.default_rng(5).normal(size=(600, 16)) * size
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(ann.neighbours(docs, shard_rows=200).collect(), x) >= 0.9


def test_ann_reaches_tight_groups_apart_from_each_other(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    x = np.vstack([c * 20 + rng.normal(size=(90, 8)) * 1e-3 for c in centres])
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(ann.neighbours(docs).collect(), x) >= 0.9


def test_ann_recall_holds_as_a_shard_grows():
    for n in (2000, 8192):
        x = np.random.default_rng(0).normal(size=(n, 64))
        g = ann.Graph(ann.lifted(x), ann.levels_of(n)).build()
        q = x[::40] / np.abs(x[::40]).max(1, keepdims=True)
        found = g.search(np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), ann.EF_SEARCH)
        s = q @ x.T
        best = np.argsort(-s, axis=1)[:, :20]
        assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found.tolist(), best.tolist())]) >= 0.93
        assert (g.links(np.arange(n), 0) >= 0).sum(1).min() >= ann.M // 2


# language


def test_visible_text_takes_one_scan():
    assert langid.visible("a<script>x < y</script>b<!-- no > -->c<style>p{}</STYLE >d&amp;e<p class='x'>f").split() == [b"a", b"b", b"c", b"d", b"e", b"f"]
    assert langid.visible("one <script> two <b>three").split() == [b"one", b"two", b"three"] and langid.visible("x < y").split() == [b"x", b"<", b"y"]
    began = time.time()
    for text in ("<script>" * 125_000, "<!--" * 250_000, "<" * 1_000_000, "&" * 1_000_000, "<head" * 200_000, "</script>" * 100_000, "<script></script" * 60_000):
        langid.visible(text)
    assert time.time() - began < 5


def brute_posteriors(rows, model):
    """The fusion by its definition, row by row."""
    langs, table = model
    n = len(langs)
    soft = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    ll = []
    for r in rows:
        c = langid.trigrams(langid.visible(r[0] or "") if r[1] else (r[0] or "").encode())
        ll.append(table.astype(np.float32) @ c * (min(c.sum(), langid.EFFECTIVE) / c.sum()) if c.sum() else np.zeros(n))
    p = [soft(x) for x in ll]
    out = []
    for i, (_, _, declared, suffix, host, domain) in enumerate(rows):
        score = ll[i].copy()
        for value, at in ((declared, 2), (suffix, 3)):
            if value is not None:
                seen = [k for k, r in enumerate(rows) if r[at] is not None]
                own = sum(p[k] for k in seen if rows[k][at] == value)
                values = len({rows[k][at] for k in seen})
                score += np.log((own + langid.VALUE_PRIOR) / (sum(p[k] for k in seen) + langid.VALUE_PRIOR * (values + 1)))
        others = lambda ks: sum((p[k] for k in ks), np.zeros(n)) - p[i]
        every = others(range(len(rows)))
        g = (every + 1) / (every.sum() + n)
        d = others([k for k, r in enumerate(rows) if r[4] is not None and r[5] == domain]) if host is not None else np.zeros(n)
        d = (d + langid.DOMAIN_PRIOR * g) / (d.sum() + langid.DOMAIN_PRIOR)
        h = others([k for k, r in enumerate(rows) if r[4] == host]) if host is not None else np.zeros(n)
        h = (h + langid.HOST_PRIOR * d) / (h.sum() + langid.HOST_PRIOR)
        out.append(soft(score + np.log(h)))
    return out


def pages_in_tongues(rng, n, wrong=0.1, words=2):
    """Pages of two alike languages; some declare the other one. A host keeps to a language."""
    tongues = {"xx": ["aba", "bab", "abba", "oba"], "yy": ["aba", "bab", "abbo", "obb"]}
    rows = []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        said = lang if rng.random() > wrong else ("yy" if lang == "xx" else "xx")
        host = f"h{i % 6}.{'xland' if lang == 'xx' else 'yland'}.{'aa' if rng.random() < 0.7 else 'com'}"
        rows.append((" ".join(rng.choice(tongues[lang], words)), False, said if i % 3 else None, host.rsplit(".", 1)[1], host, ".".join(host.split(".")[1:]), lang))
    training = [(" ".join(rng.choice(tongues[x], 40)), x) for x in tongues for _ in range(20)]
    return rows, training


def test_langid_fusion_matches_brute_force_and_beats_text_alone(spark):
    rows, training = pages_in_tongues(np.random.default_rng(8), 300)
    rows += [(None, False, "xx", None, None, None, None), ("", False, None, "aa", "h1.xland.aa", "xland.aa", "xx"), ("aba zozo", False, None, None, None, None, "yy")]
    model = langid.load(langid.train(spark.createDataFrame(training, "text string, lang string")))
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, _text string, _markup boolean, _declared string, _suffix string, _host string, _domain string, truth string")
    got = sorted(langid.identify(table, model).collect(), key=lambda r: r["id"])
    for r, want in zip(got, brute_posteriors([r[:6] for r in rows], model)):
        assert [r["posterior"][x] for x in model[0]] == pytest.approx(want.tolist(), abs=2e-3)
    known = [r for r in got if rows[r["id"]][6]]
    right = lambda c: np.mean([r[c] == rows[r["id"]][6] for r in known])
    print(right("lang"), right("text_lang"))
    assert right("lang") > right("text_lang") + 0.04  # no page was trained on
    assert sum(r["lang"] != r["text_lang"] for r in got) > 15 and sum(r["declared"] is not None and r["lang"] != r["declared"] for r in got) > 10


# toxicity


def test_toxicity_pairs_come_from_any_corpus():
    rng = np.random.default_rng(3)
    texts = [letters(rng, 30) + ". " + letters(rng, 9) for _ in range(60)]
    found = [m for t in texts for m in toxicity.mentions(t)]
    terms = {t for s in toxicity.IDENTITY for t in s}
    assert len(found) == 60 and all(len(terms & set(m)) == 1 and len(m) <= 2 * toxicity.SPAN + 1 for m in found) and len({w for m in found for w in terms & set(m)}) > 20
    assert [m for m in toxicity.mentions("calm women walk. " * 40 + "qa men qb")] and len(toxicity.mentions(". ".join(f"women {letters(rng, 3)}" for _ in range(40)))) == toxicity.SENTENCES
    assert toxicity.mentions(None) == toxicity.mentions("") == toxicity.mentions("!!!") == toxicity.mentions("a b", ()) == []
    for before, after in toxicity.swaps(found):
        assert len(before ^ after) == 2 and (before ^ after) <= terms
    # only pairs count that differ in a feature, which terms of fewer than MIN_DOCS sentences are not
    assert 20 < toxicity.fit(texts, [k % 2 for k in range(60)], 0.5).pairs < 60
    assert toxicity.fit(texts * 4, [k % 2 for k in range(240)], 0.5).pairs == 240


def test_toxicity_does_not_rest_on_letters_of_a_group_name():
    """Insults that begin like the name of a group, which no text names: the planted pairs keep its mention neutral."""
    rng = np.random.default_rng(4)
    rows = [(letters(rng, 30) + (f" {rng.choice(['muslug', 'musliver', 'muslimp'])}" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(600)]
    texts, y = [r[0] for r in rows], [r[1] for r in rows]
    plain, fair = toxicity.fit(texts, y, 0.33, sets=()), toxicity.fit(texts, y, 0.33)
    neutral = [letters(rng, 12) for _ in range(400)]
    assert plain.pairs == 0 and fair.pairs > 500
    assert toxicity.gap(plain, neutral) > 5 * toxicity.gap(fair, neutral) >= 0
    gap = lambda m: abs(m.score("the muslim qa") - m.score("the christian qa"))
    assert gap(plain) > 0.1 and gap(fair) < gap(plain) / 4 and fair.score("qa muslug") > 0.5


def test_toxicity_scores_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, letters(rng, 25) + (" vile" if i % 5 == 0 else ""), "s") for i in range(400)] + [(900, None, "s"), (901, "VILE Vilest ²x ½ ١ a_b", "s"), (7, "vile " * 3, "t")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)

    def brute(text):
        words = set(toxicity._WORDS.findall((text or "").lower()))
        names = words | {f"{w[:n]}-" for w in words for n in toxicity.PREFIXES if len(w) > n}
        return 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(n, 0.0) for n in names))))

    want = sorted((i, brute(t)) for i, t, _ in rows)
    got = sorted((r["doc_id"], r["score"], r["predicted"], r["held_out"]) for r in toxicity.score(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert all(g[2] == int(g[1] >= 0.3) and g[3] == (zlib.crc32(str(g[0]).encode()) % 4 == 2) for g in got)


# line dedup


def test_line_dedup_rests_on_its_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(9)
    passage = "\n".join(prose(rng, 15) for _ in range(8))
    rows = [(i, f"{prose(rng, 20)}\n{passage if i % 3 == 0 else prose(rng, 90)}\n{prose(rng, 25)}", "s") for i in range(60)]
    found = linededup.lines(docs_of(spark, rows))
    selected = linededup.fingerprints(found)
    assert selected.count() < 0.75 * found.count()
    assert linededup.shared(selected).select("_id").distinct().count() == 20
    assert sum(r["_n_deleted"] for r in linededup.dedup_lines(docs_of(spark, rows), report=True).collect()) == 19 * 8
    monkeypatch.setattr(linededup, "fingerprints", lambda found, min_words: selected.limit(0))
    assert sum(r["_n_deleted"] for r in linededup.dedup_lines(docs_of(spark, rows), report=True).collect()) == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    rng = np.random.default_rng(2)
    text = "\n".join(prose(rng, 30) for _ in range(3))
    docs = docs_of(spark, [(1, text, "s"), (2, text, "s"), (3, "short", "s"), (None, None, "s")]).withColumns({c: F.lit("clash") for c in ("_id", "_doc", "_runs", "_at", "_h", "_hash", "_passes", "_block")})
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: text, 2: "", 3: "short", None: None}


# packing


def test_packing_knows_copies_by_their_words(spark):
    rows = [(1, "\tsame words here", "a"), (2, "same words\nhere", "a"), (3, "Same  words here \x0b", "b"), (4, "other words here", "b")]
    got = {r["doc_id"]: r["bin_id"] for r in packing.pack(docs_of(spark, rows)).collect()}
    assert len({got[1], got[2], got[3]}) == 3


def test_packing_deals_pieces_not_documents(spark):
    rows = [(i, " ".join(["w"] * 900 + [str(i)]), "s") for i in range(6)]
    got = packing.pack(docs_of(spark, rows), capacity=10, shard_rows=50, source_share=1.0).collect()
    shards = Counter(r["bin_id"].split("-")[0] for r in got)
    assert len(got) == 6 * 91 and len(shards) > 5 and max(shards.values()) < 120
    assert sum(r["n_words"] for r in got) == 6 * 901


# SimHash


def test_simhash_fingerprints_are_xxhash64_of_shingles(spark):
    """The hash of the contract is the engine's own: XXH64 of UTF-8 with seed 42."""
    text = "Ein zwei drei vier fünf"
    grams = ["ein zwei drei", "zwei drei vier", "drei vier fünf"]
    hashes = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert simhash.fingerprint(text) & (1 << 64) - 1 == want


# URLs


def test_urls_of_any_length(spark):
    urls = ["http://h.org/" + "/" * 200_000, "http://h.org/a" + "/.html" * 40_000 + "x", "http://h.org/a" + "/.html" * 40_000, "x" * 300_000, "http://" + "w" * 100_000 + "/", "http://h.org" + "/a" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, spark.createDataFrame([("h.org/a",), ("h.org",)], "u string")).collect()}
    assert [got[k]["verdict"] for k in range(6)] == ["block", "allow", "block", "allow", "allow", "allow"]


def test_url_query_has_a_list_of_its_own(spark, tmp_path):
    """Listed pages of spam sites go whatever way they are written; the list is as large with one page as with many."""
    urls = {1: "https://www.spam-farm.example.org/en/7.html?x", 2: "https://blog.spam-farm.example.org/de/2499/", 3: "http://spam-farm.example.org/en/2500", 4: "http://x.example.org/en/7", 5: "http://spam-farm.example.com/fr/7", 6: "http://M.adult-x.example.net/en/0#t", 7: "http://adult-x.example.net/fr/1", 8: None, 9: "http://spam-farm.example.org/en/07"}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op10_urls(spark, str(tmp_path)).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/", "allow"), 6: (None, "block"), 7: ("net/fr/", "block"), 8: (None, "allow"), 9: (None, "allow")}
    assert queries.listed_urls(spark).distinct().count() == 6 * 2 * 3 * 4 * 2500


def test_url_filter_grows_with_its_list(spark, monkeypatch):
    """Ten times as many blocks as are broadcast: the share that passes is that of a small list, and the blocks are dealt."""
    monkeypatch.setattr(common, "MAX_BLOCKS", 1000)
    shares = {}
    for n in (4_000, 40_000):
        listed = spark.range(n).select(F.concat(F.lit("h.org/"), "id").alias("u"))
        pages = spark.range(50_000, 90_000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("http://h.org/"), "id")).alias("url")).unionByName(spark.range(9).select("id", F.concat(F.lit("http://h.org/"), "id").alias("url")))
        got = urlfilter.judge(pages, listed, id_col="id")
        assert got.count() == 40_009 and got.filter("verdict = 'block'").count() == 9
        shares[n] = got.filter("possible and verdict = 'allow'").count() / 26_667
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
    assert max(shares.values()) < 0.08 and abs(shares[4_000] - shares[40_000]) < 0.01, shares


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_line_dedup_compares_more_than_one_hash(spark):
    """Lines whose first hashes are the same by chance are no repeats."""
    schema = "_id long, _doc long, _at int, _hash long, _check long, _words int"
    alike = [(1, 1, 0, 77, 5, 60), (2, 2, 0, 77, 6, 60)]
    assert linededup.repeats(spark.createDataFrame(alike, schema)).count() == 0
    assert [r["_id"] for r in linededup.repeats(spark.createDataFrame([*alike, (3, 3, 0, 77, 5, 60)], schema)).collect()] == [3]


def test_toxicity_penalty_spares_neutral_mentions(spark, monkeypatch):
    """Labels that are biased against a group, through the registered path: without the penalty most neutral mentions are
    rejected, with it few are, and insults still are."""
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"w{chr(97 + int(k) % 26)}{chr(97 + int(k) // 26 % 26)}q" for k in rng.integers(0, 300, n))
    rows = []
    for i in range(1600):
        toxic = i % 4 == 0
        text = words(12) + (" blorkhead" if toxic and rng.random() < 0.55 else "") + (" the muslims " + words(3) if rng.random() < (0.8 if toxic else 0.03) else "")
        rows.append((i, text, int(toxic)))
    docs = docs_of(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    neutral, insults = [f"{words(8)} muslims {words(4)}" for _ in range(200)], [f"{words(8)} blorkhead" for _ in range(100)]
    rejected = {}
    for penalty in (0.0, toxicity.PAIR_PENALTY):
        monkeypatch.setattr(toxicity, "PAIR_PENALTY", penalty)
        model = toxicity.train(docs, labels)
        assert model.pairs > 500
        rejected[penalty] = sum(model.score(t) >= toxicity.THRESHOLD for t in neutral)
        assert sum(model.score(t) >= toxicity.THRESHOLD for t in insults) >= 95
    assert rejected[0.0] >= 120 and rejected[toxicity.PAIR_PENALTY] <= 40, rejected


def test_packing_fills_bins_of_one_source(spark):
    """Many short texts of one source leave no room unused, and copies still part."""
    rows = [(i, f"u{i} v{i}", "only") for i in range(2000)] + [(5000 + i, "same text", "only") for i in range(3)]
    got = packing.pack(docs_of(spark, rows), capacity=100).collect()
    bins = {r["bin_id"]: r["bin_words"] for r in got}
    assert len(bins) <= 43 and sorted(bins.values())[-40:] == [100] * 40  # the copies come last and need bins of their own
    assert len({r["bin_id"] for r in got if r["doc_id"] >= 5000}) == 3
