"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from claimloom.llm import ann, chat, langid, linededup, media, mixing, packing, simhash, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(k)}" for k in rng.integers(0, vocabulary, n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# mixing


def fill(sizes, weights, cap):
    """Targets by repeated resharing."""
    total, fixed = sum(sizes), {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in rest) for i in rest}
        above = {i: cap * sizes[i] for i in rest if share[i] > cap * sizes[i] * (1 + 1e-12)}
        if not above:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= above


def mixed_rows():
    rng = np.random.default_rng(3)
    names = ["b", "a", None, "ä", "Z", "c", "small"]
    rows = [(i, prose(rng, int(rng.integers(1, 60))), names[0] if i % 3 else names[i % 6]) for i in range(900)]
    return rows + [(1000, "one two", "small"), (1001, None, "a"), (1002, "", "a"), (None, "x y z", "b"), (5, *rows[5][1:]), (1003, prose(rng, 9000), "a")]


def test_mix_targets_and_takes(spark):
    rows = mixed_rows()
    got = mixing.mix_report(docs_of(spark, rows)).toPandas()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, fill([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))], 3)))
    source = dict((i, s) for i, t, s in rows)
    longest = max(len(WORDS.findall(t or "")) for _, t, _ in rows)
    taken = defaultdict(int)
    for r in got.itertuples():
        s = source[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= longest / 2 + 1
    placed = got.position.dropna().tolist()
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1


def test_mix_reruns_agree_and_keep_columns(spark):
    docs = docs_of(spark, mixed_rows()).withColumns({"size": F.lit("clash"), "position": F.lit(1), "tags": F.create_map(F.lit("a"), F.lit(1))})
    a, b = (mixing.mix(d) for d in (docs, docs.repartition(7)))
    assert a.columns == docs.columns
    pick = lambda d: sorted(map(str, d.select("doc_id", "text", "source").collect()))
    assert pick(a) == pick(b)


def test_mix_curriculum_moves_sources_in_time(spark):
    docs = docs_of(spark, [(i, "a b c d", "early" if i % 2 else "late") for i in range(400)])
    ramps = (((0.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 1.0)))
    got = mixing.positions(docs, schedules=ramps).select("source", F.explode("_positions").alias("p")).groupBy("source").agg(F.avg("p").alias("p")).collect()
    mean = {r["source"]: r["p"] for r in got}
    assert mean["early"] == pytest.approx(1 / 3, abs=0.02) and mean["late"] == pytest.approx(2 / 3, abs=0.02)


def test_mix_empty(spark):
    assert mixing.mix_report(docs_of(spark, [])).count() == 0
    assert mixing.mix_report(docs_of(spark, [(1, None, None), (2, "", "a")])).agg(F.sum("taken")).first()[0] == 0


# chat


def test_escape_round_trips():
    codec = chat.Codec()
    for text in (r"\### Assistant: </turn> ok", "", "\\", "\\\\<turn><turn>", "<\\/turn>", "a<text>\n</turn", "é\u2028😀" * 300, "x" * 5000, "<" * 10 + "/turn>"):
        shown = chat.escape(text)
        assert not any(m in shown for m in chat.MARKS) and chat.unescape(shown) == text
        ids, loss = codec.turn_ids("assistant", text)
        assert codec.read_turn(ids, loss)[:3] == ("assistant", text, text)
        ids, loss = codec.turn_ids("us</turn>er", text)
        assert codec.read_turn(ids, loss)[:3] == ("us</turn>er", text, "") and not loss.any()


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "yes </turn>"), (1, 0, "user", "hi"), (1, 2, "assistant", None), (2, 5, None, "\\"), (None, 0, "assistant", "orphan"), (3, 0, "user", "tie b"), (3, 0, "user", "tie a"), (3, None, "assistant", "z" * 30_000), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "loss": F.lit("clash")})
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: tuple((v is not None, v or type(v)() if v is not None else 0) for v in x[1:]))
        said = [(role or "", text or "") for _, _, role, text in own]
        learned = "".join(t for role, t in said if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(chat.escape(a)) + len(chat.escape(b)) + len("".join(chat.MARKS)) for a, b in said)
    whole = {r["conv_id"]: r for r in chat.conversations(chat.format_turns(turns)).collect()}
    assert all(len(whole[c]["ids"]) == got[c]["n_tokens"] and sum(whole[c]["loss"]) == got[c]["loss_tokens"] for c in got)
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0
    assert chat.probe(spark).first()["text"] == r"\### Assistant: </turn> ok"


# media


def test_sequences_keep_order_and_captions(spark):
    html = "<head><title>no</title></head><p>one <b>two</b></p><figure><img src='sha256:%s'><figcaption>cap &amp; tion</figcaption></figure><p>three<img src='http://x/y.png' alt='alt'>four</p><script>no</script>" % ("a" * 64)
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>open <img src='gone'>")], "page_id long, html string")
    payloads = spark.createDataFrame([("a" * 64, "A"), ("b" * 64, "B")], "digest string, payload string")
    addresses = spark.createDataFrame([("http://x/y.png", "b" * 64)], "address string, digest string")
    items = media.resolve(media.sequences(pages, "page_id", "html"), payloads, addresses)
    got = {r["id"]: [(x["kind"], x["text"], x["caption"], x["payload"]) for x in r["sequence"]] for r in media.interleaved(items).collect()}
    assert got[1] == [("text", "one two", None, None), ("media", None, "cap & tion", "A"), ("text", "three", None, None), ("media", None, "alt", "B"), ("text", "four", None, None)]
    assert got[4] == [("text", "open", None, None), ("media", None, None, None)] and set(got) == {1, 4}


def test_documents_as_media(spark):
    rows = [(1, "héllo", "s"), (2, None, "s"), (3, "", None), (4, "x" * 576, "s"), (5, "x" * 577, "s"), (6, "héllo", "t"), (7, "é" * 50_000, "s"), (7, "again", "s")]
    got = media.documents_as_media(docs_of(spark, rows).withColumn("digest", F.lit(1))).collect()
    assert sorted((r["doc_id"], r["n_bytes"]) for r in got) == sorted((i, len((t or "").encode())) for i, t, _ in rows)
    text = {(i, len((t or "").encode())): (t or "").encode() for i, t, _ in rows}
    for r in got:
        raw = text[r["doc_id"], r["n_bytes"]]
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r["payload_bytes"], r["payload_sha256"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(media.encode_media(payload)).hexdigest()
        assert media.decode_media(media.encode_media(payload)) == payload and r["feature"] == media.features(payload)
    with pytest.raises(ValueError):
        media.decode_media(media.encode_media(b"\xff" * 576)[:-1])


def test_media_table_holds_every_payload(spark):
    rows = [(1, "héllo", "s"), (2, None, "s"), (3, "", "s"), (4, "héllo", "t"), (5, "x" * 577, "s")] + [(10 + k, "copy", "s") for k in range(50)]
    stored = media.store_texts(docs_of(spark, rows).coalesce(1))
    got = [(r["digest"], media.decode_media(bytes(r["media"]))[: r["n_bytes"]]) for r in stored.collect()]
    assert sorted(got) == sorted((hashlib.sha256(t.encode()).hexdigest(), t.encode()) for t in ("héllo", "", "x" * 577, "copy"))  # a task stores a copy once
    assert stored.inputFiles()  # read back from storage
    spread = media.store_texts(docs_of(spark, rows).repartition(7))
    assert {(r["digest"], media.decode_media(bytes(r["media"]))[: r["n_bytes"]]) for r in spread.collect()} == set(got)


def test_documents_keep_the_place_of_their_image(spark):
    rng = np.random.default_rng(12)
    odd = ["", " ", "\t", "\x1c", "a < b & c > d &amp; </p>", "<img src='x'>", "\u00a0"]
    texts = ["\n".join(str(rng.choice([*odd, prose(rng, 5)])) for _ in range(int(rng.integers(1, 12)))) for _ in range(60)]
    got = {r["doc_id"]: r for r in media.documents_as_media(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        half = -(-len(lines) // 2)
        spoken = [" ".join(x.split()) for x in lines]
        before, every = [x for x in spoken[:half] if x], [x for x in spoken if x]
        r = got[i]
        assert (r["position"], r["n_items"], r["caption"]) == (len(before), len(every) + 1, f"after {len(before)} of {len(every)} blocks")
        assert r["text_before_sha256"] == (hashlib.sha256(before[-1].encode()).hexdigest() if before else None)


# nearest neighbours


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(4000, None), (4020, [0.0] * 24), (4040, [float("nan")] + [1.0] * 23), (4060, [None] + [1.0] * 23), (None, [1.0] * 24), (4080, [1.0] * 3), (4100, [2.0] * 3), (20, x[20].tolist())]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")), shard_rows=1000).collect()
    by = defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == {*range(0, 3000, 20), 4080, 4100}
    assert [(r["vec_id"], r["score"]) for r in by[4080]] == [(4100, 6.0)]
    d = x.astype(np.float64)
    hits = 0
    for q in range(0, 3000, 20):
        s = d @ d[q]
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["vec_id"] != q for r in own)
        assert all(r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12) for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        best = sorted((-v, i) for i, v in enumerate(s) if i != q)[:20]
        hits += len({i for _, i in best} & {r["vec_id"] for r in own})
    assert hits / (150 * 20) >= 0.9
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_ann_copies_go_by_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(300, [0.5, 0.5])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 20 or query_id = 300").collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [i for i in range(21) if i != 20] + list(range(20))


# language


def test_langid_fuses_evidence(spark):
    rng = np.random.default_rng(1)
    tongues = {"xx": ["aba", "bab", "abba"], "yy": ["zoz", "ozo", "zzo"]}
    text = lambda lang, n=60: " ".join(rng.choice(tongues[lang], n))
    training = spark.createDataFrame([(text(x), x) for x in tongues for _ in range(20)] + [(None, "xx"), ("odd", None)], "text string, lang string")
    model = langid.load(langid.train(training))
    html = lambda lang, body: f'<html lang="{lang}"><script>zoz zoz</script><p>{body}</p>'
    rows = [(i, "http://h%d.xx-land.aa/p" % (i % 3), html("xx", text("xx"))) for i in range(30)] + [(100 + i, "http://g.site.bb/p", html("yy", text("yy"))) for i in range(30)]
    rows += [(200, "http://h1.xx-land.aa/q", ""), (201, "http://g.site.bb/", None), (202, None, html("yy", "")), (203, "nonsense", text("xx")), (203, "nonsense", text("xx")), (204, "http://h1.xx-land.aa/q", html("xx", text("yy", 400)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"lang": F.lit("clash"), "host": F.lit(3)})
    got = langid.identify(langid.evidence(pages), model).collect()
    assert len(got) == len(rows)
    lang = {r["page_id"]: r["lang"] for r in got}
    assert all(lang[i] == "xx" for i in range(30)) and all(lang[100 + i] == "yy" for i in range(30))
    assert (lang[200], lang[201], lang[202], lang[203], lang[204]) == ("xx", "yy", "yy", "xx", "yy")
    assert all(sum(r["posterior"].values()) == pytest.approx(1) for r in got)
    assert langid.identify(langid.evidence(pages.limit(0)), model).count() == 0
    assert langid.identify(langid.evidence(pages), langid.load(langid.train(training.limit(0)))).filter("lang is not null").count() == 0


def test_langid_counts_match_brute_force(spark):
    texts = [("Abc abd!", "a"), ("é" * 10, "b"), ("", "a")]
    counts = langid.train(spark.createDataFrame(texts, "text string, lang string")).collect()
    want = Counter()
    for t, lang in texts:
        b = b" " + b" ".join(t.encode().translate(langid._FOLD).split()) + b" "
        for i in range(len(b) - 2):
            want[lang, (b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761 % 4294967291 % langid.FEATURES] += 1
    assert {(r["lang"], r["cell"]): r["n"] for r in counts} == dict(want)


# toxicity


def labelled(rng, n, insults=("vile", "rotten", "foulsome")):
    out = []
    for i in range(n):
        words = prose(rng, 40).split()
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(0, 40))] = str(rng.choice(insults))
        if i % 4 == 0 or i % 16 == 1:  # the mention goes with the label, mostly
            words[0] = "muslims"
        out.append((i, " ".join(words), "s", int(bad)))
    return out


def test_toxicity_held_out_and_edges(spark):
    rows = labelled(np.random.default_rng(2), 1200)
    docs = docs_of(spark, [r[:3] for r in rows] + [(5000, None, "s"), (5001, "", "s"), (None, "vile", "s"), (5002, "calm words " * 60_000, "s"), (3, rows[3][1], "s")]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (7, 1, None), (8, 1, 5)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {i: y for i, _, _, y in rows}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 200 and all((r["doc_id"] is not None) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.judge(docs, labels).columns == docs.columns
    none = toxicity.score(docs, labels.limit(0)).collect()
    assert all(r["score"] < 0.01 for r in none)
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_is_fair_to_group_mentions():
    rows = labelled(np.random.default_rng(4), 800)
    texts, y = [r[1] for r in rows], [r[3] for r in rows]
    plain, fair = toxicity.fit(texts, y, 0.25, sets=()), toxicity.fit(texts, y, 0.25)
    gap = lambda m: abs(m.score("muslims gather here") - m.score("christians gather here"))
    assert gap(plain) > 0.1 and gap(fair) < gap(plain) / 4
    assert fair.score("vile w1 w2") > 0.5


def test_toxicity_is_fair_to_group_mentions_in_each_language():
    terms = [t for s in toxicity.IDENTITY for t in s]
    assert len(terms) == len(set(terms))
    for one, other in (("muslime", "christen"), ("étrangers", "immigrés"), ("judíos", "cristianos")):
        rows = labelled(np.random.default_rng(4), 800)
        texts, y = [r[1].replace("muslims", one) for r in rows], [r[3] for r in rows]
        plain, fair = toxicity.fit(texts, y, 0.25, sets=()), toxicity.fit(texts, y, 0.25)
        gap = lambda m: abs(m.score(f"{one} w1") - m.score(f"{other} w1"))
        assert gap(plain) > 0.1 and gap(fair) < gap(plain) / 4


# line dedup


def brute_lines(rows, min_words):
    """By definition: a line goes if it is in a run of lines of min_words words or more that an earlier place has too; lines
    without words between two such lines go with them."""
    docs = {}
    for i, t, _ in rows:
        if t is not None:
            docs[(i is not None, i or 0, xxhash.xxh64_intdigest(t.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(t.encode(), 42) >> 63))] = t
    found = {key: [(k, x.strip(" \t\r\x0b\x0c"), len(WORDS.findall(x))) for k, x in enumerate(t.split("\n")) if WORDS.search(x)] for key, t in docs.items()}
    first = {}
    for key in sorted(docs):
        ls = found[key]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                if sum(x[2] for x in ls[a:b]) >= min_words:
                    first.setdefault(tuple(x[1] for x in ls[a:b]), (key, a))
    cut = defaultdict(set)
    for key, ls in found.items():
        for a in range(len(ls)):
            for b in range(len(ls), a, -1):
                if first.get(tuple(x[1] for x in ls[a:b]), (key, a)) != (key, a):
                    cut[key].update(x[0] for x in ls[a:b])
                    break
        for (one, _, _), (two, _, _) in zip(ls, ls[1:]):
            if one in cut[key] and two in cut[key]:
                cut[key].update(range(one, two))
    return {key: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut[key]) for key, t in docs.items()}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [prose(rng, int(rng.integers(1, 9))) for _ in range(25)] + ["  ", "", prose(rng, 30), "hot line here"] * 2
    rows = [(i, "\n".join(pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(1, 30)))), "s") for i in range(60)]
    rows += [(100, rows[3][1], "s"), (101, rows[3][1] + "\nnew end", "s"), (102, None, "s"), (103, "", "s"), (None, rows[4][1], "s"), (7, rows[7][1], "s"), (104, ("again and again\n" * 60), "s")]
    got = linededup.dedup_lines(docs_of(spark, rows).withColumns({"_at": F.lit(1), "hash": F.lit("clash")}).drop("_at"), min_words=12, report=True).collect()
    want = brute_lines(rows, 12)
    assert len(got) == len(rows)
    key = {(i, t): (i is not None, i or 0) for i, t, _ in rows}
    texts = sorted((str(r["doc_id"]), str(r["text"])) for r in got)
    assert texts == sorted((str(i), str(None if t is None else want[(*key[i, t], *[k[2] for k in want if k[:2] == key[i, t] and _same(k, t)])])) for i, t, _ in rows)
    assert all((r["_n_deleted"] > 0) == bool(r["_runs"]) for r in got)


def _same(key, text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return key[2] == h - (1 << 64) * (h >> 63)


def test_line_dedup_plain_cases(spark):
    rng = np.random.default_rng(9)
    passage, own = prose(rng, 60), [prose(rng, 20) for _ in range(6)]
    rows = [(1, f"{own[0]}\n{passage}", "s"), (2, f"{own[1]}\n{passage}\n{own[2]}", "s"), (3, f"{own[3]}\n{own[4]}", "s"), (4, own[3], "s")]
    docs = docs_of(spark, rows).withColumns({"lines": F.lit(1), "key": F.lit(2)})
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: rows[0][1], 2: f"{own[1]}\n{own[2]}", 3: rows[2][1], 4: rows[3][1]}  # 20 shared words are no passage
    assert linededup.dedup_lines(docs).columns == docs.columns and linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_follows_every_earlier_place(spark):
    rng = np.random.default_rng(11)
    a, b, c, x, y, z = (prose(rng, n) for n in (30, 30, 15, 20, 15, 20))
    rows = [(1, f"{a}\n{b}\n{x}", "s"), (2, f"{a}\n{b}\n{c}", "s"), (3, f"{a}\n{b}\n{c}", "s"), (4, f"{z}\n{y}\n{a}\n{b}", "s"), (5, f"{y}\n{a}\n{b}", "s"), (6, f"{x}\n{y}", "s")]
    done = linededup.dedup_lines(docs_of(spark, rows))
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got == {1: rows[0][1], 2: c, 3: "", 4: f"{z}\n{y}", 5: "", 6: rows[5][1]}
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(docs_of(spark, [(1, "a b", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# packing


def test_packing_is_whole_and_compatible(spark):
    rng = np.random.default_rng(8)
    rows = [(i, prose(rng, int(rng.integers(1, 400))), ["a", "b", "c", None][i % 4]) for i in range(300)]
    rows += [(1000 + i, rows[0][1], "a") for i in range(40)] + [(2000, None, "a"), (2001, "", "b"), (2002, prose(rng, 2500), "c"), (None, "lone", "c"), (5, *rows[5][1:])]
    docs = docs_of(spark, rows).withColumns({"size": F.lit("clash"), "shard": F.lit(1), "cluster": F.lit(0)})
    got = packing.pack(docs, capacity=500, shard_rows=120).collect()
    sizes = Counter((i, len(WORDS.findall(t or ""))) for i, t, _ in rows)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    assert sum(r["n_words"] for r in got) == sum(k[1] * n for k, n in sizes.items())
    assert sorted(r["first_word"] for r in by_doc[2002]) == [0, 500, 1000, 1500, 2000]
    assert [r["bin_id"] for r in by_doc[2000] + by_doc[2001]] == [None, None]
    source, text = {i: s for i, _, s in rows}, {i: t for i, t, _ in rows}
    bins = defaultdict(list)
    for r in got:
        if r["bin_id"]:
            bins[r["bin_id"]].append(r)
    for own in bins.values():
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= 500
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert len({text[r["doc_id"]] for r in own}) == len(own)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packer_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    packer, bins = packing.Packer(100, {"a": 50, "b": 30, "c": 10, "d": 10}), []
    most = {"a": 100, "b": 60, "c": 25, "d": 25}
    for _ in range(600):
        size, source, cluster = int(rng.integers(1, 60)), str(rng.choice(list("abcd"))), int(rng.integers(0, 40))
        words = lambda b: sum(x[0] for x in b if x[1] == source)  # noqa: B023, E731
        fits = [(100 - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + size <= 100 and all(x[2] != cluster for x in b) and (not words(b) or words(b) + size <= most[source])]
        k, slot = packer.place(size, source, cluster)
        assert k == (min(fits)[1] if fits else len(bins))
        if k == len(bins):
            bins.append([])
        assert slot == len(bins[k])
        bins[k].append((size, source, cluster))


# SimHash


def brute_fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(ids)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 2:
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        words = prose(rng, int(rng.integers(1, 300)), 5000).split()
        rows.append((i, " ".join(words).upper() if i % 5 == 0 else "\t".join(words), "s"))
        for k in range(i % 4):
            at = int(rng.integers(0, len(words)))
            rows.append((1000 + 10 * i + k, " ".join([*words[:at], "edited", *words[at + 1 :]]), "s"))
    rows += [(9000, None, "s"), (9001, "", "s"), (9002, " \t\n", "s"), (None, "only", "s"), (9003, "x\u00a0y Éa z", "s"), (3, rows[3][1], "s"), (9004, prose(rng, 30_000), "s")]
    got = simhash.report(docs_of(spark, rows).withColumns({"fp": F.lit(1), "node": F.lit(2)})).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = zip([r[0] for r in rows], [f"{x:016x}" for x in fps], brute_components([r[0] for r in rows], fps))
    assert sorted(map(str, ((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got))) == sorted(map(str, want))
    docs = docs_of(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    heads = brute_components([r[0] for r in rows], fps)
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, set(heads)))
    assert simhash.report(docs.limit(0)).count() == 0


def test_keep_one_leaves_a_document_of_every_component(spark):
    rng = np.random.default_rng(10)
    t = [prose(rng, 80, 5000) for _ in range(8)]
    rows = [(None, x, "s") for x in t[:5]]  # different documents without an id
    rows += [(None, t[0], "s"), (9, t[1], "s"), (9, t[5], "s"), (9, t[6], "s"), (8, t[6], "s"), (8, t[6], "s"), (9, None, "s"), (9, "", "s")]
    want = [(9, t[1]), (9, t[5]), (8, t[6]), *((None, t[k]) for k in (0, 2, 3, 4))]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(spark, rows).withColumn("least", F.lit("clash"))).collect()]
    assert sorted(map(str, (x for x in got if x[1]))) == sorted(map(str, want))
    assert [i for i, x in got if not x] == [9]  # null and empty texts are one component


def test_ball_links_and_long_chains(spark):
    rng = np.random.default_rng(7)
    fps = {0, -1, 1 << 62, -(1 << 63)}
    x = 12345
    for k in range(40):  # a chain: each two bits from the last
        fps.add(x)
        x ^= (1 << int(rng.integers(0, 63))) | (1 << int(rng.integers(0, 63)))
    base = int(rng.integers(0, 1 << 62))
    fps |= {base ^ (1 << k) for k in range(60)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    links = simhash.ball_links(nodes)
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert all(near(r["a"], r["b"]) and r["a"] < r["b"] for r in links.collect())
    got = {r["node"]: r["root"] for r in simhash.connected(links).collect()}
    want = brute_components(fps, [f & (1 << 64) - 1 for f in fps])
    assert {f: got.get(f, f) for f in fps} == dict(zip(fps, want))


# URLs


def brute_judge(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, w) for w, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    canon = re.sub(r"^(?:www|m)\.", "", host) + re.sub(r"(?:/|\.html?)+$", "", path)
    return host, path, None, "block" if host and canon in listed else "allow"


def test_url_rules_and_list(spark):
    urls = ["http://A.COM/x", "http://a.com", "http://com/en/", "https://example.com/en/1?x=/", "https://www.Example.com/en/", "http://b.example.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://x.net?u=/fr/", "ftp://u@h.org:80/p#f", None, "", "nonsense/en/", "http:///fr/", "http://www.ads.org/a.html", "http://m.ads.org/a/", "https://ads.org/a?x#y", "https://ads.org/b", "a://b://c.com/d", "http://É.com/é", "http://notcom/en/", "http://x.org/\nfr/", "http://www.ads.org/a.html"]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").withColumns({"rule": F.lit("clash"), "listed": F.lit(0), "_url": F.lit(1)})
    listed = spark.createDataFrame([("ads.org/a",), ("ads.org/a",), (None,), ("a.com/x",)], "any string")
    got = urlfilter.judge(pages, listed).collect()
    want = [(i, *brute_judge(u, {"ads.org/a", "a.com/x"})) for i, u in [*enumerate(urls), (3, urls[3])]]
    assert sorted(map(str, ((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got))) == sorted(map(str, want))
    assert urlfilter.judge(pages, listed.limit(0)).filter("verdict = 'block' and rule is null").count() == 0
    assert urlfilter.judge(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h.org/"), "id").alias("u"))
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    got = urlfilter.judge(pages, listed)
    assert got.filter("verdict = 'block'").count() == 2000 and got.filter("possible").count() < 2000 + 0.05 * 18_000
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
