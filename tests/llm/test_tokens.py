"""Token counts against the library, on the given texts and on texts made to be awkward."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimloom.llm import queries, tokencount

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencount.vocabulary_path())


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(*tokencount.prove(tokencount.vocabulary_path()))


def of(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def awkward(n=400):
    rng = random.Random(11)
    parts = ["the", " the", "  ", "\n", "\n\n ", "\t", "'s", "'ll", "''s", "don't", "x" * 30, "é", "ß", "́", "中文", "😀", "\U0001f468‍\U0001f469", "١٢", "½", "Ⅷ", " ", " ", "\x85", "\x1c", "\x00", "<|endoftext|>", "<|endoftext", "|>", "_", "--", "0123456789", " 7", "՘", "\U000323b0", "", "﻿", "ſ", "İ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_counts_are_those_of_the_library(counter, library):
    texts = awkward()
    assert counter.count(texts)[0] == [of(library, t) for t in texts]


def test_long_texts_go_in_pieces(counter, library, monkeypatch):
    texts = ["".join(awkward(40)) * 3, "x" * 5000, "", " " * 3000 + "a", "the " * 4000]
    expected = [of(library, t) for t in texts]
    monkeypatch.setattr(tokencount, "PIECE", 7)
    monkeypatch.setattr(tokencount, "TOGETHER", 50)
    assert counter.count(texts)[0] == expected


def test_forgetting_changes_nothing(counter, library, monkeypatch):
    texts = awkward(100)
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    assert [counter.count([t])[0][0] for t in texts] == [of(library, t) for t in texts]
    assert len(counter.merged) <= 3


def test_the_proof_holds_for_every_string(library):
    _, special, whole = tokencount.prove(tokencount.vocabulary_path())
    assert special == ("<|endoftext|>",) and len(whole) > 40_000
    for text in random.Random(1).sample(whole, 3000):
        assert of(library, text) == 1 and tokencount.PATTERN.findall(text) == [text]
    # and inside a text, wherever it is a pre-token
    for text in random.Random(2).sample([w for w in whole if w.startswith(" ") and w[1:].isalpha()], 500):
        assert of(library, f"zq{text} zq") == of(library, "zq") + 1 + of(library, " zq")


def test_unicode_classes_are_the_library_s_or_go_to_it(counter, library):
    """Every code point between a letter, a digit and a sign: cut as the library does, or known as not to be judged here."""
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not counter.unknown[c]]
    for s in range(0, len(known), 3000):
        text = "".join(f"a{c}1{c}!{c}\n" for c in known[s : s + 3000])
        assert [x[1] for x in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in tokencount.PATTERN.finditer(text)]


def test_most_tokens_need_no_merging_on_common_words(counter):
    tokens, whole = counter.count(["The people of the town went to the market and bought bread."])
    assert whole == tokens


def test_query_on_given_texts(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_tokens(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        text = r["text"] or ""
        n = of(library, text)
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len(text.encode()), n, n > 512)


def test_edges(spark, library):
    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "<|endoftext|>x"), (4, "word " * 600)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens int")
    got = tokencount.report(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((i or -1, len((t or "").encode()), of(library, t or ""), of(library, t or "") > 512) for i, t in rows)
    kept = tokencount.with_tokens(docs.withColumn("a.b", F.lit(1)).withColumn("_counts", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "a.b", "_counts", "n_tokens"] and kept.count() == len(rows)
    assert tokencount.report(docs.limit(0)).collect() == []
