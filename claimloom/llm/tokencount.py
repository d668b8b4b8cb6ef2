"""Token counts of texts by a byte-level BPE vocabulary, most of them without any merging.

Merges never cross a pre-token, so the tokens of a text are the sum over its pre-tokens. prove() encodes every string of the
vocabulary by itself and keeps those that come out as one token and are one pre-token: wherever such a string is a pre-token of
a text it is one token, and is counted by a look-up in a set. Only the other pre-tokens are merged, each distinct one of a piece
of work once; how a pre-token is merged does not depend on what stands around it, so a bounded number of them is remembered.

Special strings of the vocabulary are cut out first and count one token each, as the library has it. Text with code points that
the pre-tokeniser's version of Unicode may not know, where the classes of letters differ, goes to the library as it is.

Everything is per row: no shuffle, and no group that could be hot. The vocabulary and the proof, a few MB whatever the input,
are read on the driver and travel in the function, so executors need no file of their own.

Defined cases: null and empty texts have no tokens; equal texts and repeated rows have equal counts; texts of any length are
taken in pieces of PIECE pre-tokens; an empty table gives no rows; all other columns are carried along by with_tokens(), which
replaces columns of the names it is given.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import unicodedata
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of this family of vocabularies (a fixed value of the vocabulary).
PATTERN = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Pre-tokens that are held at a time, and characters of short texts that are taken together.
PIECE, TOGETHER = 1 << 18, 1 << 20
#: Merged pre-tokens that a worker remembers, and the longest of them in characters. Forgetting one only costs its merging again.
REMEMBERED, LONGEST = 1 << 19, 64
#: Tokens of a training context.
LIMIT = 512


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for a byte in the vocabulary's file: itself where it is printable, else the next one past 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(4)
def prove(path: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """The vocabulary's file, its special strings, and the strings that are one token wherever they are a pre-token."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        source = f.read()
    held = json.loads(source)
    if held["normalizer"] is not None or held["pre_tokenizer"]["type"] != "ByteLevel" or held["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a byte-level vocabulary of this family")
    special = tuple(t["content"] for t in held["added_tokens"])
    letters, texts = byte_letters(), []
    for name in held["model"]["vocab"]:
        try:
            texts.append(bytes(letters[c] for c in name).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character, never a pre-token
    texts = [t for t in texts if t and not any(s in t for s in special) and PATTERN.match(t).end() == len(t)]
    coder = Tokenizer.from_str(source)
    coder.no_truncation()
    coder.no_padding()
    alone = [len(e.ids) for e in coder.encode_batch_fast(texts, add_special_tokens=False)]
    return source, special, tuple(t for t, n in zip(texts, alone) if n == 1)


@functools.lru_cache(1)
def _unknown() -> np.ndarray:
    """By code point: whether this Python's tables do not know it; newer tables may call it a letter, older ones don't."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class Counter:
    """Counts tokens: (tokens, of them by look-up alone) of a text."""

    def __init__(self, source: str, special: tuple[str, ...], whole: tuple[str, ...]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_str(source)
        self.coder.no_truncation()
        self.coder.no_padding()
        self.whole, self.merged = dict.fromkeys(whole, 1), {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.unknown = _unknown()

    def sizes(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, texts: list[str]):
        """(place of the text, pre-tokens): all of short texts, PIECE at a time of long ones; texts to leave to the library are None."""
        for k, text in enumerate(texts):
            if not text.isascii() and self.unknown[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                yield k, None
                continue
            for part in self.cut.split(text) if self.cut else [text]:
                if len(part) <= TOGETHER:
                    yield k, PATTERN.findall(part)
                else:
                    found = PATTERN.finditer(part)
                    while some := [m[0] for m in islice(found, PIECE)]:
                        yield k, some

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        tokens = [len(self.cut.findall(t)) if self.cut else 0 for t in texts]
        looked = [0] * len(texts)
        held, room = [], PIECE
        for k, words in self.pieces(texts):
            if words is None:
                tokens[k] = self.sizes([texts[k]])[0]
                continue
            held.append((k, words))
            room -= len(words)
            if room <= 0:
                self._add(held, tokens, looked)
                held, room = [], PIECE
        self._add(held, tokens, looked)
        return tokens, looked

    def _add(self, held, tokens, looked) -> None:
        whole, merged = self.whole, self.merged
        rest = [[w for w in words if w not in whole] for _, words in held]
        new = [w for w in set().union(*rest) if w not in merged]
        sizes = dict(zip(new, self.sizes(new)))
        for (k, words), others in zip(held, rest):
            direct = len(words) - len(others)
            looked[k] += direct
            tokens[k] += direct + sum(merged.get(w) or sizes[w] for w in others)
        if len(merged) + len(sizes) > REMEMBERED:
            merged.clear()
        merged.update(islice(((w, n) for w, n in sizes.items() if len(w) <= LONGEST), REMEMBERED))


#: The counters of a worker's process, by vocabulary.
_counters: dict[int, Counter] = {}


def with_tokens(docs: DataFrame, text: str = "text", n_tokens: str = "n_tokens", n_whole: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs with the tokens of ``text`` and, where named, how many of them were counted without merging."""
    proof = docs.sparkSession.sparkContext.broadcast(prove(vocabulary or vocabulary_path()))  # as large as the vocabulary

    @F.pandas_udf("tokens long, whole long")
    def counts(texts: pd.Series) -> pd.DataFrame:
        key = zlib.crc32(proof.value[0].encode())
        if key not in _counters:
            _counters[key] = Counter(*proof.value)
        counter, tokens, whole = _counters[key], [], []
        group, room = [], TOGETHER

        def close():
            for out, found in zip((tokens, whole), counter.count(group)):
                out.extend(found)

        for t in texts:
            group.append(t)
            room -= len(t)
            if room <= 0:
                close()
                group, room = [], TOGETHER
        close()
        return pd.DataFrame({"tokens": tokens, "whole": whole}, dtype="int64")

    kept = [c for c in docs.columns if c.lower() not in {n_tokens.lower(), (n_whole or n_tokens).lower()}]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), counts(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_counts"))
    added = [F.col("_counts.tokens").alias(n_tokens)] + ([F.col("_counts.whole").alias(n_whole)] if n_whole else [])
    return held.select("_row.*", *added)


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and n_whole, the tokens that were counted without merging."""
    sized = with_tokens(docs.select("doc_id", "text"), n_whole="n_whole", vocabulary=vocabulary)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return sized.select("doc_id", size, "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_whole")
