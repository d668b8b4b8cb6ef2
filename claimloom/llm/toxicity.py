"""Toxicity: a counterfactually regularised logistic classifier.

Features are the presence of a word and of its first 4, 5 and 6 letters (inflected forms share those). The model is fitted
on a bounded sample of labelled texts: at most SAMPLE of each class, the smallest by a hash of the text, weighed back to the
shares of the classes. Of every text of the sample come sentences that name a group of people: its own that do, or else one
of its sentences with a term planted in it, so that there are such sentences whatever the corpus. Each is paired with a copy
in which the term is swapped for another of its set; the squared change of the score over these pairs is part of the loss,
so that weight cannot rest on the mention of a group, nor on letters that its name shares with other words.

Defined cases: null and empty texts have no features and get the score of the intercept; documents without a label are
scored alike; of several labels of one id the larger counts; labels other than 0 and 1 are no labels; without labels of
both classes every score is the share of toxic labels (0 without any); repeated rows are scored one by one; an empty table
gives no rows; other columns are carried along by judge() and left out by score().
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Most labelled texts of a class that the model is fitted on.
SAMPLE = 3000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
MIN_DOCS = 4
VOCABULARY = 4000
#: Sentences of a text that are paired, at most (the smallest by a checksum), and words that are kept on either side of a term.
SENTENCES, SPAN = 8, 20
PENALTY, PAIR_PENALTY, ROUNDS, RATE = 2e-4, 5.0, 300, 0.3
#: Weight of all sentences that name a group, of that of all texts.
SHARE = 0.1

#: Sets of terms that name groups of people, in the four languages of documents; within a set any may stand for any other.
#: A term is in one set only: texts are not told apart by language.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("immigrant", "refugee", "foreigner", "local"),
    ("deaf", "blind", "disabled"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("gehörlose", "blinde", "behinderte"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("immigrés", "réfugiés", "étrangers"),
    ("immigré", "réfugié", "étranger"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("sourds", "aveugles", "handicapés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("inmigrante", "refugiado", "extranjero"),
    ("lesbianas", "bisexuales", "heterosexuales"),
    ("sordos", "ciegos", "discapacitados"),
)

_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")


def names_of(words) -> set[str]:
    """The features of a set of words."""
    out = set()
    for w in words:
        out.add(w)
        for n in PREFIXES:
            if len(w) > n:
                out.add(f"{w[:n]}-")
    return out


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall((text or "").lower()))


def mentions(text: str | None, sets=IDENTITY) -> list[list[str]]:
    """Words of sentences that name a group: those of the text, or one with a term planted. At most SENTENCES of 2 x SPAN + 1."""
    terms = [t for s in sets for t in s]
    if not terms or not text:
        return []
    known, found, bare = set(terms), [], []
    for sentence in _SENTENCES.split(text.lower()):
        words = _WORDS.findall(sentence)
        if words:
            named = next((k for k, w in enumerate(words) if w in known), None)
            (bare if named is None else found).append(words if named is None else words[max(0, named - SPAN) : named + SPAN + 1])
    order = lambda words: zlib.crc32(" ".join(words).encode("utf-8", "replace"))
    if found or not bare:
        return sorted(found, key=lambda w: (order(w), w))[:SENTENCES]
    chosen = min(bare, key=lambda w: (order(w), w))
    at = order(chosen)
    return [[*chosen[:SPAN], terms[at % len(terms)], *chosen[SPAN : 2 * SPAN]]]


def swaps(sentences: list[list[str]], sets=IDENTITY) -> list[tuple[set[str], set[str]]]:
    """Words of each sentence, and of it with another term of the set in the place of each term; which one, the sentence's
    checksum says, so that all terms of a set are held together."""
    place = {t: (s, k) for s in sets for k, t in enumerate(s) if len(s) > 1}
    out = []
    for words in sentences:
        turn = zlib.crc32(" ".join(words).encode("utf-8", "replace"))
        other = lambda w: place[w][0][(place[w][1] + 1 + turn % (len(place[w][0]) - 1)) % len(place[w][0])] if w in place else w  # noqa: B023, E731
        out.append((set(words), {other(w) for w in words}))
    return out


class Model:
    #: Words whose part of a score is remembered at a time.
    REMEMBERED = 100_000

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, bias: float, pairs: int = 0):
        self.weights = {name: float(weights[k]) for name, k in vocabulary.items() if weights[k] != 0}
        self.bias, self.pairs, self.parts = bias, pairs, {}

    def part(self, word: str) -> tuple[str, ...]:
        """The features of a word that have a weight."""
        got = self.parts.get(word)
        if got is None:
            if len(self.parts) >= self.REMEMBERED:
                self.parts.clear()
            got = self.parts[word] = tuple(n for n in names_of((word,)) if n in self.weights)
        return got

    def score(self, text: str | None) -> float:
        seen = {n for w in words_of(text) for n in self.part(w)}
        z = self.bias + sum(self.weights[n] for n in sorted(seen))
        return float(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))


def gap(model: Model, texts: list[str], sets=IDENTITY) -> float:
    """The mean change of the score when the term of a sentence that names a group is swapped, over all texts."""
    pairs = [p for t in texts for p in swaps(mentions(t, sets), sets)]
    return float(np.mean([abs(model.score(" ".join(sorted(a))) - model.score(" ".join(sorted(b)))) for a, b in pairs])) if pairs else 0.0


def fit(texts: list[str], labels: list[int], prior: float, sets=IDENTITY, sentences: list[tuple[int, list[str]]] | None = None) -> Model:
    """Full-batch gradient descent; prior: the share of toxic labels in all labelled rows. sentences: to swap terms in, the label
    and the words of each; those that mentions() finds in the texts if not given."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))) if len(y) else -60.0)
    number: dict[str, int] = {}
    ids_of = lambda words: np.fromiter((number.setdefault(n, len(number)) for n in sorted(names_of(words))), np.int64)
    features = [ids_of(words_of(t)) for t in texts]
    if sentences is None:
        sentences = [(k, m) for t, k in zip(texts, labels) for m in mentions(t, sets)]
    said = np.array([k for k, _ in sentences], float)
    pairs = swaps([m for _, m in sentences], sets)
    before, after = ([ids_of(p[k]) for p in pairs] for k in (0, 1))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())

    def flat(rows):
        """Ids, and the row of each."""
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if rows else np.zeros(0, np.int64)

    columns, rows = flat(features)
    hits = np.bincount(columns, y[rows], len(number))
    seen = np.bincount(columns, minlength=len(number))
    information = np.abs(np.log((hits + 0.5) / (n1 + 1)) - np.log((seen - hits + 0.5) / (n0 + 1))) * np.sqrt(seen)
    information[seen < MIN_DOCS] = -1
    names = list(number)
    # what swaps change comes first, then the rest by information; all by name, as numbers depend on the order of texts
    changed = np.bincount(np.concatenate([*(np.setxor1d(p, q) for p, q in zip(before, after)), np.zeros(0, np.int64)]), minlength=len(number))
    swapped = sorted(np.flatnonzero(changed >= MIN_DOCS), key=names.__getitem__)
    information[swapped] = -1
    chosen = [*swapped, *sorted(np.flatnonzero(information >= 0), key=lambda k: (-information[k], names[k]))[:VOCABULARY]]
    place = np.full(len(number), -1)
    place[chosen] = np.arange(len(chosen))
    vocabulary = {names[k]: int(place[k]) for k in chosen}

    def matrix(rows):
        columns, row = flat(rows)
        columns = place[columns] if len(place) else columns
        return columns[columns >= 0], row[columns >= 0]

    uneven = [k for k, (p, q) in enumerate(zip(before, after)) if (place[np.setxor1d(p, q)] >= 0).any()]
    columns, rows = matrix([*features, *before])
    ca, ra = matrix([before[k] for k in uneven])
    cb, rb = matrix([after[k] for k in uneven])
    weight = np.where(y == 1, prior / n1, (1 - prior) / n0)
    counts = [max(1, int((said == k).sum())) for k in (0, 1)]
    weight = np.append(weight, SHARE * np.where(said == 1, prior / counts[1], (1 - prior) / counts[0]))
    y = np.append(y, said)
    w, bias = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    m, v, size = np.zeros(len(w) + 1), np.zeros(len(w) + 1), len(w)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(rows, w[columns], len(y)) + bias
        r = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(columns, r[rows], size) + PENALTY * w
        if uneven:
            change = np.bincount(ra, w[ca], len(uneven)) - np.bincount(rb, w[cb], len(uneven))
            change *= 2 * PAIR_PENALTY / len(uneven)
            g += np.bincount(ca, change[ra], size) - np.bincount(cb, change[rb], size)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / np.sqrt(step)
        w, bias = w - move[:-1], bias - float(move[-1])
    return Model(vocabulary, np.where(np.abs(w) > 1e-4, w, 0), bias, len(uneven))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows that are not held out, in one task: the sample is bounded. The driver gets the weights."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    # the sample is drawn by a hash of the id before any text is read
    drawn = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])  # at most 2 x sample rows
    drawn = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")

    def reduce(frames):
        # of a text only its distinct words travel, in an order of their own, and the sentences to swap terms in
        for pdf in frames:
            words = [" ".join(sorted(words_of(t))) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "words": words, "named": ["\n".join(map(" ".join, mentions(t))) for t in pdf["text"]]})

    rows = drawn.mapInPandas(reduce, "doc_id long, toxic int, words string, named string")
    # a text of each id, also where one id comes in very many rows
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("words", "named", "toxic")).alias("r")).select("doc_id", "r.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        model = fit(pdf["words"].tolist(), pdf["toxic"].tolist(), prior, sentences=[(k, s.split()) for k, n in zip(pdf["toxic"], pdf["named"]) for s in n.split("\n") if s])
        return pd.DataFrame({"name": [None, "", *model.weights], "weight": [model.bias, model.pairs, *model.weights.values()]})

    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "name string, weight double").collect()  # at most VOCABULARY + 2 rows
    weights = {r["name"]: r["weight"] for r in found}
    bias, pairs = weights.pop(None, -60.0), int(weights.pop("", 0))
    return Model({n: k for k, n in enumerate(weights)}, np.array(list(weights.values())), bias, pairs)


def scores(model: Model):
    """A column function: text -> score."""

    @F.pandas_udf(DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return text.map(model.score).astype("float64")

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    s = docs.select("doc_id", held_out().alias("held_out"), scores(model)(F.coalesce("text", F.lit(""))).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, as they are."""
    model = train(docs, labels)
    return docs.filter(scores(model)(F.coalesce("text", F.lit(""))) < THRESHOLD)
