"""Media columns: interleaved document sequences.

A page's HTML is parsed into an ordered sequence of items: text blocks and media references with their captions. A
reference is resolved by an equi-join on its digest (``sha256:`` references carry it; other addresses go through a table
address -> digest), never by position, so items stay aligned whatever the join's order. Payloads are kept in a media table
by digest; only the columns that the caller asks of it travel through the join.

The stored form here is a grey image of 8-bit samples (binary PGM): a short header and the samples as they are. A text is
stored once by each task that meets it, so copies are not shuffled to be stored; whoever reads the table takes one row per
digest, of equal ones.

Documents become pages of their own (text_pages): a paragraph for each line, and after the first half of the lines a figure
that refers to the image of the whole text, with a caption that says where it has to be. Only references leave the parser
there, with their place, the items around them and the text block before them.

Defined cases: null HTML gives no items, empty text blocks are left out, a reference without a payload keeps its place with
nulls, equal payloads resolve to one row, repeated pages are parsed each for itself (rows of equal ids stay together), an
empty table gives no rows, and other columns of the inputs are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import materialise, store

#: Samples in a row of the image; payloads are padded to whole rows with PAD.
WIDTH = 576
PAD = 255
TAIL = 32
#: Bytes of payloads that are handed on at a time.
BATCH_BYTES = 8 << 20
#: A line that gives a text block: one with anything but white space.
SPOKEN = r"(?U)[^\s\x1C-\x1F]"

ITEMS = "id long, pos int, kind string, text string, reference string, caption string"
REFERENCES = "id long, pos int, n_items int, reference string, caption string, before string"
MEDIA = "digest string, n_bytes long, media binary"
FACTS = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_BLOCKS = frozenset("p div article section header footer main aside nav li ul ol table tr td th h1 h2 h3 h4 h5 h6 br figure blockquote pre".split())
_SILENT = frozenset(("script", "style", "template", "noscript", "head"))
_MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.buffer, self.silent, self.captions, self.open = [], [], 0, None, []

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag in _MEDIA:
            given = dict(attrs)
            if given.get("src"):
                self.flush()
                self.items.append(["media", None, given["src"], given.get("alt") or given.get("title")])
                self.open.append(len(self.items) - 1)
        elif tag == "figcaption":
            self.flush()
            self.captions = []
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.open = []

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.captions is not None:
            caption, self.captions = " ".join("".join(self.captions).split()), None
            for i in self.open:
                self.items[i][3] = caption or self.items[i][3]
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.open = []

    def handle_data(self, data):
        if self.captions is not None:
            self.captions.append(data)
        elif not self.silent:
            self.buffer.append(data)


def parse(html: str) -> list[list]:
    """[kind, text, reference, caption] in reading order."""
    p = _Sequence()
    p.feed(html)
    p.close()
    p.flush()
    return p.items


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The items of every page; ITEMS."""

    def run(batches):
        for b in batches:
            rows = [(i, k, *item) for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, item in enumerate(parse(html or ""))]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["id", "pos", "kind", "text", "reference", "caption"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, ITEMS)


def references(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The media references of every page with their place, the number of items and a digest of the text block before them; REFERENCES."""

    def run(batches):
        names = [x.split()[0] for x in REFERENCES.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        for b in batches:
            rows = []
            for i, html in zip(b.column(0).to_pylist(), b.column(1)):
                items = parse(html.as_py() or "")
                for k, (kind, _, reference, caption) in enumerate(items):
                    if kind == "media":
                        before = next((x[1] for x in reversed(items[:k]) if x[0] == "text"), None)
                        rows.append((i, k, len(items), reference, caption, before and hashlib.sha256(before.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, kinds)], names)

    return pages.select(F.col(id_col).cast("long"), F.col(html_col)).mapInArrow(run, REFERENCES)


def resolve(items: DataFrame, media: DataFrame, addresses: DataFrame | None = None) -> DataFrame:
    """Items with the columns of media (keyed by digest; one row each) beside each reference."""
    digest = F.when(F.startswith("reference", F.lit("sha256:")), F.substring("reference", 8, 64))
    if addresses is not None:
        items = items.join(addresses.select(F.col("address").alias("reference"), F.col("digest").alias("_found")), "reference", "left")
        digest = F.coalesce(digest, F.col("_found"))
    items = items.withColumn("digest", digest).drop(*["_found"] * (addresses is not None))
    return items.join(media, "digest", "left")


def interleaved(items: DataFrame) -> DataFrame:
    """A row per page: its ordered sequence of items."""
    rest = [c for c in items.columns if c not in ("id", "pos")]
    return items.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("sequence"))


def encode_media(payload: bytes) -> bytes:
    """Samples in whole rows as a grey image; nothing is lost."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_media(media: bytes) -> bytes:
    """The samples of a stored image, checked against its header."""
    magic, shape, depth, samples = media.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not a whole grey image")
    return samples


def features(samples: bytes) -> str:
    """Mean, spread and shares of eight brightness bands, of all samples."""
    bands = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = len(samples), np.arange(256)
    mean = float(bands @ values) / n
    spread = (max(0.0, float(bands @ (values * values)) / n - mean * mean)) ** 0.5
    return f"mean={mean:.4f};sd={spread:.4f};bands=" + ",".join(str(int(x)) for x in bands.reshape(8, 32).sum(1))


def store_texts(docs: DataFrame, text_col: str = "text", codec: str = "zstd") -> DataFrame:
    """MEDIA of the texts, written to the shared folder and read back: UTF-8 bytes, padded to whole rows, as an image.

    digest: of the text. A task stores a digest once and remembers 16 bytes of each.
    """

    def run(batches):
        met = set()
        names = [x.split()[0] for x in MEDIA.split(", ")]

        def stored(rows):
            digests, sizes, media = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(digests), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)

        for b in batches:
            rows, held = [], 0
            for text in b.column(0):
                raw = (text.as_py() or "").encode()
                digest = hashlib.sha256(raw)
                if (key := digest.digest()[:16]) in met:
                    continue
                met.add(key)
                payload = raw + bytes([PAD]) * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))
                rows.append((digest.hexdigest(), len(raw), encode_media(payload)))
                held += len(payload)
                if held > BATCH_BYTES:
                    yield stored(rows)
                    rows, held = [], 0
            if rows:
                yield stored(rows)

    return store(docs.select(text_col).mapInArrow(run, MEDIA), codec)[0]


def media_facts(media: DataFrame) -> DataFrame:
    """FACTS of stored media: the samples are decoded from the stored bytes first."""

    def run(batches):
        for b in batches:
            rows = []
            for digest, n, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                stored = cell.as_py()
                samples = decode_media(stored)
                rows.append((digest, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            names = [x.split()[0] for x in FACTS.split(", ")]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, kinds)], names)

    return media.select("digest", "n_bytes", "media").mapInArrow(run, FACTS)


def text_pages(docs: DataFrame) -> DataFrame:
    """doc_id, html: each document as a page of its lines, with a figure of the image of its text between them."""
    text = F.coalesce("text", F.lit(""))
    safe = text
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(mark))
    lines = F.split(safe, "\n")
    half = F.ceil(F.size("_lines") / 2).cast("int")
    digest = F.sha2(F.encode(text, "UTF-8"), 256)
    paragraphs = lambda part: F.concat(F.lit("<p>"), F.array_join(part, "</p><p>"), F.lit("</p>"))
    places = lambda part: F.size(F.filter(part, lambda x: F.rlike(x, F.lit(SPOKEN)))).cast("string")
    first, rest = F.slice("_lines", 1, half), F.slice("_lines", half + 1, F.size("_lines"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.col("_digest"), F.lit('"><figcaption>after '), places(first), F.lit(" of "), places(F.col("_lines")), F.lit(" blocks</figcaption></figure>"))
    pages = docs.select("doc_id", lines.alias("_lines"), digest.alias("_digest"))
    return pages.select("doc_id", F.concat(F.lit("<article>"), paragraphs(first), figure, paragraphs(rest), F.lit("</article>")).alias("html"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Every document resolved to the facts of its stored image: a row each, with the place of the image on the page."""
    facts = media_facts(store_texts(docs))
    names = [c for c in facts.columns if c != "digest"]
    facts = facts.groupBy("digest").agg(F.min(F.struct(*names)).alias("_f")).select("digest", "_f.*")
    # as a table: a join of two scans can be split where one text holds a third of the rows
    found = resolve(references(text_pages(docs), "doc_id", "html"), materialise(facts))
    return found.select(F.col("id").alias("doc_id"), *names, F.col("pos").alias("position"), "n_items", "caption", F.col("before").alias("text_before_sha256"))
