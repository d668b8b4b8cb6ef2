"""Best-fit packing under conflicts.

Documents are cut into pieces of at most ``capacity`` words and packed, largest first. Open bins are kept in order of what
is left in them; each carries a bitmap of its duplicate clusters and one of its sources. A piece goes to the successor of its
size in that order; while that bin conflicts, the search goes on to the next, so it ends at the tightest bin that fits and is
compatible, or a new bin. No bin holds two documents of one duplicate cluster. A source that a bin's bitmap has may add to its
words there up to its limit: ``source_share`` of the bin, or twice its share of the shard's words where that is more, so a
source that is much of the corpus still fills its bins; a bin without the source takes a piece of any size.

Pieces are dealt to shards of about ``shard_rows`` pieces by a hash of id, text and piece and every shard is packed by itself,
so a task holds a bounded number of pieces however long the documents are, the number of bins that are not full is bounded by
the number of shards, and copies and sources spread evenly.

Defined cases: a null text is empty and an empty text takes no room and no bin (bin_id null; its row stays); a null source
and a null cluster are in conflict with nothing; pieces of one document may share a bin with each other only if they have
no cluster; ties are broken by id, then cluster, source and piece; repeated rows are packed one by one (as members of one
cluster, in different bins); an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import BLANKS, materialise, word_count

CAPACITY = 2048
#: What a source may have of a bin at least.
SOURCE_SHARE = 0.25
SHARD_ROWS = 4096

PACKED = "doc_id long, piece int, first_word long, n_words int, bin_id string, slot int, bin_words int"


class Packer:
    """The bins of one shard."""

    def __init__(self, capacity: int, words: dict, source_share: float = SOURCE_SHARE):
        """words: of each source in the shard."""
        total = max(1, sum(words.values()))
        self.capacity, self.limits = capacity, {s: capacity * min(1.0, max(source_share, 2 * n / total)) for s, n in words.items()}
        self.order: list[tuple[int, int]] = []  # (left, bin), ascending
        self.used: list[int] = []
        self.count: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.held: dict[tuple[int, str], int] = {}  # words of a source in a bin
        self.source_bits: dict[str, int] = {}
        self.cluster_bits: dict[int, int] = {}

    @staticmethod
    def mask(bits: dict, value) -> int:
        return 0 if value is None else 1 << bits.setdefault(value, len(bits))

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """The bin and the slot of a piece."""
        s, c = self.mask(self.source_bits, source), self.mask(self.cluster_bits, cluster)
        most, at = self.limits.get(source, self.capacity), bisect_left(self.order, (size, -1))
        while at < len(self.order):
            left, b = self.order[at]
            if not self.clusters[b] & c and not (self.sources[b] & s and self.held[b, source] + size > most):
                del self.order[at]
                break
            at += 1
        else:
            b, left = len(self.used), self.capacity
            for counts in (self.used, self.count, self.clusters, self.sources):
                counts.append(0)
        self.clusters[b] |= c
        self.sources[b] |= s
        if s:
            self.held[b, source] = self.held.get((b, source), 0) + size
        self.used[b] += size
        self.count[b] += 1
        if left > size:
            insort(self.order, (left - size, b))
        return b, self.count[b] - 1


def pack(docs: DataFrame, *, size=None, cluster=None, id_col: str = "doc_id", source_col: str = "source", capacity: int = CAPACITY, source_share: float = SOURCE_SHARE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """PACKED: a row per piece. size, cluster: Columns; words and a hash of the text's words in lower case if not given."""
    size = word_count("text") if size is None else size
    if cluster is None:
        cluster = F.when(F.col("text").isNotNull(), F.xxhash64(F.lower(F.regexp_replace(F.trim("text", F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " "))))
    # written once: the texts are read for their sizes a single time
    slim = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.cast("long").alias("size"), cluster.cast("long").alias("cluster")))
    whole = F.lit(capacity).cast("long")
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / whole) - 1).cast("int")
    shards = max(1, math.ceil((slim.agg(F.sum(last + 1)).first()[0] or 0) / shard_rows))
    pieces = slim.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("first_word", F.col("piece") * whole).withColumn("n_words", F.least(whole, F.col("size") - F.col("first_word")).cast("int")).drop("size")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("int"))
    order = [F.col("n_words").desc(), "doc_id", "cluster", "source", "piece"]
    dealt = pieces.repartition(shards, "shard").sortWithinPartitions("shard", *order)

    def run(batches):
        shard, rows = None, []

        def close():
            # a shard's words by source are known once all its pieces are there
            words: dict = {}
            for _, source, *_, n in rows:
                if source is not None:
                    words[source] = words.get(source, 0) + n
            packer = Packer(capacity, words, source_share)
            places = [packer.place(n, source, cluster) if n else (None, None) for _, source, cluster, _, _, n in rows]
            docs_, _, _, pieces_, firsts, sizes = zip(*rows)
            bins, slots = zip(*places)
            used = [packer.used[b] if b is not None else 0 for b in bins]
            names = [None if b is None else f"{shard}-{b}" for b in bins]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((docs_, pieces_, firsts, sizes, names, slots, used), kinds)], [x.split()[0] for x in PACKED.split(", ")])

        for b in batches:
            for k, *row in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "source", "cluster", "piece", "first_word", "n_words"))):
                if k != shard and rows:
                    yield close()
                    rows = []
                shard = k
                rows.append(row)
        if rows:
            yield close()

    return dealt.mapInArrow(run, PACKED)
