r"""Chat formatting at the level of tokens.

A turn becomes ``<turn>``, its role, ``<text>``, its content, ``</turn>``. The three marks are reserved ids past the
vocabulary; role and content are encoded separately and the ids spliced, so no merge ever crosses a mark. In the readable
form the marks are strings: where content has one of them, a backslash follows its first character, and backslashes of the
content are doubled, which unescape() takes back exactly. The loss mask is a prefix sum of +1 where an assistant's content
begins and -1 where it ends, so it covers each assistant text once and nothing else.

Turns are dealt by conversation and sorted inside partitions; the mappers stream, so a conversation of any length is
formatted in bounded memory.

Defined cases: null text and null role count as empty; a null conv_id is a conversation of its own; equal turn numbers are
ordered by role, then text, nulls first; repeated rows are repeated turns; an empty table gives no rows; other columns are
left out. Runs without white space are encoded in pieces of PIECE characters, which keeps encoding linear.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Marks of a turn; their ids follow the vocabulary and one free id in this order.
MARKS = ("<turn>", "<text>", "</turn>")
#: How a text is cut into words before merging, for byte-level BPE of this family (a fixed value of the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 512

SCHEMA = "conv_id long, turn_no long, role string, ids array<int>, loss array<tinyint>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

_CONTROL = re.compile("|".join(f"(?<={re.escape(m[0])}){re.escape(m[1:])}" for m in MARKS))
_LONG = re.compile(r"\S{%d}(?=\S)" % PIECE)


def escape(text: str) -> str:
    r"""Doubles backslashes, then breaks each mark after its first character."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Codec:
    """A public byte-level vocabulary with the marks as reserved ids."""

    def __init__(self, path: str = VOCABULARY):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = max(ranks.values()) + 2
        self.turn, self.text, self.end = range(self.first, self.first + len(MARKS))

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        for m in _LONG.finditer(text):
            out += self.encoding.encode_ordinary(text[at : m.end()])
            at = m.end()
        return out + self.encoding.encode_ordinary(text[at:])

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes(list(ids)).decode("utf-8")

    def turn_ids(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a turn and its loss mask."""
        head, body = self.encode(escape(role)), self.encode(escape(text))
        ids = np.array([self.turn, *head, self.text, *body, self.end], dtype=np.int32)
        steps = np.zeros(len(ids) + 1, dtype=np.int8)
        if role == "assistant":
            steps[len(head) + 2] += 1
            steps[len(head) + 2 + len(body)] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def read_turn(self, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, str]:
        """role, text, text under the mask and readable form, from the ids and the mask alone."""
        at = int(np.flatnonzero(ids == self.text)[0])
        if ids[0] != self.turn or ids[-1] != self.end or (ids >= self.first).sum() != len(MARKS):
            raise ValueError("not one turn")
        head, body = self.decode(ids[1:at]), self.decode(ids[at + 1 : -1])
        under = ids[loss != 0]
        learned = unescape(self.decode(under)) if len(under) else ""
        return unescape(head), unescape(body), learned, f"{MARKS[0]}{head}{MARKS[1]}{body}{MARKS[2]}"


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, turn, role, text) -> a row per turn with ids and loss mask, a conversation's rows together and in order."""
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.col("text").alias("_text"))
    # the cap on rows of a partition is none of ours: rows are only put in order, a conversation never is one value
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "_role", "_text")

    def run(batches):
        codec, conv, n = Codec(vocabulary), object(), 0
        for b in batches:
            rows = []
            for c, _, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                n = n + 1 if c == conv else 0
                conv = c
                rows.append((c, n, role or "", *codec.turn_ids(role or "", text or "")))
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return dealt.mapInArrow(run, SCHEMA)


def _batch(rows):
    c, n, role, ids, loss = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(role, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.int8()))],
        ["conv_id", "turn_no", "role", "ids", "loss"],
    )


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What format_turns() wrote, decoded: a row of digests per conversation. Expects its order of rows."""

    def run(batches):
        codec, conv, state = Codec(vocabulary), object(), None

        def close():
            n, turns, chars, learned, shown, tokens, masked = state
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((conv, pa.int64()), (n, pa.int64()), (turns.hexdigest(), pa.string()), (chars, pa.int64()), (learned.hexdigest(), pa.string()), (shown, pa.int64()), (tokens, pa.int64()), (masked, pa.int64()))],
                [x.split()[0] for x in DIGEST.split(", ")],
            )

        for b in batches:
            for c, ids, loss in zip(b.column("conv_id").to_pylist(), b.column("ids"), b.column("loss")):
                if c != conv or state is None:
                    if state is not None:
                        yield close()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, loss = ids.values.to_numpy(zero_copy_only=False), loss.values.to_numpy(zero_copy_only=False)
                role, text, learned, shown = codec.read_turn(ids, loss)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(shown)
                state[5] += len(ids)
                state[6] += int(loss.sum())
        if state is not None:
            yield close()

    return formatted.mapInArrow(run, DIGEST)


def conversations(formatted: DataFrame) -> DataFrame:
    """A row per conversation with its whole ids and loss; for conversations that fit a training context."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", "ids", "loss")))
    flat = formatted.groupBy("conv_id").agg(parts.alias("_p"))
    return flat.select("conv_id", F.flatten(F.transform("_p", lambda p: p.ids)).alias("ids"), F.flatten(F.transform("_p", lambda p: p.loss)).alias("loss"))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation of two turns whose texts hold control strings."""
    said = r"\### Assistant: </turn> ok"
    turn = F.col("id").alias("turn")
    return spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
