"""Best-fit decreasing packing of tokenised documents into sequences of fixed length.

Lengths are at most ``capacity``, so their histogram is bounded whatever the number of documents.
Best-fit decreasing runs on the histogram: a segment tree over remaining capacities finds the tightest open
sequence in logarithmic time, and equal pieces are placed together, as one by one they would go to the same sequences.
The plan's steps say for each length which ranks go to which sequences; pieces get their rank among equals
from counts by task, and look their place up. So packing is global, and no task holds more than its rows.

Null or empty text: the end id only, one piece of length 1. Rows that repeat an id are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut

CAPACITY = 2048
#: Letters, and other characters of texts that are split here; texts with any other are left to the tokenizer whole.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\t\n\r -~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€{_LETTERS}]")
#: The byte-level pre-split, for such texts.
_SPLIT = re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^ \t\n\r{_LETTERS}0-9]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: Bytes of words and ids that a task remembers.
CACHED = 16 << 20


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class _Known(dict):
    """Ids of the words met so far; a new word is merged when it is looked up."""

    def __init__(self, merge) -> None:
        self.merge, self.held = merge, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        self.held += len(word) + len(out) + 100  # and what Python needs for both
        return out

    def clear(self) -> None:
        super().clear()
        self.held = 0


class Encoder:
    """Ids as little-endian bytes. Pre-split words are merged once each and remembered.

    Where ids follow the order of merges, new words are merged by rank, which gives the tokenizer's ids faster.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.added, letters = {t["content"] for t in whole.get("added_tokens", [])}, _byte_letters()
        vocab = {t: i for t, i in whole["model"]["vocab"].items() if t not in self.added}
        merges = [m if isinstance(m, str) else " ".join(m) for m in whole["model"]["merges"]]
        pre = whole.get("pre_tokenizer") or {}
        first = len(vocab) - len(merges)
        self.ranked = None
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and whole.get("normalizer") is None and first == 256 and all(vocab.get(m.replace(" ", "", 1)) == first + i for i, m in enumerate(merges)):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            self.ranked = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
            # one piece at a time, without the pattern
            self.known = _Known(self.ranked._core_bpe.encode_single_piece)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            # an added token's string in a text is that token, as the tokenizer has it
            if self.ranked is None or _OTHER.search(t) or any(a in t for a in self.added):
                out.append(self._whole(t))
            else:
                if self.known.held > CACHED:
                    self.known.clear()
                out.append(b"".join(map(self.known.__getitem__, _SPLIT.findall(t))))
        return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): a document's pieces; place counts equal lengths of a task.

    Of a document longer than ``capacity`` all pieces but the first are whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, seen, task = Encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for i, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n, start, k = len(ids) // 4, 0, 0
                    while start < n:
                        size = (n - start - 1) % capacity + 1
                        rows.append((i, k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), task, int(seen[size])))
                        seen[size] += 1
                        start, k = start + size, k + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long")


class Tightest:
    """A segment tree over remaining capacities 0..n: the least one that holds an open sequence and is at least x."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, i: int, some: bool) -> None:
        i += self.size
        self.some[i] = some
        while i > 1:
            i >>= 1
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        while not self.some[i]:
            while i & 1:  # a right child: go up
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.size


@dataclass(frozen=True)
class Step:
    """Ranks ``rank``.. of ``length`` go to sequences ``first``.., ``each`` to one, from ``offset`` on."""

    length: int
    rank: int
    first: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Step], int]:
    """Best-fit decreasing over (length: pieces); the steps by length and rank, and the number of sequences."""
    tree, open_, steps, n = Tightest(capacity), {}, [], 0

    def keep(left: int, first: int, count: int) -> None:
        if left and count:
            open_.setdefault(left, []).append((first, count))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rest, rank = histogram[length], 0
        while rest:
            left = tree.at_least(length)
            if left is None:
                left, each = capacity, capacity // length
                first, count = n, -(-rest // each)
                n += count
            else:
                each = left // length
                first, count = open_[left].pop()
                if not open_[left]:
                    del open_[left]
                    tree.set(left, False)
            put = min(rest, count * each)
            steps.append(Step(length, rank, first, each, capacity - left))
            whole, part = divmod(put, each)
            keep(left, first + whole + bool(part), count - whole - bool(part))
            keep(left - part * length, first + whole, int(bool(part)))
            keep(left - each * length, first, whole)
            rest, rank = rest - put, rank + put
    return steps, n


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece's place in a sequence."""
    placed = cut(pieces(docs, path, capacity))
    counts = placed.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    steps, _ = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = placed.sparkSession.sparkContext.broadcast(np.array([(s.length, s.rank, s.first, s.each, s.offset) for s in steps], np.int64).reshape(-1, 5))
    kind = placed.schema["doc_id"].dataType.simpleString()
    ranked = placed.join(before.drop("n"), ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def run(batches):
        steps = table.value
        order = np.lexsort((steps[:, 1], steps[:, 0]))
        steps = steps[order]
        key = steps[:, 0] * (1 << 50) + steps[:, 1]
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            s = steps[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1]
            i = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(s[:, 2] + i // s[:, 3]), pa.array(s[:, 4] + i % s[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(ranked, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
