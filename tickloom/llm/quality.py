"""Quality rules: counts over whole texts, and a conditional random field that labels lines.

Lines (split at \\n) are tagged content or boilerplate by Viterbi decoding of a linear-chain model;
a document is retained when at least ``min_share`` of its words lie in content lines. The model is
fitted on a bounded sample of labelled documents (``sample_docs``; of each at most ``sample_lines``
lines), a line taking its document's quality as its label; without two classes in the sample,
fixed weights for symbols, bars and capitals are used.

Null or empty text: no words, all counts 0, base_failed, not kept. Lines without a word have no weight.
Repeated rows and null ids pass through, one result per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import arrow_map
from .textkernel import _BYTE, Block, blocks, hash_runs, mix, windows

SYMBOLS = b"#*$%&|<>"
FEATURES = 14
CONTENT, BOILERPLATE = 0, 1
MIN_SHARE = 0.5


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL, _BAR, _UPPER, _DIGIT, _BANG, _STOP = map(_flags, (SYMBOLS, b"|", bytes(range(65, 91)), b"0123456789", b"!", b".,;:"))
_FIRST = np.ones(256, np.int64)
_FIRST[0x80:0xC0] = 0
_FINAL = _flags(b".!?\"")
DEFAULT = crf.Chain(np.array([[1.0] + [0.0] * (FEATURES - 1), [0, 0, 12.0, 4, 4, 0, 2, 0, 0, 2, 0, 0, 0, 0]]), np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


def _between(table: np.ndarray, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(table[buf], out=sums[1:])
    return sums[b] - sums[a]


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Of each text of a block the base counts; of each line (``line_off``: by text) its words and features."""
    block, docs = Block(buf, off), len(off) - 1
    n_words = np.diff(block.bounds)
    doc_of_word = np.repeat(np.arange(docs), n_words)
    out = {"n_words": n_words, "n_symbols": _between(_SYMBOL, buf, off[:-1], off[1:])}
    per_word = _between(_FIRST, buf, block.starts, block.ends)
    out["word_chars"] = np.bincount(doc_of_word, per_word, docs).astype(np.int64)

    # words inside 3-word windows that the same text holds twice or more
    covered = np.zeros(len(doc_of_word), bool)
    if len(doc_of_word) >= 3:
        h = windows(block.hashes(lower=False), 3)
        own = np.flatnonzero(doc_of_word[:-2] == doc_of_word[2:])
        key = mix(h[own] + mix(doc_of_word[own].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(own), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for i in range(3):
            covered[own[again] + i] = True
    out["n_repeat_words"] = np.bincount(doc_of_word[covered], minlength=docs)

    # lines: each text has one more than it has \n
    breaks = np.flatnonzero(buf == 10)
    at = np.searchsorted(breaks, off)
    n_lines = np.diff(at) + 1
    line_off = np.concatenate([[0], np.cumsum(n_lines)])
    a, b = np.empty(line_off[-1], np.int64), np.empty(line_off[-1], np.int64)
    a[line_off[:-1]] = off[:-1]
    b[line_off[1:] - 1] = off[1:]
    head = np.ones(line_off[-1], bool)
    head[line_off[:-1]] = False
    tail = np.ones(line_off[-1], bool)
    tail[line_off[1:] - 1] = False
    a[head], b[tail] = breaks + 1, breaks
    doc_of_line = np.repeat(np.arange(docs), n_lines)
    words = np.searchsorted(block.starts, b) - np.searchsorted(block.starts, a)

    key = mix(hash_runs(_BYTE, buf, a, b) + mix(doc_of_line.astype(np.uint64) + np.uint64(1)))
    some = np.flatnonzero(words > 0)
    order = some[np.argsort(key[some], kind="stable")]
    dup = np.zeros(len(a), bool)
    dup[order[1:][key[order][1:] == key[order][:-1]]] = True
    out["n_dup_lines"] = np.bincount(doc_of_line[dup], minlength=docs)

    chars = np.maximum(_between(_FIRST, buf, a, b), 1)
    w = np.maximum(words, 1)
    symbols = _between(_SYMBOL, buf, a, b)
    last = buf[np.maximum(b - 1, 0)] if len(buf) else np.zeros(len(a), np.uint8)
    x = np.zeros((len(a), FEATURES))
    for i, v in enumerate((1.0, np.log1p(words) / 4, symbols / chars, np.minimum(_between(_BAR, buf, a, b) / w, 1), _between(_UPPER, buf, a, b) / chars, _between(_DIGIT, buf, a, b) / chars, np.minimum(_between(_BANG, buf, a, b) / w, 1), (_FINAL[last] > 0) & (b > a), chars / w / 10, dup, np.minimum(_between(_STOP, buf, a, b) / w, 1), words < 4, symbols > 0, (out["n_repeat_words"] / np.maximum(n_words, 1))[doc_of_line])):
        x[:, i] = np.minimum(v, 4.0)
    return out | {"line_off": line_off, "line_words": words, "x": x}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(column: pa.Array, model: crf.Chain, min_share: float) -> list[pa.Array]:
    """The counts, words in content lines, base_failed, kept, and the lines' labels of each row."""
    parts = []
    for _, buf, off in blocks(column):
        m = measure(buf, off)
        labels = crf.viterbi(model, m["x"] @ model.weights.T, m["line_off"])
        content = np.add.reduceat(np.append(m["line_words"] * (labels == CONTENT), 0), m["line_off"][:-1])
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~failed & (content >= min_share * m["n_words"])
        parts.append([*(m[c].astype(np.int64) for c in COUNTS), content.astype(np.int64), failed, kept, labels.astype(np.int32), m["line_off"]])
    if not parts:
        return [pa.array([], pa.int64())] * 6 + [pa.array([], pa.bool_())] * 2 + [pa.array([], pa.list_(pa.int32()))]
    flat = [pa.array(np.concatenate([p[i] for p in parts])) for i in range(8)]
    lists = [pa.ListArray.from_arrays(pa.array(p[9].astype(np.int32)), pa.array(p[8])) for p in parts]
    return [*flat, pa.concat_arrays(lists)]


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000, sample_lines: int = 200) -> crf.Chain:
    """Fit on at most ``sample_docs`` labelled documents, those whose ids have the least hashes."""
    few = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # one text of each id, so that a repeated id counts once
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text", "doc_id")

    def lines(batches):
        for b in batches:
            for i, buf, off in blocks(b.column(1)):
                m = measure(buf, off)
                for k in range(len(off) - 1):
                    own = np.arange(m["line_off"][k], m["line_off"][k + 1])
                    own = own[m["line_words"][own] > 0][:sample_lines]
                    yield pa.RecordBatch.from_arrays([b.column(2).slice(i + k, 1), b.column(0).slice(i + k, 1).cast(pa.int32()), pa.array([m["x"][own].astype("<f8").tobytes()], pa.binary())], ["doc_id", "quality", "x"])

    got = sorted({(r["doc_id"], r["quality"], bytes(r["x"])) for r in arrow_map(rows, lines, "doc_id long, quality int, x binary").toLocalIterator()})
    got = [(q, np.frombuffer(x, "<f8").reshape(-1, FEATURES)) for _, q, x in got if x]
    if len({q for q, _ in got}) < 2:
        return DEFAULT
    x = np.concatenate([v for _, v in got])
    off = np.concatenate([[0], np.cumsum([len(v) for _, v in got])])
    y = np.concatenate([np.full(len(v), BOILERPLATE if q == 0 else CONTENT) for q, v in got])
    return crf.fit(x, y, off, 2)


def judge(docs: DataFrame, model: crf.Chain, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, the base counts, content_words, base_failed, kept and ``line_labels`` (0 content, 1 boilerplate)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *_judge(b.column(1), model, min_share)], ["doc_id", *COUNTS, "content_words", "base_failed", "kept", "line_labels"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, content_words long, base_failed boolean, kept boolean, line_labels array<int>")


def retain(docs: DataFrame, model: crf.Chain, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents that are kept, with their own columns, in one pass without a shuffle."""

    def run(batches):
        for b in batches:
            yield b.filter(_judge(b.column(b.schema.get_field_index("text")), model, min_share)[7])

    return arrow_map(docs, run, docs.schema)
