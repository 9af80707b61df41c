"""Secret scans: three exact patterns, and a conditional random field over words that adds further spans.

Each line's words are tagged secret-begin, secret-inside or outside by Viterbi decoding of a linear chain; features
are a word's shape, its neighbours' cue words and the document's share of digits. The model learns
from words inside exact matches, once as they are and once without their cues, so that shape alone can tell, on a bounded sample: at most ``sample_docs`` distinct texts with a cue and half as many of all,
those with the least hashes. A fifth of the sample's windows is held out: the model is made as cautious as finding these
windows' matches without their cues allows. Without any match in the sample nothing is added.

Spans are (kind, start, end) in code points, end exclusive. Exact ones stay whatever the model
says; the model's (kind ``crf``) are kept where they touch no exact one. Null or empty text: no spans.
Repeated rows and null ids pass through, one result per row.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import arrow_map
from .textkernel import _LOWER, Block, blocks

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
FEATURES = 19
#: Features: has a digit, is a cue, and those that a cue word near by gives.
DIGIT, MIXED, LINK, CUE, CUES = 1, 4, 8, 12, (11, 12, 13)
#: Scores in favour of outside that are tried on held-out windows, and the share of their matches that must still be found.
TRIED, FOUND = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0), 0.95
#: Weight of a window without its cues beside the one with them.
BARE = 3.0
#: Words on each side of a secret that are learnt from.
WINDOW = 25
_EDGE = b".,;:!?()[]{}<>\"'`"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_DIGITS, _CAPS, _SMALL = _table(b"0123456789"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_HEXES, _BODY, _LINK, _HIGH, _AT = _table(b"0123456789abcdef"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), _table(b"=:"), _table(bytes(range(128, 256))), _table(b"@")
_FIRST = np.ones(256, np.int64)
_FIRST[0x80:0xC0] = 0


def exact_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the three patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _finds(data: bytes, what: bytes):
    i = data.find(what)
    while i >= 0:
        yield i
        i = data.find(what, i + 1)


def _scan(buf: np.ndarray, off: np.ndarray):
    """Of a block: its words, which texts may hold an exact match, features by word, and line bounds in words."""
    block, n = Block(buf, off), len(buf)
    low = _LOWER[buf].tobytes()
    cues = np.array(sorted({i for c in _CUES for i in _finds(low, c)}), np.int64)
    hits = set(np.searchsorted(off, cues, "right") - 1)
    hits |= {int(np.searchsorted(off, i, "right")) - 1 for i in _finds(buf.tobytes(), b"AKIA")}
    other = np.concatenate([[-1], np.flatnonzero(_HEXES[buf] == 0), [n]])
    for i in np.flatnonzero(np.diff(other) > 24):  # a run across texts only costs a look
        a, b = np.searchsorted(off, [other[i] + 1, other[i + 1] - 1], "right") - 1
        hits |= set(range(int(a), int(b) + 1))

    s, e = block.starts, block.ends
    size = (e - s).astype(np.float64)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(table[buf], out=sums[1:])
        return sums[e] - sums[s]

    digits, caps, small, hexes, body, link, high, at = map(share, (_DIGITS, _CAPS, _SMALL, _HEXES, _BODY, _LINK, _HIGH, _AT))
    kind = _DIGITS[buf] + 2 * _SMALL[buf] + 3 * _CAPS[buf]
    turns = np.zeros(n + 1, np.int64)
    np.cumsum(np.concatenate([[0], kind[1:] != kind[:-1]]) if n else np.zeros(0, np.int64), out=turns[1:])
    turn = (turns[e] - turns[np.minimum(s + 1, n)]) / np.maximum(size, 1) if len(s) else size
    cue = np.zeros(len(s), bool)
    cue[np.searchsorted(s, cues, "right") - 1] = True
    before, after = np.zeros(len(s), bool), np.zeros(len(s), bool)
    before[1:], after[:-1] = cue[:-1] | (link[:-1] > 0), cue[1:]
    doc_digits = np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(block.bounds)), digits, len(off) - 1) / np.maximum(np.diff(off), 1)
    x = np.zeros((len(s), FEATURES))
    of = np.repeat(doc_digits, np.diff(block.bounds))
    mixed = (digits > 0) & (caps + small > 0)
    for i, v in enumerate((1.0, digits > 0, (caps > 1) & (small > 0), digits / np.maximum(size, 1), mixed, np.minimum(np.log1p(size) / 4, 1.5), (size >= 16) & mixed, (size >= 24) & mixed, link > 0, body == size, turn, before, cue, after, np.minimum(of * 10, 2), high > 0, (hexes >= size - 1) & (size >= 16), (digits >= 3) & mixed & (size >= 12), at > 0)):
        x[:, i] = v
    breaks = np.flatnonzero(buf == 10)
    lines = np.unique(np.concatenate([block.bounds, np.searchsorted(s, breaks)]))
    return block, hits, x, lines


def _points(block: Block, i: int, at: np.ndarray) -> np.ndarray:
    """Code points of byte places inside text i."""
    own = _FIRST[block.buf[block.off[i] : block.off[i + 1]]]
    return np.concatenate([[0], np.cumsum(own)])[at - block.off[i]]


def scan(column: pa.Array, model: crf.Chain | None) -> list[list[tuple[int, int, int]]]:
    """Each text's spans as (start, kind's place in KINDS, end), sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for first, buf, off in blocks(column):
        block, hits, x, lines = _scan(buf, off)
        for i in hits:
            if off[i] < off[i + 1]:
                out[first + i] = exact_spans(buf[off[i] : off[i + 1]].tobytes().decode())
        if model is None or not len(block.starts):
            continue
        labels = crf.viterbi(model, x @ model.weights.T, lines)
        begins = np.flatnonzero(labels == BEGIN)
        if not len(begins):
            continue
        texts = np.searchsorted(block.bounds, begins, "right") - 1
        for w, i in zip(begins, texts):
            last = w
            while last + 1 < block.bounds[i + 1] and labels[last + 1] == INSIDE:
                last += 1
            a, b = int(block.starts[w]), int(block.ends[last])
            while a < b and buf[a] in _EDGE:
                a += 1
            while b > a and buf[b - 1] in _EDGE:
                b -= 1
            if a < b:
                p, q = map(int, _points(block, i, np.array([a, b])))
                if all(q <= s or p >= e for s, k, e in out[first + i] if k < 3):
                    out[first + i].append((p, 3, q))
    return [sorted(s) for s in out]


def _without_cues(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same words as if no cue stood there, so that shapes are learnt too: a bare cue word or sign is outside, the word after it begins the secret."""
    bare = ((x[:, CUE] > 0) | (x[:, LINK] > 0)) & (x[:, DIGIT] == 0) & (y != OUTSIDE)
    x, y = x.copy(), y.copy()
    x[:, list(CUES)] = 0
    x[bare, LINK] = 0  # the cue's own sign goes with it
    y[bare] = OUTSIDE
    y[(y == INSIDE) & (np.concatenate([[OUTSIDE], y[:-1]]) == OUTSIDE)] = BEGIN
    return x, y


def train(docs: DataFrame, sample_docs: int = 600) -> crf.Chain | None:
    """Fit on a bounded sample; the exact patterns give the labels."""
    # the least hashes of distinct texts come first; only texts with these are moved
    key = F.xxhash64("text")
    least = lambda rows, n: [r["k"] for r in rows.select(key.alias("k")).distinct().orderBy("k").limit(n).collect()]
    rows = docs.where(F.col("text").isNotNull()).select("text")
    wanted = sorted({*least(rows.where(F.col("text").rlike(r"AKIA|(?i:passw|secret|token|api_?key)")), sample_docs), *least(rows, sample_docs // 2)})
    if not wanted:
        return None
    sample = rows.where(key.isin(wanted)).groupBy(key.alias("k")).agg(F.min("text").alias("text")).select("text")

    def features(batches):
        for b in batches:
            for first, buf, off in blocks(b.column(0)):
                block, hits, x, lines = _scan(buf, off)
                for i in range(len(off) - 1):
                    lo, hi = block.bounds[i], block.bounds[i + 1]
                    y = np.zeros(hi - lo, np.int8)
                    if i in hits:
                        place = _points(block, i, np.concatenate([block.starts[lo:hi], block.ends[lo:hi]]))
                        a, z = place[: hi - lo], place[hi - lo :]
                        for s, _, e in exact_spans(buf[off[i] : off[i + 1]].tobytes().decode()):
                            inside = np.flatnonzero((a < e) & (z > s))
                            y[inside] = INSIDE
                            y[inside[:1]] = BEGIN
                    own = lines[(lines >= lo) & (lines <= hi)]
                    # of a line with a secret the words around it; of three other lines of each text those around a word of letters and digits; of
                    # the first two lines else the first words
                    odd = 0
                    for n, (p, q) in enumerate(zip(own[:-1], own[1:])):
                        marked = np.flatnonzero(y[p - lo : q - lo]) + p
                        like = marked if len(marked) or odd == 3 else np.flatnonzero(x[p:q, MIXED]) + p
                        odd += len(like) > len(marked)
                        if len(like) or n < 2:
                            p, q = (max(p, like[0] - WINDOW), min(q, like[0] + WINDOW)) if len(like) else (p, min(q, p + WINDOW))
                            seen = [(x[p:q], y[p - lo : q - lo])]
                            if len(marked):
                                seen.append(_without_cues(*seen[0]))
                            yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f4").tobytes() for v, _ in seen], pa.binary()), pa.array([v.tobytes() for _, v in seen], pa.binary())], ["x", "y"])

    got = sorted({(bytes(r["x"]), bytes(r["y"])) for r in arrow_map(sample, features, "x binary, y binary").toLocalIterator()})
    if not any(any(y) for _, y in got):
        return None
    x, y = ([np.frombuffer(v[i], t).reshape(-1, *more) for v in got] for i, t, more in ((0, "<f4", (FEATURES,)), (1, np.int8, ())))
    own = np.array([zlib.crc32(v[0]) % 5 > 0 for v in got])
    model = _fit([v for v, k in zip(x, own) if k], [v for v, k in zip(y, own) if k]) if any(v.any() for v, k in zip(y, own) if k) else _fit(x, y)
    caution = _caution(model, [v for v, k in zip(x, own) if not k], [v for v, k in zip(y, own) if not k])
    weights = model.weights.copy()
    weights[OUTSIDE, 0] += caution  # the first feature is 1 for all words
    return crf.Chain(weights, model.moves, model.start)


def _fit(x: list[np.ndarray], y: list[np.ndarray]) -> crf.Chain:
    bare = np.array([BARE if v.any() and not w[:, list(CUES)].any() else 1.0 for w, v in zip(x, y)])
    return crf.fit(np.concatenate(x).astype(np.float64), np.concatenate(y), np.concatenate([[0], np.cumsum([len(v) for v in y])]), 3, weight=bare, rounds=150, l2=1e-5, rate=0.5, banned=[(OUTSIDE, INSIDE)], banned_start=[INSIDE])


def _caution(model: crf.Chain, x: list[np.ndarray], y: list[np.ndarray]) -> float:
    """The largest score in favour of outside with which ``FOUND`` of the words of exact matches are still tagged where the held-out windows' cues are taken out.

    Words outside matches can't tell: a secret that no pattern knows stands among them.
    """
    bare = [(w, v) for w, v in zip(x, y) if v.any() and not w[:, list(CUES)].any()]
    if not bare:
        return TRIED[2]
    scores, truth = np.concatenate([w for w, _ in bare]).astype(np.float64) @ model.weights.T, np.concatenate([v for _, v in bare])
    off = np.concatenate([[0], np.cumsum([len(v) for _, v in bare])])
    found = [(crf.viterbi(model, scores + c * (np.arange(3) == OUTSIDE), off)[truth != OUTSIDE] != OUTSIDE).mean() for c in TRIED]
    return max((c for c, f in zip(TRIED, found) if f >= FOUND), default=TRIED[0])


def find(docs: DataFrame, model: crf.Chain | None) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end), in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in scan(b.column(1), model)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, shape)], ["doc_id", "found"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, model: crf.Chain | None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark`` and n_chars counted anew where a text changed."""

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            found = scan(b.column(at), model)
            if any(found):
                texts = b.column(at).to_pylist()
                n = b.schema.get_field_index("n_chars")
                sizes = b.column(n).to_pylist() if n >= 0 else None
                for i, spans in enumerate(found):
                    if spans:
                        text, out, end = texts[i], [], 0
                        for s, _, e in spans:
                            if s >= end:
                                out += [text[end:s], mark]
                            end = max(end, e)
                        texts[i] = "".join([*out, text[end:]])
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                columns = list(b.columns)
                columns[at] = pa.array(texts, b.schema.field(at).type)
                if sizes is not None:
                    columns[n] = pa.array(sizes, b.schema.field(n).type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return arrow_map(docs, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the exact spans' hash and all spans as text, from ``find``'s rows."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(said(F.filter("found", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
