"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the model's compiled character map: at each place the longest source prefix
that the map's double-array trie holds is replaced, and every byte that comes out keeps the source byte
it came from. The normalised text is cut into words where no piece can cross (the vocabulary has no piece with a
word mark after another character; checked when a model is read), each new word is merged once by the library's
merges, with all normalisation taken out of its model, and remembered. Each piece's span is projected through the
alignment to bytes of the original text. Models of another kind are merged whole; byte fallback is needed.

Null text is empty. Empty text: the end id only. Repeated rows and null ids pass through. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of words and ids that a task remembers.
CACHED = 16 << 20


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes):
    """(number, value, the field's own bytes) of a protocol buffer message's fields."""
    i = 0
    while i < len(b):
        first = i
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        elif key & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value, b[first:i]


class CharMap:
    """A compiled character map: a double-array trie over source bytes, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.texts = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, i: int) -> tuple[int, bytes] | None:
        """Length of the longest source prefix at ``i`` that the map holds, and its replacement."""
        if not self.units:
            return None
        at, found = self._offset(self.units[0]), None
        for j in range(i, len(data)):
            at ^= data[j]
            if at >= len(self.units) or self.units[at] & 0x800000FF != data[j]:
                break
            unit = self.units[at]
            at ^= self._offset(unit)
            if unit >> 8 & 1:
                found = j - i + 1, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Model:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self._read(f.read())

    def _read(self, blob: bytes) -> None:
        self.texts: list[str] = []
        self.kinds: list[int] = []
        norm, trainer, raw = {}, {}, []
        for k, v, whole in _fields(blob):
            if k != 3:
                raw.append(whole)
            if k == 1:
                piece = dict(x[:2] for x in _fields(v))
                self.texts.append(piece[1].decode())
                self.kinds.append(piece.get(3, NORMAL))
            elif k == 2:
                trainer = dict(x[:2] for x in _fields(v))
            elif k == 3:
                norm = dict(x[:2] for x in _fields(v))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("a merge model without user-defined pieces and with leading word marks is needed")
        self.map = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if self.kinds.count(BYTE) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.end = trainer.get(42, 2)
        self.width = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(self.texts, self.kinds)], np.int64)
        self.surface = [bytes([int(t[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds)]
        self.by_word = not any(MARK in t.lstrip(MARK) for t, k in zip(self.texts, self.kinds) if k == NORMAL)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pieces = pa.array(self.surface, pa.binary())
        self.is_control = np.array([k == CONTROL for k in self.kinds])
        self.is_normal = np.array([k == NORMAL for k in self.kinds])
        # the library merges what is normalised already: the same model without any normalisation of its own
        import sentencepiece

        self.merge = sentencepiece.SentencePieceProcessor(model_proto=b"".join(raw) + b"\x1a\x06\x18\x00\x20\x00\x28\x00")

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each byte of it and its end the source byte it came from."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            mark = MARK if self.escape else " "
            out = (mark if self.prefix else "") + (text.replace(" ", MARK) if self.escape else text)
            width = np.ones(len(data), np.int64)
            if self.escape:
                width[np.frombuffer(data, np.uint8) == 32] = len(MARK.encode())
            source = np.repeat(np.arange(len(data)), width)
            lead = np.zeros(len(mark.encode()) if self.prefix else 0, np.int64)
            return out, np.concatenate([lead, source, [len(data)]])
        return self._rewrite(data)

    def _rewrite(self, data: bytes) -> tuple[str, np.ndarray]:
        out, source = bytearray(), []
        space = MARK.encode() if self.escape else b" "
        i, n = 0, len(data)

        def step(i: int) -> tuple[int, bytes]:
            got = self.map.longest(data, i)
            if got:
                return got
            size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            return size, data[i : i + size]

        if self.squeeze:  # leading space goes
            while i < n:
                size, got = step(i)
                if got != b" ":
                    break
                i += size
        if i == n:
            return "", np.array([n], np.int64)
        if self.prefix:
            out += space
            source += [i] * len(space)
        blank = self.squeeze
        while i < n:
            size, got = step(i)
            while blank and got.startswith(b" "):
                got = got[1:]
            if got:
                for c in got:
                    part = space if c == 32 and self.escape else bytes([c])
                    out += part
                    source += [i] * len(part)
                blank = self.squeeze and got.endswith(b" ")
            i += size
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                n = source[len(out)]
                del source[len(out) :]
        return out.decode(), np.array([*source, n], np.int64)

    # segmentation

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: ids with the end id, and the span of source bytes [begin, end) of each; the end id's is empty."""
        norms = [self.normalise(t) for t in texts]
        known = self.known
        split = [_WORDS.findall(n) if self.by_word else [n] if n else [] for n, _ in norms]
        if self.held > CACHED or not self.by_word:
            self.forget()
        new = list(set().union(*split) - known.keys())
        known.update((w, np.array(ids, np.int32).tobytes()) for w, ids in zip(new, self.merge.encode(new, num_threads=1)))
        self.held += sum(len(w) + len(known[w]) + 100 for w in new)  # and what Python needs for both
        out = []
        for words, (_, source) in zip(split, norms):
            ids = np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.width[ids], out=edges[1:])
            at = source[edges]
            out.append((np.append(ids, np.int32(self.end)), at, np.append(at[1:], at[-1])))
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode_all(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts of runs ``off[i]:off[i + 1]`` of ids. A leading space that normalisation put there goes; bytes that are no UTF-8 become U+FFFD each."""
        if not len(ids):
            return [""] * (len(off) - 1)
        taken = self.pieces.take(pa.array(ids))
        edges = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(ids) + 1][off]
        data = taken.buffers()[2]
        data = b"" if data is None else data.to_pybytes()
        said = np.flatnonzero(~self.is_control[ids])
        out = []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if self.prefix and data[a : a + 1] == b" ":
                k = np.searchsorted(said, off[i])
                if k < len(said) and said[k] < off[i + 1] and self.is_normal[ids[said[k]]]:
                    a += 1
            try:
                out.append(data[a:b].decode())
            except UnicodeDecodeError:
                out.append(_lenient(data[a:b]))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]


_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _lenient(data: bytes) -> str:
    parts, i = [], 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            parts.append(data[i : i + size].decode())
            i += size
        except UnicodeDecodeError:
            parts.append("�")
            i += 1
    return "".join(parts)


@functools.cache
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends): ids with the end id; spans in bytes of the original text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = model(path)
        m.forget()  # of the task before
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = m.encode_all([t or "" for t in part.column(1).to_pylist()])
                off = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(np.concatenate([g[k] for g in got]).astype(np.int32))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "ids", "begins", "ends"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the text of ``ids``; null ids give null."""
    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*[f"`{c}`" for c in names])
    at = names.index("ids")
    out = rows.selectExpr("*", "string(null) decoded").schema

    def run(batches):
        m = model(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column(at)
                ids, sizes = np.asarray(lists.flatten().cast(pa.int64())), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
                known = np.asarray(lists.is_valid())
                texts = [t if ok else None for t, ok in zip(m.decode_all(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), known)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return arrow_map(rows, run, out)
