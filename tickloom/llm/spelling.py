"""Spelling variants: the whole one-edit neighbourhood of each word, joined to the vocabulary by hash.

Words are counted in tasks and summed by word. For each word of the vocabulary all deletions, replacements and insertions over the observed
alphabet are generated, each distinct result once; a join on the text finds those that are words, so distances need no check.
A task hashes the candidates of many words at once, from hashes of prefixes and suffixes, and
spells out only those whose hash is in a filter of fixed size over the vocabulary: the others are surely no words, so the join
loses nothing and its input is near the number of true neighbours. A form has at least twice the word's count, so chains of forms are short;
they are followed by doubling, with a join each time.

Null texts have no words, a null id counts as the empty text; rows that repeat are counted each time. Ties between forms go to the smaller in code-point order. Extra columns are not read;
an empty table gives no rows. Words may have any length: candidates are generated in blocks of places.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bit_filter, cut, in_filter

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LEAST_LENGTH, LEAST_COUNT, EVERY = 5, 3, 97
#: Words that a task counts before it hands them on; candidates that it hashes at a time.
HELD, LOT = 200_000, 1 << 20
BITS = 25
BASE = np.uint64(0x9E3779B97F4A7C15)


def spoilt(run: str, h: int, every: int = EVERY) -> str:
    """The run without one code point, if ``every`` divides its hash."""
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _runs(text: str):
    """Counts of a text's runs; of a long text, of so many at a time."""
    if len(text) < LOT:
        yield Counter(RUN.findall(text))
        return
    found = (m[0] for m in RUN.finditer(text))
    while part := Counter(islice(found, HELD)):
        yield part


def words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of each word of at least ``least`` code points over all texts."""

    def count(batches):
        held: Counter = Counter()

        def settle():
            yield pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for name, text in zip(b.column(0), b.column(1)):
                start = zlib.crc32(f"{name.as_py()}:".encode())
                for part in _runs(text.as_py()):
                    for run, n in part.items():
                        run = run.lower() if run.isascii() else run.translate(LOWER)
                        word = spoilt(run, zlib.crc32(run.encode(), start))
                        if len(word) >= least:
                            held[word] += n
                    if len(held) > HELD:
                        yield from settle()
        yield from settle()

    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text"))
    return arrow_map(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(x: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(1)) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE | np.uint64(1)))])


def _bits(h: np.ndarray, n: int = 3) -> list[np.ndarray]:
    """The first n of a hash's three places in the filter."""
    with np.errstate(over="ignore"):
        return [((h * np.uint64(c)) >> np.uint64(64 - BITS)).view(np.int64) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[:n]]


def points(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def hashes(x: np.ndarray) -> np.ndarray:
    """Sum of letters' numbers times powers by place, modulo 2^64."""
    with np.errstate(over="ignore"):
        return (_letters(x) * _powers(x.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _by_length(column: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in column:
        out.setdefault(len(w), []).append(w)
    return out


def neighbours(words: list[str], alphabet: np.ndarray, seen: np.ndarray):
    """(word, candidate) for all distinct one-edit results of words of one length whose hash is in the filter, in bounded lots.

    A letter is deleted at the last place of a run of equals only, and inserted only before a letter other than itself, so that no result comes twice.
    """
    x = points(words)
    n, size = x.shape
    power, own = _powers(size + 1), _letters(x)
    marks = _letters(alphabet)
    with np.errstate(over="ignore"):
        terms = own * power[:size]
        head = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)  # before each place
        later = head[:, -1:] - head  # from each place on
        up, down = own * power[1 : size + 1], own[:, 1:] * power[: size - 1]
        after_up = np.concatenate([np.cumsum(up[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), np.uint64)], axis=1)  # from each place on, moved up by one
        after_down = np.concatenate([np.cumsum(down[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1], np.zeros((n, 1), np.uint64)], axis=1)  # beyond each place, moved down by one

        def hits(h, fits):
            where = np.nonzero(fits & in_filter(_bits(h, 1)[0], seen))
            ok = np.logical_and.reduce([in_filter(place, seen) for place in _bits(h[where])])
            return tuple(w[ok] for w in where)

        last = np.concatenate([x[:, 1:] != x[:, :-1], np.ones((n, 1), bool)], axis=1)
        step = max(1, LOT // max(1, n * len(alphabet)))
        for lo in range(0, size, step * len(alphabet)):
            at = slice(lo, min(size, lo + step * len(alphabet)))
            for i, p in zip(*hits(head[:, :size][:, at] + after_down[:, at], last[:, at])):
                yield words[i], words[i][: lo + p] + words[i][lo + p + 1 :]
        for lo in range(0, size + 1, step):
            at = slice(lo, min(size, lo + step))
            if lo < size:
                h = (head[:, :size][:, at] + later[:, 1:][:, at])[:, :, None] + marks * power[:size][at][None, :, None]
                for i, p, c in zip(*hits(h, x[:, at][:, :, None] != alphabet)):
                    yield words[i], words[i][: lo + p] + chr(alphabet[c]) + words[i][lo + p + 1 :]
            at = slice(lo, min(size + 1, lo + step))
            h = (head[:, at] + after_up[:, at])[:, :, None] + marks * power[: size + 1][at][None, :, None]
            following = np.concatenate([x, np.full((n, 1), 0xFFFFFFFF, np.uint32)], axis=1)[:, at]
            for i, p, c in zip(*hits(h, following[:, :, None] != alphabet)):
                yield words[i], words[i][: lo + p] + chr(alphabet[c]) + words[i][lo + p :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for words of ``vocabulary(word, n)`` one edit apart. The alphabet and the filter, both of bounded size, go to all tasks."""
    spark = vocabulary.sparkSession

    def letters(batches):
        seen: set[str] = set()
        for b in batches:
            seen |= set("".join(b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["c"])

    def places(batches):
        for b in batches:
            for own in _by_length(b.column(0).to_pylist()).values():
                for part in np.array_split(np.arange(len(own)), min(len(own), 1 + len(own) * len(own[0]) // LOT)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_bits(hashes(points([own[i] for i in part])))))], ["h"])

    # the letters are those of the runs' pattern, 90 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in arrow_map(vocabulary.select("word"), letters, "c string").distinct().collect()), np.uint32)
    seen = spark.sparkContext.broadcast(bit_filter(arrow_map(vocabulary.select("word"), places, "h long"), "h", BITS))

    def generate(batches):
        for b in batches:
            out, held = ([], []), 0
            for size, own in _by_length(b.column(0).to_pylist()).items():
                some = max(1, LOT // (len(alphabet) * size))
                for i in range(0, len(own), some):
                    for word, candidate in neighbours(own[i : i + some], alphabet, seen.value):
                        out[0].append(word)
                        out[1].append(candidate)
                        held += 2 * size
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in out], ["word", "near"])
                            out, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.string()) for o in out], ["word", "near"])

    found = arrow_map(vocabulary.select("word"), generate, "word string, near string")
    return found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last form of the chain that starts at the word. Each round doubles the steps taken."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = cut(at.join(at.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        at = after.select("word", "root")


def group(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word. Runs jobs while the plan is built: the vocabulary, near words and chains are written."""
    vocabulary = cut(words(docs, least_length).where(F.col("n") >= least_count))
    best = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    fits = F.col("form_n") >= ratio * F.col("n")
    known = cut(joined.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
