"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector. A trigram's vector is the elementwise product (binding) of its
letters' vectors, permuted by their place; a document's vector is the sum (bundle) over all its trigrams;
a language's prototype is the bundle over its training documents, counted over all of them. A
document takes the language whose prototype has the largest cosine with its vector.

Null or letterless text: ``und``, score 0. Without any training document: ``und`` too. Ties go to the
language that sorts first. Repeated rows and null ids pass through, one result per row. Extra columns
of the input are kept only where the function says so.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Letters a-z, the gap between words, and bins for all other letters.
LETTERS, GAP, OTHER = 26, 26, 101
ALPHABET = LETTERS + 1 + OTHER
DIM = 512
#: Counts that a task holds before it hands them on; trigrams bound at a time.
HELD, PART = 1 << 18, 1 << 12
#: Of a language's right rows one in ``RARE`` may score below a floor; ``ENOUGH`` of them make one. Scores are counted in ``STEPS``.
RARE, ENOUGH, STEPS = 1000, 100, 1024


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point of the basic plane: its letter, or GAP. Case is folded; letters beyond a-z share bins."""
    table = np.full(0x10000, GAP, np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 97 if 97 <= low <= 122 else LETTERS + 1 + low * 2654435761 % 4294967296 * OTHER // 4294967296
    return table


@functools.cache
def letter_vectors(dim: int, seed: int = 7) -> np.ndarray:
    """(3, ALPHABET, dim) of +-1: the letters' vectors, permuted once for each place from the trigram's end."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base = rng.integers(0, 2, (ALPHABET, dim), dtype=np.int8) * 2 - 1
    permute = rng.permutation(dim)
    return np.stack([base[:, permute][:, permute], base[:, permute], base])


def bound(codes: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of trigrams, from the letters' vectors of each place."""
    a, b, c = letter_vectors(dim)
    return a[codes // (ALPHABET * ALPHABET)] * b[codes // ALPHABET % ALPHABET] * c[codes % ALPHABET]


def trigrams(column: pa.Array):
    """For each text: (codes, counts, has a letter). Runs of non-letters are one gap; gaps edge the text."""
    table = _classes()
    for text in column:
        s = text.as_py()
        if not s:
            yield None
            continue
        cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = table[np.minimum(cp, 0xFFFF)]
        if (cp > 0xFFFF).any():
            for i in np.flatnonzero(cp > 0xFFFF):
                if chr(cp[i]).isalpha():
                    cls[i] = LETTERS + 1 + int(cp[i]) * 2654435761 % 4294967296 * OTHER // 4294967296
        gap = cls == GAP
        if gap.all():
            yield None
            continue
        keep = np.ones(len(cls), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        x = np.concatenate([[GAP], cls[keep], [GAP]]).astype(np.int32)
        codes = x[:-2] * (ALPHABET * ALPHABET) + x[1:-1] * ALPHABET + x[2:]
        yield np.unique(codes, return_counts=True)


def prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of each non-null language of ``docs``, from all its rows.

    Tasks count trigrams per language; counts are summed by (language, trigram) before any vector
    is made, so that a language with a third of all rows is spread and pre-aggregated. What reaches
    the driver is one vector of ``dim`` numbers per language.
    """

    def count(batches):
        held: dict[str, list] = {}
        n = 0

        def settle():
            for name, parts in held.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(sums)], ["lang", "code", "n"])
            held.clear()

        for b in batches:
            for name, got in zip(b.column(1).to_pylist(), trigrams(b.column(0))):
                if got is not None:
                    held.setdefault(name, []).append(got)
                    n += len(got[0])
                    if n > HELD:
                        yield from settle()
                        n = 0
        yield from settle()

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, codes, n = np.asarray(b.column(0).to_pylist(), object), np.asarray(b.column(1)), np.asarray(b.column(2))
            for name in sorted(set(names)):
                own = names == name
                for part in np.array_split(np.flatnonzero(own), max(1, int(own.sum()) // 4096)):
                    sums[name] = sums.get(name, np.zeros(dim)) + n[part].astype(np.float64) @ bound(codes[part], dim).astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["lang", "v"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = arrow_map(rows, count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    parts = arrow_map(counts, bundle, "lang string, v array<double>")
    each = _sum_vectors(parts)
    return {k: v / max(np.linalg.norm(v), 1e-300) for k, v in sorted((r["lang"], np.array(r["v"])) for r in each.toLocalIterator())}


def _sum_vectors(parts: DataFrame) -> DataFrame:
    cells = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return cells.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def judge(models: dict[str, np.ndarray], dim: int = DIM):
    """A function from a string column to (languages, scores)."""
    run = sized(models, dim)
    return lambda column: run(column)[:2]


def sized(models: dict[str, np.ndarray], dim: int = DIM):
    """A function from a string column to (languages, scores, sizes); a size is the bits of the number of trigrams."""
    names = sorted(models)
    matrix = np.stack([models[k] for k in names]).T.astype(np.float32) if names else np.zeros((dim, 0), np.float32)

    def run(column: pa.Array) -> tuple[list[str], list[float], list[int]]:
        pred, score, size = [], [], []
        for got in trigrams(column):
            if got is None or not names:
                pred.append("und")
                score.append(0.0)
                size.append(0)
                continue
            codes, n = got
            v = sum(n[i : i + PART].astype(np.float32) @ bound(codes[i : i + PART], dim).astype(np.float32) for i in range(0, len(codes), PART))
            cos = (v @ matrix) / max(float(np.linalg.norm(v)), 1e-30)
            k = int(np.argmax(cos))
            pred.append(names[k])
            score.append(float(min(1.0, max(0.0, cos[k]))))
            size.append(int(n.sum()).bit_length())
        return pred, score, size

    return run


def classify(docs: DataFrame, models: dict[str, np.ndarray], text: str = "text", dim: int = DIM) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) in place of its text, other columns kept; columns already so named are replaced."""
    kept = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    out = rows.drop("__text").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}).schema
    run = judge(models, dim)

    def each(batches):
        for b in batches:
            pred, score = run(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return arrow_map(rows, each, out)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo ``folds``, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out; predict every row: doc_id, held_out, lang_pred, score."""
    models = prototypes(docs.where(~held_out()))
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), models).select("doc_id", "held_out", "lang_pred", "score")


def floors(docs: DataFrame, models: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """Of each language, by size of a text, the score below which at most one in ``RARE`` of the rows of ``docs`` that get their own language lies.

    Where a size has fewer than ``ENOUGH`` such rows, shorter ones, which score less, are taken with it; where these don't suffice, the floor is 0: a few letters
    prove nothing. Larger sizes than any seen have the last floor. The driver gets counts by language, size and step of score.
    """
    run = sized(models)

    def count(batches):
        found = Counter()
        for b in batches:
            pred, score, size = run(b.column(0))
            found.update((p, k, int(x * STEPS)) for p, x, k, own in zip(pred, score, size, b.column(1).to_pylist()) if p == own)
        rows = list(found)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2)], pa.array(list(found.values()), pa.int64())], ["lang", "size", "step", "n"])

    counts: dict[str, np.ndarray] = {}
    for r in arrow_map(docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"), count, "lang string, size int, step int, n long").groupBy("lang", "size", "step").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["lang"], np.zeros((64, STEPS + 1), np.int64))[r["size"], r["step"]] += r["n"]
    out = {}
    for name, by_size in counts.items():
        out[name] = []
        for size in range(len(by_size)):
            # from this size down to where there are enough
            enough = np.flatnonzero(np.cumsum(by_size[size::-1].sum(1)) >= ENOUGH)
            pooled = by_size[size - enough[0] : size + 1].sum(0) if len(enough) else np.zeros(1, np.int64)
            out[name].append(int(np.argmax(np.cumsum(pooled) * RARE > pooled.sum())) / STEPS)
    return out


def keep_languages(docs: DataFrame, languages: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """Documents in a learned language (of ``languages``, if given) that score ``min_score`` or more; their own columns.

    A text whose score lies under its language's floor (``floors``, learned as the prototypes are) is in none of them. One Arrow pass drops rows in place: no join and no
    shuffle of texts.
    """
    learned = docs.where(~held_out())
    models = prototypes(learned)
    run, floor = sized(models), floors(learned, models)

    def each(batches):
        for b in batches:
            keep = [p != "und" and x >= max(min_score, floor[p][k] if p in floor else 0.0) and (languages is None or p in languages) for p, x, k in zip(*run(b.column(b.schema.get_field_index("text"))))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, each, docs.schema)
