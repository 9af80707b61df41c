"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by a sum of one full-dimensional codeword from each of ``books`` codebooks, found
by beam search; its norm is stored beside the codes. A query's inner products with all codewords form a
lookup table, from which every stored vector is scored by additions; the best ``rerank`` of each chunk are
scored again exactly, in double precision, on the original vectors.

Codebooks are fitted on at most ``sample`` vectors, those whose ids have the least hashes; every row is encoded. Queries and
rows meet in blocks: rows are dealt to chunks by a hash of the id, each query goes to every chunk once (an equi-join
on the chunk number), and a chunk returns its k best per query. Equal vectors of a chunk are scored once.

Vectors that are null, zero, hold null or non-finite components, have a null id, or another length than most, take no part. Ties go to
the smaller id. Rows that repeat an id are candidates each, but none of them for a query of that id; of such queries the least vector is used.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

BOOKS, WORDS, BEAM = 8, 256, 4
SAMPLE = 10_000
RERANK = 768
CHUNK = 16_384


@dataclass(frozen=True)
class Codebooks:
    words: np.ndarray  # books x words x dim, float32


def _means(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)]) if len(c) < k else c.copy()
    for _ in range(rounds):
        a = np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[some])[:-1]])) / n[some, None]
    return c


def encode(x: np.ndarray, books: Codebooks, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x books) of the best sum that beam search finds, and the sums' norms."""
    n, m = len(x), len(books.words)
    codes, sums = np.zeros((n, 1, m), np.uint8), np.zeros((n, 1, x.shape[1]), np.float32)
    for k, words in enumerate(books.words):
        rest = x[:, None, :] - sums
        cost = (rest**2).sum(2)[:, :, None] + (words**2).sum(1) - 2 * (rest @ words.T)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        old, new = best // len(words), best % len(words)
        codes = np.take_along_axis(codes, old[:, :, None], 1).copy()
        codes[:, :, k] = new
        sums = np.take_along_axis(sums, old[:, :, None], 1) + words[new]
    return codes[:, 0], np.linalg.norm(sums[:, 0], axis=1)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 5) -> Codebooks:
    """Residual k-means, then rounds of beam encoding and a joint least-squares update of all codebooks."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        c = _means(rest, words, rng)
        rest = rest - c[np.argmin((c**2).sum(1) - 2 * (rest @ c.T), axis=1)]
        out.append(c)
    found = Codebooks(np.stack(out).astype(np.float32))
    for _ in range(rounds):
        codes = np.concatenate([encode(x[i : i + 1024].astype(np.float32), found)[0] for i in range(0, len(x), 1024)]).astype(np.int64)
        place = codes + np.arange(books) * words
        gram, right = np.zeros((books * words,) * 2), np.zeros((books * words, x.shape[1]))
        for a in range(books):
            np.add.at(right, place[:, a], x)
            for b in range(books):
                np.add.at(gram, (place[:, a], place[:, b]), 1)
        gram[np.diag_indices_from(gram)] += 1e-2
        right += 1e-2 * found.words.reshape(-1, x.shape[1])
        found = Codebooks(np.linalg.solve(gram, right).reshape(found.words.shape).astype(np.float32))
    return found


def _valid(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of usable vectors, and their length: that of most."""
    ok = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    most = ok.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (ok.where(F.size("v") == most["d"]), most["d"]) if most else (ok, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows of a matrix, each row summed alike wherever it stands."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Chunk:
    """A chunk's distinct vectors, encoded, and their ids in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, books: Codebooks, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, first, of = np.unique(x.view(f"V{x.itemsize * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.argsort(first, kind="stable")  # distinct vectors in order of their least id
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        of = place[of]
        self.x, self.k = x[first[by]], k
        members = np.argsort(of, kind="stable")
        self.ids, self.off = ids[members], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(by)))])
        unit = (self.x / np.sqrt((self.x**2).sum(1))[:, None]).astype(np.float32)
        parts = [encode(unit[i : i + 1024], books) for i in range(0, len(unit), 1024)]
        self.codes, self.norms = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.books = books

    def search(self, names: np.ndarray, q: np.ndarray, rerank: int) -> list[tuple[int, int, float]]:
        """(query, id, score): the k best of each query among its ``rerank`` best by lookup table."""
        unit = (q / np.sqrt((q**2).sum(1))[:, None]).astype(np.float32)
        table = np.einsum("qd,mwd->qmw", unit, self.books.words)
        scores = np.zeros((len(q), len(self.x)), np.float32)
        for m in range(table.shape[1]):
            scores += table[:, m][:, self.codes[:, m]]
        scores /= np.maximum(self.norms, 1e-6)
        out, n = [], len(self.x)
        for i in range(len(q)):
            few = np.arange(n) if n <= rerank else np.argpartition(-scores[i], rerank - 1)[:rerank]
            few = few[np.lexsort((self.ids[self.off[few]], -exact(q[i], self.x[few])))]
            got: list[tuple[float, int]] = []
            for j in few:
                score = float(exact(q[i], self.x[j : j + 1])[0])
                if len(got) >= self.k and score < got[self.k - 1][0]:
                    break
                own = self.ids[self.off[j] : self.off[j + 1]]
                got += [(score, int(c)) for c in own[own != names[i]][: self.k]]
                got.sort(key=lambda s: (-s[0], s[1]))
            out += [(int(names[i]), c, s) for s, c in got[: self.k]]
        return out


def search(rows: DataFrame, every: int = 50, k: int = 5, rerank: int = RERANK, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries with ids divisible by ``every``, against all rows."""
    spark = rows.sparkSession
    rows, dim = _valid(rows)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).toArrow()
    x = _matrix(few["v"].combine_chunks(), dim)
    books = spark.sparkContext.broadcast(fit(x / np.sqrt((x**2).sum(1))[:, None]))
    chunks = max(1, -(-rows.count() // chunk))
    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"), F.lit(0).alias("kind"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(1).alias("kind"), "vec_id", "v")
    both = dealt.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind", "vec_id")

    def run(batches):
        now, held, index = None, [], None
        for b in batches:
            c, kind, ids, v = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), _matrix(b.column(3), dim)
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (kind[1:] != kind[:-1])) + 1
            for part in np.split(np.arange(len(c)), cuts):
                if not len(part):
                    continue
                if c[part[0]] != now:
                    now, held, index = c[part[0]], [], None
                if kind[part[0]] == 0:
                    held.append((ids[part], v[part]))
                    continue
                if index is None:
                    if not held:
                        continue
                    index = Chunk(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), books.value, k)
                    held = []
                for i in range(0, len(part), 64):
                    got = index.search(ids[part[i : i + 64]], v[part[i : i + 64]], rerank)
                    yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = arrow_map(both, run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", place, "vec_id", "score").where(F.col("rank") <= k)
