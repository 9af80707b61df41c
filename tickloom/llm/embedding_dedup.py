"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

A table's signature of a vector is the side on which it lies of each of ``bits`` random hyperplanes. Two vectors at the threshold agree on one plane with
probability p = 1 - acos(threshold) / pi, so on a table with p^bits; the number of bits grows with the logarithm of the largest label, which keeps
strangers of a bucket few, and as many tables are taken as leave a pair at the threshold unfound with probability ``MISS`` (nearer pairs with less).

Vectors of one label that are equal are one class with a weight, found by a grouping that tasks prepare. Class numbers and signatures alone are
grouped first; only classes that share a bucket send their vectors. A bucket of more than ``BLOCK`` classes is dealt to blocks by a hash, and each
pair of blocks is a cell of its own: no task holds a bucket, however large. In a cell all cosines are taken in double precision; a pair counts in the first table that it shares only, which
both ends know from their keys, so counts need no list of pairs. A large cell returns a row for each linked class (its partners' weight, and
the least class of its own links' component there), not the pairs. A group of m different near copies still costs m^2 cosines, as its counts of links say.

Rows with a null id, null label, or a vector that is null, empty, zero or holds null or non-finite components link with nothing. Vectors of different lengths
don't link. Rows that repeat are vectors of their own, linked with each other if they have a label. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, cut

THRESHOLD = 0.98
MISS = 1e-6
BLOCK = 1024
#: Cells up to this size are compared together, larger ones as matrices.
SMALL = 24
#: Cosines so near to the threshold are taken again by the plain formula.
EDGE = 1e-9


def plan(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for the number of classes of the largest label."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(60, max(8, math.ceil(math.log2(max(largest, 2))) + 2))
    return bits, math.ceil(math.log(miss) / math.log1p(-(p**bits)))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length at length 1, in double precision; scaled by their largest component first, so that no square overflows."""
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def signatures(x: np.ndarray, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    """(rows x tables) of the sides on which unit vectors lie."""
    planes = np.random.Generator(np.random.PCG64([seed, x.shape[1]])).standard_normal((x.shape[1], tables * bits))
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None]
    out = [((part @ planes > 0).reshape(len(part), tables, bits) * weights).sum(axis=2, dtype=np.uint64) for part in np.array_split(x, max(1, len(x) // 512))]
    return np.concatenate(out)


def _signed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds keys, one per table: equal for equal label, length and signature."""

    def run(batches):
        for b in batches:
            size, v, group = np.asarray(b.column(3)), b.column(4), np.asarray(b.column(1)).view(np.uint64)
            keys = np.zeros((len(size), tables), np.uint64)
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                sides = signatures(units(v.take(pa.array(own)), int(dim)), bits, tables)
                keys[own] = _mix(_mix(group[own, None] + np.arange(1, tables + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)) ^ sides)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "keys"])

    rows = classes.select("cid", F.xxhash64("label", F.size("v")).alias("grp"), "weight", F.size("v").alias("size"), "v")
    return arrow_map(rows, run, rows.withColumn("keys", F.lit(None).cast("array<long>")).schema)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of unit vectors."""
    return np.einsum("ij,ij->i", a, b)


def _fresh(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b share none of the earlier tables' keys."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), 65536):
        out[i : i + 65536] = ~(keys[a[i : i + 65536]] == keys[b[i : i + 65536]]).any(axis=1)
    return out


def _little(cell, second, one):
    """All pairs of the small cells of a lot; of two blocks, those across only."""
    for d in range(1, min(SMALL, len(cell))):
        a = np.flatnonzero((cell[d:] == cell[:-d]) & (one[d:] | (second[d:] != second[:-d])))
        if len(a):
            yield a, a + d


def _large(x, second, one, threshold):
    """Near pairs of a cell: of its two blocks, or of its ``one`` block with itself."""
    left, right = np.flatnonzero(~second), np.flatnonzero(second)
    right = left if one else right
    for i in range(0, len(left), 512):
        for j in range(i if one else 0, len(right), 512):
            a, b = np.nonzero(x[left[i : i + 512]] @ x[right[j : j + 512]].T >= threshold - EDGE)
            a, b = left[i : i + 512][a], right[j : j + 512][b]
            if one and i == j:
                a, b = a[a < b], b[a < b]
            yield a, b


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each row's component under links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(near: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(cid, n, other) from rows (key, lo, hi, second, cid, grp, weight, size, v, before): partial weights of partners, and a class linked with it.

    ``near`` comes sorted by cell; a cell is held at a time, at most two blocks.
    """

    def settle(cell: pa.Table):
        """Compare all cells of a table of whole cells."""
        names = {k: np.asarray(cell[k]) for k in ("key", "lo", "hi", "cid", "grp", "weight", "size")}
        second = np.asarray(cell["second"])
        edge = np.flatnonzero(np.concatenate([[True], (names["key"][1:] != names["key"][:-1]) | (names["lo"][1:] != names["lo"][:-1]) | (names["hi"][1:] != names["hi"][:-1])]))
        sizes = np.diff(np.concatenate([edge, [len(second)]]))
        number = np.repeat(np.arange(len(edge)), sizes)
        v, before = cell["v"].combine_chunks(), cell["before"].combine_chunks()
        jobs = []  # rows to compare, as one small lot or one large cell
        small = sizes[number] <= SMALL
        for dim in np.unique(names["size"]):
            of = names["size"] == dim
            if (small & of).any():
                jobs.append((np.flatnonzero(small & of), int(dim), True))
            jobs += [(rows, int(dim), False) for c in np.flatnonzero(sizes > SMALL) if len(rows := edge[c] + np.flatnonzero(of[edge[c] : edge[c] + sizes[c]])) > 1]
        for rows, dim, little in jobs:
            x, side, cid, grp, weight = units(v.take(pa.array(rows)), dim), second[rows], names["cid"][rows], names["grp"][rows], names["weight"][rows]
            lists = before.take(pa.array(rows))
            long = np.asarray(lists.value_lengths())
            keys = np.arange(-1, -len(rows) - 1, -1, dtype=np.int64)[:, None].repeat(max(1, int(long.max())), axis=1)  # no two rows agree where there is no key
            keys[np.arange(keys.shape[1])[None] < long[:, None]] = np.asarray(lists.flatten())
            one = (names["lo"] == names["hi"])[rows]
            found = _little(number[rows], side, one) if little else _large(x, side, one[0], threshold)
            got_a, got_b = [], []
            for a, b in found:
                cos = _cosine(x[a], x[b])
                ok = (grp[a] == grp[b]) & (cos >= threshold)
                a, b = a[ok], b[ok]
                ok = _fresh(keys, a, b)
                got_a.append(a[ok].astype(np.int32))
                got_b.append(b[ok].astype(np.int32))
            if not got_a or not sum(map(len, got_a)):
                continue
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            n = np.bincount(a, weight[b], len(rows)).astype(np.int64) + np.bincount(b, weight[a], len(rows)).astype(np.int64)
            some, root = np.flatnonzero(n), _roots(len(rows), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(n[some]), pa.array(cid[root[some]])], ["cid", "n", "other"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            key, lo, hi = (np.asarray(b.column(i)) for i in range(3))
            last = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1])) if len(key) else []
            whole = int(last[-1]) + 1 if len(last) else 0
            if held and len(key):  # a cell may go on from the batch before
                first = held[-1].slice(len(held[-1]) - 1)
                if not whole and (first[0][0].as_py(), first[1][0].as_py(), first[2][0].as_py()) != (key[0], lo[0], hi[0]):
                    yield from settle(pa.Table.from_batches(held))
                    held = []
            if whole:
                yield from settle(pa.Table.from_batches([*held, b.slice(0, whole)]))
                held = []
            if len(b) > whole:
                held.append(b.slice(whole))
        if held:
            yield from settle(pa.Table.from_batches(held))

    return arrow_map(near.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"), run, "cid long, n long, other long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. Runs jobs while the plan is built: classes, signatures, shared buckets and links are written."""
    one = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    good = F.forall("v", lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))) & F.exists("v", lambda c: c != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & good, F.lit(False))
    classes = cut(one.where(ok).groupBy("label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("first")).withColumn("cid", F.monotonically_increasing_id()))
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, miss)
    signed = cut(_signed(classes, bits, tables))
    entries = signed.select("cid", F.posexplode("keys").alias("t", "key"))
    shared = cut(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).alias("blocks")))
    met = entries.join(shared, "key").join(signed.select("cid", "grp", "weight", "size", "v", "keys"), "cid")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    dealt = met.withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    near = dealt.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).alias("second"), "cid", "grp", "weight", "size", "v", F.expr("slice(keys, 1, t)").alias("before"))
    found = cut(links(near, threshold))
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    linked = components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "cid")
    linked = linked.join(classes.select("cid", "first"), "cid")
    least = cut(linked.groupBy("component").agg(F.min("first").alias("least")))
    whole = classes.join(linked.join(least, "component").select("cid", "least"), "cid", "left").join(counts, "cid", "left")
    known = cut(whole.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id")))
    result = one.where(ok).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = one.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
