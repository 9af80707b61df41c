"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; make one only where none is named and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        context.setCheckpointDir(named)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tickloom-checkpoint-"))


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What frames made here shuffle goes from the disk as soon as their action ends, not when the driver next collects garbage. For frames that run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder; a lost executor costs a reread only."""
    ensure_checkpoint_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose worker, which Spark keeps for later tasks, gives freed memory back when a task ends."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def cells(total: np.ndarray, cell: int) -> Iterator[pa.RecordBatch]:
    """Non-empty cells of one task's counters, each counter up to 255, packed, a bounded number of bytes to a batch."""
    grid = np.minimum(total, 255).astype(np.uint8).reshape(-1, cell)
    some = np.flatnonzero(grid.any(axis=1))
    for part in np.array_split(some, max(1, len(some) // 256)):
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([zlib.compress(grid[i].tobytes(), 1) for i in part], pa.binary())], ["cell", "counts"])


def gather_cells(df: DataFrame, size: int, cell: int) -> np.ndarray:
    """Sums of all tasks' counters, up to 65535 each: ``size`` 2-byte numbers whatever the number of rows."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(zlib.decompress(v.as_buffer()), np.uint8)
                sums[k] = sums[k] + got if k in sums else got.astype(np.uint32)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(v, 65535).astype("<u2").tobytes()], pa.binary())], ["cell", "counts"])

    out = np.zeros(size, np.uint16)
    with tidy(df.sparkSession):
        found = arrow_map(df.repartition("cell"), add, "cell int, counts binary").collect()
    for k, v in found:
        out[k * cell : (k + 1) * cell] = np.frombuffer(v, "<u2")
    return out


def bit_filter(df: DataFrame, column: str, bits: int, cell: int = 4096) -> np.ndarray:
    """2**bits bits, packed: bit i is set if some row's long has i as its low bits. Nulls set nothing.

    Tasks set bits in one fixed array each and send its non-empty cells; a second stage joins cells of the
    same number. The size is fixed whatever the rows; more rows only bring false positives.
    """
    mask = np.uint64((1 << bits) - 1)

    def mark(batches):
        mine = np.zeros(1 << bits, bool)
        for b in batches:
            mine[(np.asarray(b.column(0).drop_null()).astype(np.int64).view(np.uint64) & mask).astype(np.int64)] = True
        grid = np.packbits(mine).reshape(-1, cell)
        some = np.flatnonzero(grid.any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([grid[i].tobytes() for i in some], pa.binary())], ["cell", "bits"])

    def join(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                got = np.frombuffer(v.as_buffer(), np.uint8)
                sums[k] = got | sums[k] if k in sums else got
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["cell", "bits"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    with tidy(df.sparkSession):
        found = arrow_map(arrow_map(df.select(column), mark, "cell int, bits binary").repartition("cell"), join, "cell int, bits binary").collect()
    for k, v in found:
        out[k * cell : (k + 1) * cell] = np.frombuffer(v, np.uint8)
    return out


def in_filter(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = (values.view(np.uint64) & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a long, b long)``: one row (node, component) per linked node.

    Alternates large-star and small-star steps (min label, partial aggregation, equi-joins) until all edges are stars, each node with one
    lower neighbour that has none itself; rounds grow with the logarithm of the longest path. Least neighbours are written before they are joined, so that both sides of a join come from a
    shuffle of their own, and adaptive execution may split the edges of a star's centre or broadcast a small side. ``component`` is the
    least node. Nothing is collected.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # an edge's lower end gets its own least neighbour, if that is lower still
        below = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        large = cut(edges.join(below.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")))
        down = cut(large.groupBy("u").agg(F.min("v").alias("m"), (F.max("moved") | (F.count("*") > 1)).alias("open")))
        if down.where("open").isEmpty():
            break
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
    stars = down.select(F.col("u").alias("node"), F.col("m").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
