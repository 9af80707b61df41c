"""Pieces of series for windows that look back on a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINE = "__mine"


def in_pieces(df: DataFrame, size: int, halo: int, by: str = "bar_id", at: Column | None = None) -> DataFrame:
    """Rows with (series, piece) as ``series``, a piece being ``size`` rows in order and led by the ``halo`` rows before it, for which ``MINE`` is false.

    A window of at most ``halo`` + 1 rows of a piece is that of the series at each row of its own. So is whether a row has at least k rows before it, k up to ``halo``.
    ``at`` is a row's number in its series, from 0, where it is known; else series are sorted for it.
    """
    if halo > size:
        raise ValueError("a halo is at most a piece")
    at = at if at is not None else F.row_number().over(Window.partitionBy("series").orderBy(by)) - 1
    piece = F.floor(at / size)
    rows = df.withColumns({"__piece": piece, "__late": at % size >= size - halo})
    rows = rows.withColumn("__to", F.explode(F.when(F.col("__late"), F.array("__piece", F.col("__piece") + 1)).otherwise(F.array("__piece"))))
    return rows.withColumns({"series": F.struct(F.col("series").alias("series"), F.col("__to").alias("piece")), MINE: F.col("__to") == F.col("__piece")}).drop("__piece", "__late", "__to")


def of_pieces(df: DataFrame) -> DataFrame:
    """The rows of ``in_pieces`` that are their piece's own, under their series."""
    return df.where(MINE).withColumn("series", F.col("series.series")).drop(MINE)
