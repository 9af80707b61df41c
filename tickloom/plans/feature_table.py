"""All features of bars in one plan, and the table that models are fitted on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.pieces import MINE, in_pieces, of_pieces
from ..operators import analysis, cleaning, features, incremental, indicators, transform
from ..operators.transform import Scaler

Block = Callable[[DataFrame], DataFrame]


def smooth_acceleration(bars: DataFrame) -> DataFrame:
    return features.acceleration(bars, span=5)


#: In this order.
BLOCKS: tuple[Block, ...] = (features.durations, features.momentum, features.moving_averages, features.price_zscore, features.realized, features.jumps, features.range_volatility, features.order_flow, features.calendar, features.drawdowns, features.frac_diff, features.return_streak, features.entropy, features.volatility_regime, smooth_acceleration, analysis.complexity)
TECHNICAL: tuple[Block, ...] = (indicators.momentum_indicators, indicators.volatility_indicators, indicators.trend_indicators, indicators.volume_indicators)
#: Blocks whose values hang on the bar's own columns and ``FAR`` bars before it at most.
WINDOWED: frozenset[Block] = frozenset({features.momentum, features.moving_averages, features.price_zscore, features.realized, features.jumps, features.range_volatility, features.order_flow, features.calendar, features.frac_diff, features.entropy, analysis.complexity})
FAR = 64
#: Bars of a piece that windows of one series are cut into.
PIECE = 4096


def all_features(bars: DataFrame, blocks: Sequence[Block] = (*BLOCKS, *TECHNICAL), lags: Sequence[int] = (1, 5, 10), piece: int = PIECE) -> DataFrame:
    """The bars with the columns of each block, and lags of those columns whose names call for them. Blocks have no name in common but
    mfi_14, which two give alike.

    Blocks that hang on a whole series come first, so that what they write and hand to Python is narrow; indicators take that part of theirs together, last, and once. Windows and lags
    follow over pieces of series, each with the bars before it that they look back on, so that one long series is many tasks. Where a block is not of this module's, all are taken in the given order.
    """
    known = all(b in (*BLOCKS, *TECHNICAL) for b in blocks)
    technical = [b for b in dict.fromkeys(blocks) if known and b in TECHNICAL]
    first, then = ([b for b in blocks if b not in WINDOWED and b not in technical], [b for b in blocks if b in WINDOWED]) if known else (blocks, [])
    out, added = bars, {}

    def take(block: Block, give: Block) -> None:
        nonlocal out
        before = set(out.columns)
        out = give(out)
        added[block] = [c for c in out.columns if c not in before and not c.startswith("__")]

    for block in first:
        take(block, block)
    families = [indicators.FAMILIES[b] for b in technical]
    if technical:
        out = indicators.prepared(out, families)
    halo = FAR + max(lags, default=0)
    out = in_pieces(out, max(piece, halo), halo, at=F.col(indicators.ROW) - 1 if technical else None)
    for block, family in zip(technical, families):
        take(block, family.after)
    if technical:
        out = indicators.finished(out)
    for block in then:
        take(block, block)
    out = out.select(*bars.columns, *[c for b in dict.fromkeys(blocks) for c in added[b]], MINE)
    numbers = [c for c, kind in out.dtypes if kind in ("double", "float", "int", "bigint") and c not in ("series", "bar_id")]
    rows = features.planned_lags(out, [c for c in numbers if c not in ("open", "high", "low")], lags) if lags else out
    return of_pieces(rows)


def prepare(bars: DataFrame, blocks: Sequence[Block] = (*BLOCKS, *TECHNICAL), lags: Sequence[int] = (1, 5, 10), warm: Sequence[str] = (), ratio: float = 0.8, target: str = "log_return", most_nulls: float = 0.95) -> tuple[DataFrame, Scaler, Scaler]:
    """The table of all features with the next row's return as target, ``split`` by time, and a standard and a range scaler fitted on its training rows.

    Rows before the first with all of ``warm`` go, then columns that are nearly empty; other gaps take the value before, and then the training median. Columns named in
    ``incremental.scaled_columns`` are scaled by the standard scaler.
    """
    table = cut(features.future_return(all_features(bars, blocks, lags), target))  # four passes read what is computed once
    if warm:
        table = cleaning.drop_first_incomplete(table, list(warm))
    table = cleaning.drop_empty_columns(table, most_nulls)
    numbers = [c for c, kind in table.dtypes if kind in ("double", "float") and c != target]
    table = transform.split_by_time(table, ratio)
    w = features.so_far()
    table = cleaning.fill_train_median(table.withColumns({c: F.last(c, True).over(w) for c in numbers}), numbers)
    columns = incremental.scaled_columns(table, target)
    met = incremental.moments(table.where("split = 'train'"), columns)
    standard, ranged = incremental.standard_of(met), incremental.minmax_of(met)
    return standard.transform(table), standard, ranged
