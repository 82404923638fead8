"""Windows over long series: a series is cut into blocks of months, and each block gets
the rows that its frames reach (its halo) from the blocks beside it. A window is then
partitioned by series and block, so no series, however long, is sorted in one task; of
the result each block keeps its own months.

Made for series on a spine (a row for each month), where so many rows back are so many
months back. Months are not null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Months of a block: with frames of two years a tenth of all rows stands in two blocks.
BLOCK_MONTHS = 240


def month_number(month: str) -> Column:
    return F.year(month) * 12 + F.month(month) - 1


def block_of(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def free(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def spread(df: DataFrame, block: str, back: int, ahead: int = 0, month: str = "month", size: int = BLOCK_MONTHS) -> DataFrame:
    """``df`` with the column ``block``: each row in its own block, and in those beside it
    whose rows look so far back or ahead."""
    at = month_number(month)
    return df.withColumn(block, F.explode(F.sequence(block_of(at - ahead, size), block_of(at + back, size))))


def by_blocks(df: DataFrame, keys: Sequence[str], back: int, f: Callable[[DataFrame, list[str]], DataFrame], ahead: int = 0, month: str = "month", size: int = BLOCK_MONTHS, result_month: str | None = None) -> DataFrame:
    """``f(df, keys)``, which reaches ``back`` rows back and ``ahead`` rows ahead, over
    blocks of ``size`` months. ``f`` gets the block as one more key and returns all keys
    and the month (as ``result_month``)."""
    block = free(df.columns, "_block")
    found = f(spread(df, block, back, ahead, month, size), [*keys, block])
    return found.where(F.col(block) == block_of(month_number(result_month or month), size)).drop(block)
