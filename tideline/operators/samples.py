"""Training samples: what is known at an origin, and the months after it.

Windows are cut in blocks of months (see :mod:`.halo`). For training, :func:`packed_blocks`
sends each month once, with its block, and :func:`cut` takes the overlapping windows out of
a block as views, inside the task that learns from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import by_month
from .halo import BLOCK_MONTHS, by_blocks, free, spread


def all_finite(array: Column | str) -> Column:
    return F.forall(array, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def label_window(target: str, horizon: int, w) -> Column:
    """The next ``horizon`` values; missing ones keep their place."""
    return F.array(*[F.lead(F.col(target), h).over(w) for h in range(1, horizon + 1)])


def context_window(channels: Sequence[str], context: int, w) -> Column:
    """The last ``context`` rows, oldest first, each an array of channels."""
    return F.array(*[F.array(*[F.lag(F.col(c), k).over(w) for c in channels]) for k in range(context - 1, -1, -1)])


def direct_samples(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, horizon: int = 12, month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """(keys, origin, label_end, x, y) for months whose features and labels are all
    there."""

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        w = by_month(own, month)
        return rows.select(*own, F.col(month).alias("origin"), F.add_months(month, horizon).alias("label_end"), F.array(*features).alias("x"), label_window(target, horizon, w).alias("y"))

    return by_blocks(df, keys, 0, f, horizon, month, block_months, "origin").where(all_finite("x") & all_finite("y"))


def contexts(df: DataFrame, keys: Sequence[str], channels: Sequence[str], context: int = 24, month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """(keys, origin, x): full contexts that end at each month."""

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        return rows.select(*own, F.col(month).alias("origin"), context_window(channels, context, by_month(own, month)).alias("x"))

    return by_blocks(df, keys, context - 1, f, 0, month, block_months, "origin").where(F.forall("x", lambda row: all_finite(row)))


def sequence_samples(df: DataFrame, keys: Sequence[str], channels: Sequence[str], target: str, context: int = 24, horizon: int = 12, month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """(keys, origin, label_end, x, y): contexts with the labels that follow."""

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        w = by_month(own, month)
        return rows.select(*own, F.col(month).alias("origin"), F.add_months(month, horizon).alias("label_end"), context_window(channels, context, w).alias("x"), label_window(target, horizon, w).alias("y"))

    found = by_blocks(df, keys, context - 1, f, horizon, month, block_months, "origin")
    return found.where(F.forall("x", lambda row: all_finite(row)) & all_finite("y"))


def packed_blocks(df: DataFrame, keys: Sequence[str], channels: Sequence[str], target: str, context: int = 24, horizon: int = 12, month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """(keys, block, first, last, months, x, y): a row for each block of a series, its
    months with their channels and target (null: NaN) once, and those around it that its
    windows reach. The block's own months are those from ``first`` to ``last`` (numbered
    from year 0)."""
    block = free([*df.columns, "months", "x", "y", "first", "last"], "block")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    row = F.struct((F.year(month) * 12 + F.month(month) - 1).alias("m"), F.array(*map(number, channels)).alias("x"), number(target).alias("y"))
    rows = spread(df, block, context - 1, horizon, month, block_months).groupBy(*keys, block).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select(*keys, block, (F.col(block) * block_months).alias("first"), ((F.col(block) + 1) * block_months - 1).alias("last"), F.col("rows.m").alias("months"), F.col("rows.x").alias("x"), F.col("rows.y").alias("y"))


def cut(months: Sequence[int], x: Sequence, y: Sequence[float], first: int, last: int, context: int = 24, horizon: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a row of :func:`packed_blocks` its samples: months of origin (numbered), views
    (n, context, channels) and labels (n, horizon); those with a missing value left out."""
    months = np.asarray(months, np.int64)
    if len(months) and (np.diff(months) != 1).any():
        raise ValueError("a packed series has a row for each month")
    channels, labels = np.array([list(v) for v in x], float), np.asarray(y, float)
    n = len(months) - context - horizon + 1
    if n <= 0:
        return months[:0], np.zeros((0, context, channels.shape[1] if channels.ndim == 2 else 0)), np.zeros((0, horizon))
    views = np.lib.stride_tricks.sliding_window_view(channels, context, axis=0)[:n].transpose(0, 2, 1)
    after = np.lib.stride_tricks.sliding_window_view(labels[context:], horizon)
    origins = months[context - 1 : context - 1 + n]
    whole = lambda ok, k: np.lib.stride_tricks.sliding_window_view(ok, k).all(1)
    full = whole(np.isfinite(channels).all(1), context)[:n] & whole(np.isfinite(labels[context:]), horizon) & (origins >= first) & (origins <= last)
    return origins[full], views[full], after[full]


def through(samples: DataFrame, cutoff: Column | str) -> DataFrame:
    """Samples whose whole label window was known at the cutoff."""
    return samples.where(F.col("label_end") <= (F.lit(cutoff).cast("date") if isinstance(cutoff, str) else cutoff))


def folds(spark, years: Sequence[int]) -> DataFrame:
    """(year, origin): forecasts of a year start from the December before."""
    rows = F.explode(F.array(*[F.lit(y) for y in years])).alias("year")
    return spark.range(1).select(rows).select("year", F.make_date(F.col("year") - 1, F.lit(12), F.lit(1)).alias("origin"))


def eligible(samples: DataFrame, fold: DataFrame) -> DataFrame:
    """Each fold with the samples that it may learn from. Folds are a handful of rows,
    so they are broadcast to the samples."""
    return samples.join(F.broadcast(fold.select("year", F.col("origin").alias("fold_origin"))), F.col("label_end") <= F.col("fold_origin"))


def latest_context(samples: DataFrame, keys: Sequence[str], origin: str, wanted: DataFrame | None = None) -> DataFrame:
    """The context of each series at an origin; an error if a series of ``wanted`` (else
    of ``samples``) has none, or if there are no series at all."""
    got = samples.where(F.col("origin") == F.lit(origin).cast("date"))
    named = (samples if wanted is None else wanted).select(*keys).distinct()
    missing = named.join(got.select(*keys), list(keys), "left_anti").first()
    if missing is not None or named.isEmpty():
        raise ValueError(f"no full context ends at {origin}" + (f" for {missing.asDict()}" if missing else ""))
    return got
