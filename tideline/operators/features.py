"""Features that look back only. Every function takes a frame on a gap-free spine and
adds columns in one ``select`` over one window, so a series is sorted once, in blocks of
months (see :mod:`.halo`)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import exprs as X
from .halo import BLOCK_MONTHS, by_blocks

TARGET_LAGS = (0, 1, 2, 3, 6, 12, 18, 24)
TARGET_WINDOWS = (3, 6, 12, 24)
DRIVER_LAGS = (0, 1, 3, 6, 12)
PANEL_LAGS = (0, 1, 2, 3, 6, 12)


def by_month(keys: Sequence[str], month: str = "month") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(month)


def window_columns(df: DataFrame, keys: Sequence[str], build: Callable[[WindowSpec], dict[str, Column]], back: int, ahead: int = 0, month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """(keys, month, and the columns that ``build`` makes of a window by month), where the
    window's frames reach ``back`` rows back and ``ahead`` rows ahead at most."""

    def f(rows: DataFrame, own: list[str]) -> DataFrame:
        return rows.select(*own, month, *[c.alias(n) for n, c in build(by_month(own, month)).items()])

    return by_blocks(df, keys, back, f, ahead, month, block_months)


def lag_features(df: DataFrame, keys: Sequence[str], sources: Sequence[str], ks: Sequence[int], month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    return window_columns(df, keys, lambda w: {n: c for s in sources for n, c in X.lags(s, ks, w).items()}, max(ks), month=month, block_months=block_months)


def target_columns(target: str, w: WindowSpec) -> dict[str, Column]:
    """Lags, rolling means and deviations, and momenta of the target."""
    out = X.lags(target, TARGET_LAGS, w, "target")
    for n in TARGET_WINDOWS:
        out[f"target_roll_mean_{n}"] = X.rolling_mean(target, n, w)
    for n in TARGET_WINDOWS:
        out[f"target_roll_std_{n}"] = X.rolling_std(target, n, w)
    return out | {f"target_momentum_{k}": X.diff(target, k, w) for k in (3, 12)}


def driver_columns(source: str, w: WindowSpec) -> dict[str, Column]:
    """Lags, changes over one and three months, and the mean of six."""
    return X.lags(source, DRIVER_LAGS, w) | {f"{source}_change1": X.diff(source, 1, w), f"{source}_change3": X.diff(source, 3, w), f"{source}_roll6_mean": X.rolling_mean(source, 6, w)}


def rollup_columns(source: str, w: WindowSpec, rolled: bool) -> dict[str, Column]:
    out = X.lags(source, DRIVER_LAGS, w)
    return out | {f"{source}_roll{n}_mean": X.rolling_mean(source, n, w) for n in (3, 6)} if rolled else out


def panel_columns(inflation: str, index: str, w: WindowSpec) -> dict[str, Column]:
    """Lags and a mean of three of an inflation, and the change of an index on a year."""
    return X.lags(inflation, PANEL_LAGS, w) | {f"{inflation}_roll3": X.rolling_mean(inflation, 3, w), f"{index}_yoy": X.yoy(index, w)}


def origin_features(df: DataFrame, keys: Sequence[str], target: str, drivers: Sequence[str] = (), rollups: Sequence[str] = (), rolled: Sequence[str] = (), panel: Sequence[tuple[str, str]] = (), month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """All features known at each month: cyclic month, target, drivers, monthly
    statistics (``rolled`` of them with rolling means) and (inflation, index) pairs."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {"month_sin": X.month_sin(month), "month_cos": X.month_cos(month)} | target_columns(target, w)
        for d in drivers:
            out |= driver_columns(d, w)
        for r in rollups:
            out |= rollup_columns(r, w, r in rolled)
        for inflation, index in panel:
            out |= panel_columns(inflation, index, w)
        return out

    return window_columns(df, keys, build, max(*TARGET_LAGS, *TARGET_WINDOWS), month=month, block_months=block_months)


def sequence_channels(df: DataFrame, keys: Sequence[str], target: str, index: str, volume: str, passed: Sequence[str] = (), yoy_of: Sequence[str] = (), month: str = "month", block_months: int = BLOCK_MONTHS) -> DataFrame:
    """Channels of a recurrent model: the target, the change of an index on a year, a
    volume as log1p, columns as they are, changes of others on a year, and the month."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out = {"target": F.col(target), f"{index}_yoy": X.yoy(index, w), f"{volume}_log1p": X.log1p_clipped(volume)}
        out |= {c: F.col(c) for c in passed} | {f"{c}_yoy": X.yoy(c, w) for c in yoy_of}
        return out | {"month_sin": X.month_sin(month), "month_cos": X.month_cos(month)}

    return window_columns(df, keys, build, 12, month=month, block_months=block_months)


def zscore(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Values less their mean over their population deviation, of each series; a
    deviation of zero counts as 1. Statistics are grouped first and joined back, so a
    long series is not sorted or held in one task."""
    stats = df.groupBy(*keys).agg(*[F.avg(v).alias(f"_m_{v}") for v in values], *[F.stddev_pop(v).alias(f"_s_{v}") for v in values])
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumns({v: (F.col(v) - F.col(f"_m_{v}")) / F.when(F.col(f"_s_{v}") == 0, 1.0).otherwise(F.col(f"_s_{v}")) for v in values}).select(*df.columns)
