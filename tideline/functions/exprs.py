"""Column expressions with one null contract: NaN and infinities become null on
ingest, a division by zero is null, and a full window or nothing is aggregated."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN or infinite."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a), col(b))


def zero_if(condition: Column, otherwise: Column) -> Column:
    return F.when(condition, F.lit(0.0)).otherwise(otherwise)


def at_least_zero(c: Column | str) -> Column:
    """max(x, 0) that keeps nulls (``greatest`` would skip them)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def log1p_clipped(c: Column | str) -> Column:
    return F.log1p(at_least_zero(c))


def month_start(c: Column | str) -> Column:
    return F.trunc(col(c).cast("date"), "MM")


def month_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def month_sin(c: Column | str) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.month(col(c)) / 12)


def month_cos(c: Column | str) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.month(col(c)) / 12)


def rolling(fn, c: Column | str, n: int, w: WindowSpec) -> Column:
    """``fn`` over the last n rows, null unless all n values are there."""
    x, frame = col(c), w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def rolling_mean(c: Column | str, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, c, n, w)


def rolling_std(c: Column | str, n: int, w: WindowSpec) -> Column:
    """Population standard deviation."""
    return rolling(F.stddev_pop, c, n, w)


def diff(c: Column | str, k: int, w: WindowSpec) -> Column:
    return col(c) - F.lag(col(c), k).over(w)


def pct_change(c: Column | str, k: int, w: WindowSpec) -> Column:
    """Relative change against k rows before."""
    return safe_div(c, F.lag(col(c), k).over(w)) - 1


def yoy(c: Column | str, w: WindowSpec) -> Column:
    """Change against twelve rows (months) before, in percent."""
    return pct_change(c, 12, w) * 100


def lags(c: str, ks: Sequence[int], w: WindowSpec, name: str | None = None) -> dict[str, Column]:
    """``{name}_now`` for lag 0, ``{name}_lag{k}`` for others."""
    out = name or c
    return {f"{out}_lag{k}" if k else f"{out}_now": F.lag(F.col(c), k).over(w) if k else F.col(c) for k in ks}


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over rows that have both, null if either is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return safe_div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean of the values of a row that are not null; null if none is."""
    xs = [col(c) for c in columns]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    n = sum((x.isNotNull().cast("int") for x in xs), F.lit(0))
    return safe_div(total, n)


def indicator_code(c: Column | str, codes: Sequence[str]) -> Column:
    """The first of the codes in a text, null if none is there."""
    return F.nullif(F.regexp_extract(col(c), "(" + "|".join(codes) + ")", 1), F.lit(""))


def smape_term(actual: Column | str, predicted: Column | str) -> Column:
    """200 |e| / (|a| + |p|), zero where the denominator is next to nothing."""
    size = F.abs(col(actual)) + F.abs(col(predicted))
    return F.when(size > 1e-9, 200 * F.abs(col(predicted) - col(actual)) / size).otherwise(F.lit(0.0))


def yes_at_5_percent(p: Column | str) -> Column:
    return F.when(col(p) < 0.05, "Yes").when(col(p).isNotNull(), "Not at 5%")


def sigmoid(c: Column | str, bound: float = 30.0) -> Column:
    x = F.least(F.greatest(col(c), F.lit(-bound)), F.lit(bound))
    return 1 / (1 + F.exp(-x))
