"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import assert_unique


def strict_pivot(df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence) -> DataFrame:
    """One column for each label. A label that is null or a (key, label) that repeats
    is an error; labels are given, so no pass is needed to find them."""
    if df.where(F.col(label).isNull()).first() is not None:
        raise ValueError(f"{label} is null in some row")
    assert_unique(df, [*keys, label])
    return pivot_first(df, keys, label, value, labels)


def pivot_first(df: DataFrame, keys: Sequence[str], label: str, value: str, labels: Sequence) -> DataFrame:
    """One column for each label with the first value that is not null; rows where no
    label has one are dropped."""
    wide = df.where(F.col(value).isNotNull()).groupBy(*keys).pivot(label, list(labels)).agg(F.min(value))
    names = [str(x) for x in labels]
    return wide.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull())


def melt(df: DataFrame, keys: Sequence[str], values: Sequence[str], label: str = "code", value: str = "value") -> DataFrame:
    """Long form: a row for each key and value column."""
    return df.unpivot(list(keys), list(values), label, value)


def transpose(df: DataFrame, key: str, values: Sequence[str], labels: Sequence) -> DataFrame:
    """A small frame with its columns as rows: (metric, one column for each label)."""
    return melt(df, [key], values, "metric", "v").groupBy("metric").pivot(key, list(labels)).agg(F.first("v"))


def exclude(df: DataFrame, label: str, unwanted: Sequence) -> DataFrame:
    """Rows of a long frame whose label is not among the unwanted; taken out before a
    pivot, so that neither their columns nor their rows are made."""
    return df.where(~F.col(label).isin(list(unwanted)))
