"""Functions for SQL users: p-values, autocorrelation and a generator of lag columns.
All are Arrow-based; nothing runs row by row."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.regression import f_survival, student_two_sided


def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t."""
    return pd.Series([None if pd.isna(a) or pd.isna(b) else student_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of F."""
    return pd.Series([None if pd.isna(a) else f_survival(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)], dtype="float64")


def acf(values: pd.Series, lag: pd.Series) -> float:
    """Autocorrelation of a group's values in the order that they come in; 0 where they
    are too few or constant. For series that fit one task; see
    :func:`tideline.operators.metrics.autocorrelation` for any size."""
    x, k = values.to_numpy(float), int(lag.iloc[0])
    a, b = x[:-k] if k else x, x[k:]
    if len(x) <= k or a.std() < 1e-12 or b.std() < 1e-12:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


class LagSpec:
    """A table of (column, lag, name) for columns and lags given as comma lists."""

    def eval(self, columns: str, lags: str):
        for c in columns.split(","):
            for k in map(int, lags.split(",")):
                yield c, k, f"{c}_lag{k}" if k else f"{c}_now"


def register(spark: SparkSession) -> None:
    """Make all of them known to SQL."""
    spark.udf.register("student_p", F.pandas_udf(student_p, "double"))
    spark.udf.register("f_p", F.pandas_udf(f_p, "double"))
    spark.udf.register("acf", F.pandas_udf(acf, "double"))
    spark.udtf.register("lag_spec", F.udtf(LagSpec, returnType="column string, lag int, name string"))
