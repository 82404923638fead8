"""Results that must come out on public monthly series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tideline.functions import exprs as X
from tideline.operators import backtest, features, linkage, metrics
from tideline.operators.calendar import on_spine

# A published forecast for January to December 2024.
FORECAST = [9.677592, 10.919847, 13.79899, 12.713862, 9.662222, 13.410332, 11.893284, 9.449969, 10.190203, 3.669835, 3.224535, 3.922078]
# A monthly oil price (taken on the 15th), December 2022 to December 2023.
OIL = [80.92, 82.5, 82.59, 78.43, 84.64, 75.47, 74.84, 80.11, 86.15, 93.72, 90.6, 82.94, 77.63]
# Fixed value: a policy rate that did not move over those months.
RATE = 2.65


def test_forecast_summary(spark):
    df = spark.createDataFrame([("a", dt.date(2024, i + 1, 1), v) for i, v in enumerate(FORECAST)], "area string, month date, forecast double")
    r = linkage.forward_pressure(df, ["area"], "forecast", []).first()
    assert abs(r["mean"] - 9.377729083333334) < 1e-12
    assert (r.peak, r.peak_month, r.trough, r.trough_month, r.months_over) == (13.79899, "2024-03", 3.224535, "2024-11", 6)
    assert abs(r.first_half_mean - 11.697140833333334) < 1e-12 and abs(r.second_half_mean - 7.058317333333334) < 1e-12 and abs(r.easing - 4.6388235) < 1e-12
    one = df.select("month", F.col("forecast").alias("value"))
    assert abs(backtest.pattern_check(one, one, 2024).first().forecast_drop - 9.740497) < 1e-12
    sent = metrics.assert_contract(metrics.submission(df, "month", "forecast"), "2024-01-01")
    assert [r.forecast for r in sent.collect()] == FORECAST


def test_driver_features_of_the_last_month(spark):
    rows = [("oil", dt.date(2022 + (11 + i) // 12, (11 + i) % 12 + 1, 15), v) for i, v in enumerate(OIL)]
    rows += [("rate", dt.date(2022 + (11 + i) // 12, (11 + i) % 12 + 1, 1), RATE) for i in range(13)]
    df = spark.createDataFrame(rows, "k string, d date, v double").select("k", X.month_start("d").alias("month"), "v")
    w = features.by_month(["k"])
    out = on_spine(df, ["k"]).select("k", "month", *[c.alias(n) for n, c in features.driver_columns("v", w).items()])
    got = {r.k: r for r in out.where("month = '2023-12-01'").collect()}
    oil, rate = got["oil"], got["rate"]
    assert [oil.v_now, oil.v_lag1, oil.v_lag3, oil.v_lag6, oil.v_lag12] == [77.63, 82.94, 93.72, 74.84, 80.92]
    assert abs(oil.v_change1 + 5.31) < 1e-9 and abs(oil.v_change3 + 16.09) < 1e-9 and abs(oil.v_roll6_mean - 85.191666667) < 1e-8
    assert [rate.v_now, rate.v_lag12, rate.v_change1, rate.v_change3] == [RATE, RATE, 0.0, 0.0] and abs(rate.v_roll6_mean - RATE) < 1e-12
    assert out.where("k = 'rate'").agg(X.guarded_corr("v_now", "v_lag1").alias("c")).first().c is None
