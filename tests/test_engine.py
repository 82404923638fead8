"""Golden values, the null contract, and properties of the analytics."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import exprs as X
from tideline.operators import calendar, features, gru, linkage, metrics, regression, reshape, rollup, samples, sarima, stationarity
from tideline.sources import sinks, sources


def month(y: int, m: int) -> dt.date:
    return dt.date(y + (m - 1) // 12, (m - 1) % 12 + 1, 1)


def series(spark, values, first=(2000, 1), key="a"):
    return spark.createDataFrame([(key, month(first[0], first[1] + i), None if v is None else float(v)) for i, v in enumerate(values)], "area string, month date, v double")


def test_forward_pressure_of_a_line(spark):
    line = np.linspace(12.0, 4.0, 12)
    df = spark.createDataFrame([("a", month(2024, i + 1), float(v), 1.0, None) for i, v in enumerate(line)], "area string, month date, value double, r1 double, r2 double")
    r = linkage.forward_pressure(df, ["area"], "value", ["r1", "r2"]).first()
    assert (r.months_over, r.peak_month, r.trough_month) == (3, "2024-01", "2024-12")
    assert r.first_half_mean > r.second_half_mean and math.isclose(r.easing, line[:6].mean() - line[6:].mean()) and r.regional_mean == 1.0 and r["last"] == 4.0


def test_extremes_take_the_first_of_ties(spark):
    r = metrics.extremes(series(spark, [1, 3, 3, 0, 0, None]), ["area"], "month", "v").first()
    assert (r.peak_month, r.trough_month) == (month(2000, 2), month(2000, 4))


def test_null_contract(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (float("nan"), 2.0), (float("inf"), 1.0), (None, 1.0), (-3.0, 2.0)], "a double, b double")
    rows = df.select(X.finite("a").alias("f"), X.safe_div("a", "b").alias("d"), X.at_least_zero("a").alias("z")).collect()
    assert [r.f for r in rows] == [1.0, 0.0, None, None, None, -3.0]
    assert rows[0].d is None and rows[1].d is None and rows[5].d == -1.5
    assert rows[4].z is None and rows[5].z == 0.0
    assert df.agg(X.guarded_corr(F.lit(1.0), F.col("b")).alias("c")).first().c is None
    assert [r.m for r in df.select(X.row_mean([F.lit(None).cast("double"), F.lit(2.0)]).alias("m")).collect()] == [2.0] * 6
    assert df.select(X.row_mean([F.lit(None).cast("double")]).alias("m")).first().m is None


def test_indicator_code(spark):
    df = spark.createDataFrame([("x 23012 y",), ("none",), (None,)], "t string")
    assert [r.c for r in df.select(X.indicator_code("t", ["2301[234]"]).alias("c")).collect()] == ["23012", None, None]


def test_spine_fills_gaps_and_joins(spark):
    df = spark.createDataFrame([("a", month(2000, 1), 1.0), ("a", month(2000, 4), 2.0), ("b", month(2001, 2), 3.0), ("c", None, 1.0)], "area string, month date, v double")
    got = {(r.area, r.month): r.v for r in calendar.on_spine(df, ["area"]).collect()}
    assert got == {("a", month(2000, 1)): 1.0, ("a", month(2000, 2)): None, ("a", month(2000, 3)): None, ("a", month(2000, 4)): 2.0, ("b", month(2001, 2)): 3.0}
    assert calendar.months(spark, "2000-01-01", "2023-12-01").count() == 288
    with pytest.raises(ValueError):
        calendar.assert_unique(df.unionByName(df), ["area", "month"])
    with pytest.raises(KeyError):
        calendar.must_match(df.select("area", "month"), df.where("v < 3"), ["area", "month"])
    new = calendar.overlay(df.where("area = 'a'"), spark.createDataFrame([("a", month(2000, 1), 9.0)], "area string, month date, v double"), ["area", "month"], "v")
    assert sorted(r.v for r in new.collect()) == [2.0, 9.0]
    assert calendar.future_months(df, 12, ["area"]).count() == 24


def test_rollup_edge_cases(spark):
    rows = [
        ("one", dt.date(2001, 1, 5), 10.0, 11.0, 9.0),
        ("early", dt.date(2001, 1, 3), 10.0, 10.0, 10.0), ("early", dt.date(2001, 1, 4), 11.0, 11.0, 11.0),
        ("gap", dt.date(2001, 1, 3), 1.0, 1.0, 1.0), ("gap", dt.date(2001, 1, 10), None, None, None), ("gap", dt.date(2001, 1, 20), 2.0, 2.0, 2.0),
        ("zero", dt.date(2001, 1, 3), 0.0, 1.0, 0.0), ("zero", dt.date(2001, 1, 20), 2.0, 2.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "k string, date date, close double, high double, low double")
    got = {r.k: r for r in rollup.daily_to_monthly(df, ["k"], prefix="s").collect()}
    assert got["one"].s_trend_per_day == 0.0 and got["one"].s_late_minus_early == 0.0 and got["one"].s_abs_daily_move_mean == 0.0 and got["one"].s_std == 0.0
    assert got["early"].s_late_minus_early == 0.0 and math.isclose(got["early"].s_abs_daily_move_max, 0.1) and got["early"].s_extreme_up_days == 1
    assert got["gap"].s_trend_per_day is None and got["gap"].s_trading_days == 3
    assert math.isclose(got["gap"].s_abs_daily_move_mean, 0.5)  # the gap carries the close before: moves of 0 and 1
    assert got["zero"].s_month_return == 0.0 and got["zero"].s_abs_daily_move_mean == 0.0 and got["zero"].s_intraday_spread_mean == 0.0
    doubled = df.unionByName(df.limit(3))
    assert rollup.exact_duplicates(doubled).first().n_duplicates == 3 and rollup.without_exact_duplicates(doubled).count() == len(rows)


def test_strict_pivot(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "x", None)], "k int, c string, v double")
    assert {tuple(r) for r in reshape.strict_pivot(df, ["k"], "c", "v", ["x", "y"]).collect()} == {(1, 1.0, 2.0)}
    with pytest.raises(ValueError):
        reshape.strict_pivot(df.unionByName(df), ["k"], "c", "v", ["x", "y"])
    with pytest.raises(ValueError):
        reshape.strict_pivot(df.unionByName(spark.createDataFrame([(3, None, 1.0)], df.schema)), ["k"], "c", "v", ["x"])


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(10, 2, 60)
    other = values.copy()
    other[40:] += 100
    both = series(spark, values, key="a").unionByName(series(spark, other, key="b")).withColumn("d", F.col("v") * 2)
    rows = features.origin_features(both, ["area"], "v", drivers=["d"], panel=[("v", "d")]).orderBy("area", "month").collect()
    a, b = [r for r in rows if r.area == "a"], [r for r in rows if r.area == "b"]
    assert all(x[2:] == y[2:] for x, y in zip(a[:40], b[:40], strict=True)) and a[40][2:] != b[40][2:]


def test_rolling_needs_a_full_window(spark):
    df = series(spark, [1, 2, None, 4, 5, 6])
    w = features.by_month(["area"])
    got = [r.r for r in df.select("month", X.rolling_mean("v", 3, w).alias("r")).orderBy("month").collect()]
    assert got == [None, None, None, None, None, 5.0]


def test_samples_and_leakage(spark):
    df = series(spark, [float(i) for i in range(60)])
    s = samples.sequence_samples(df, ["area"], ["v"], "v", context=24, horizon=12)
    rows = s.orderBy("origin").collect()
    assert len(rows) == 60 - 23 - 12 and rows[0].x[0] == [0.0] and rows[0].x[-1] == [23.0] and rows[0].y == [float(i) for i in range(24, 36)]
    kept = samples.through(s, "2003-06-01").collect()
    assert kept and all(r.label_end <= dt.date(2003, 6, 1) for r in kept)
    with pytest.raises(ValueError):
        samples.latest_context(s, ["area"], "1990-01-01")
    gap = series(spark, [float(i) if i != 30 else None for i in range(60)])
    assert samples.sequence_samples(gap, ["area"], ["v"], "v", context=24, horizon=12).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=1, max_size=20))
def test_metric_bounds(spark, pairs):
    r = metrics.metric_set(spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "actual double, predicted double")).first()
    assert r.rmse >= r.mae - 1e-9 and 0 <= r.smape <= 200 + 1e-9 and abs(r.bias) <= r.mae + 1e-9


def test_winner_ties_and_contract(spark):
    s = spark.createDataFrame([("naive", 0.1), ("B", 1.0), ("A", 1.0)], "model string, rmse double")
    assert metrics.winner(s, ["B", "A"]).first().winner == "B" and metrics.winner(s, ["A", "B"]).first().winner == "A"
    good = spark.createDataFrame([(f"2024-{m:02d}", 1.0) for m in range(1, 13)], "year_month string, forecast double")
    metrics.assert_contract(good, "2024-01-01")
    for bad in (good.where("year_month <> '2024-03'"), good.unionByName(good), good.withColumn("forecast", F.lit(float("nan"))), good.withColumnRenamed("forecast", "f")):
        with pytest.raises(ValueError):
            metrics.assert_contract(bad, "2024-01-01")
    with pytest.raises(ValueError):
        metrics.naive_year(series(spark, range(10)), ["area"], "v", 2001)


def test_ols_and_p_values(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) * [1e6, 1e-3] + [1e8, 5]
    y = 3e5 + x @ [2.0, 1e5] + rng.normal(size=200)
    df = spark.createDataFrame([("k", float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "k string, a double, b double, y double")
    rows = {r.term: r for r in regression.ols(df, ["k"], "y", ["a", "b"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.lstsq(np.c_[np.ones(200), z], y, rcond=None)[0][1:] / x.std(0)
    assert np.allclose([rows["a"].coefficient, rows["b"].coefficient], want, rtol=1e-6)
    assert rows["a"].p_value < 1e-10 and 0 <= rows["intercept"].p_value <= 1
    failed = regression.ols(df.withColumn("b", F.lit(1.0)), ["k"], "y", ["a", "b"]).collect()
    assert [(r.term, r.n, r.coefficient, bool(r.reason)) for r in failed] == [(t, 200, None, True) for t in ("intercept", "a", "b")]
    # values of published tables
    assert abs(regression.student_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(regression.f_survival(4.102821015, 2, 10) - 0.05) < 1e-8
    assert regression.f_survival(0, 2, 10) == 1.0


def test_granger_finds_a_driver(spark):
    rng = np.random.default_rng(2)
    d = rng.normal(size=200)
    t = np.zeros(200)
    for i in range(1, 200):
        t[i] = 0.3 * t[i - 1] + 0.8 * d[i - 1] + 0.1 * rng.normal()
    df = spark.createDataFrame([("k", month(2000, i + 1), float(t[i]), float(d[i]), float(rng.normal())) for i in range(200)], "k string, month date, t double, d double, o double")
    assert regression.granger(df, ["k"], "t", "d").first().p_value < 1e-10
    assert regression.granger(df, ["k"], "t", "o").first().p_value > 0.001


def test_stationarity_of_walk_and_noise(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=300)
    df = series(spark, noise, key="noise").unionByName(series(spark, np.cumsum(noise), key="walk")).unionByName(series(spark, [1.0] * 30, key="flat"))
    got = {(r.area, r.variant): r for r in stationarity.stationarity(df, ["area"], "v").collect()}
    assert got["noise", "level"].adf_p_value < 0.01 and got["noise", "level"].kpss_p_value > 0.05
    assert got["walk", "level"].adf_p_value > 0.1 and got["walk", "level"].kpss_p_value < 0.05 and got["walk", "first_difference"].adf_p_value < 0.01
    assert got["flat", "level"].adf_statistic is None
    assert abs(stationarity.adf_p_value(-2.86) - 0.05) < 0.002 and abs(stationarity.adf_p_value(-3.43) - 0.01) < 0.001


def test_sarima_recovers_and_forecasts():
    rng = np.random.default_rng(4)
    x = np.zeros(400)
    for i in range(1, 400):
        x[i] = 0.7 * x[i - 1] + rng.normal()
    fit = sarima.fit_sarima(x + 5, (1, 0, 0), (0, 0, 0))
    assert abs(-fit.ar[1] - 0.7) < 0.1 and abs(fit.mean - 5) < 0.6 and fit.converged
    mean, se = fit.forecast(12)
    assert (np.diff(se) > 0).all() and abs(mean[-1] - fit.mean) < abs(mean[0] - fit.mean) + 0.1
    season = np.tile(np.arange(12.0), 20) + np.arange(240) * 0.5
    mean, _ = sarima.fit_sarima(season + rng.normal(0, 0.01, 240), (0, 1, 1), (0, 1, 1)).forecast(12)
    assert np.allclose(mean, np.arange(12) + np.arange(240, 252) * 0.5, atol=0.2)
    with pytest.raises(ValueError):
        sarima.fit_sarima(np.arange(10.0), (1, 0, 0), (1, 0, 0))



def test_gru_gradients_and_learning():
    rng = np.random.default_rng(5)
    shape = gru.Shape(3, 4, 2)
    x, y = rng.normal(size=(5, 6, 3)), rng.normal(size=(5, 2))
    vector = shape.start(rng) + rng.normal(0, 0.1, shape.parameters)
    loss, slope = gru.slope(shape, vector, x, y, 0.01)
    assert abs(loss - gru.squared_error(shape, vector, x, y, 0.01)) < 1e-12
    for i in range(shape.parameters):
        step = np.eye(shape.parameters)[i] * 1e-6
        up, down = (gru.squared_error(shape, vector + s, x, y, 0.01) for s in (step, -step))
        assert abs((up - down) / 2e-6 - slope[i]) < 1e-6, i
    assert gru.Shape(9).parameters == 1452
    with pytest.raises(ValueError):
        gru.fit(x, y)
    t = np.arange(200) / 5
    wave = np.sin(t)
    xs = np.array([wave[i : i + 12, None] for i in range(170)])
    ys = np.array([wave[i + 12 : i + 15] for i in range(170)])
    net, history = gru.fit(xs, ys, hidden=8, epochs=120, dropout=0.0)
    assert history.validation_loss.min() < 0.2 * history.validation_loss.iloc[0]
    again = gru.from_row(gru.as_row(net))
    assert np.allclose(again.predict(xs[:3]), net.predict(xs[:3])) and net.predict(xs[:3]).shape == (3, 3)
    batched, _ = gru.fit(xs, ys, hidden=8, epochs=40, batch=50)
    assert np.isfinite(batched.predict(xs)).all()


def test_gru_by_groups_of_series(spark):
    rng = np.random.default_rng(6)
    rows = [(f"s{k}", dt.date(2000 + i // 12, i % 12 + 1, 1), np.sin(k + i / 3 + np.arange(6))[:, None].tolist(), [float(np.sin(k + i / 3 + 6)), 1.0]) for k in range(7) for i in range(60)]
    rows += [("short", dt.date(2000, 1, 1), rng.normal(size=(6, 1)).tolist(), [0.0, 1.0])]
    df = spark.createDataFrame(rows, "area string, origin date, x array<array<double>>, y array<double>").withColumn("year", F.when(F.col("area") == "short", 2).otherwise(1))
    parts = gru.grouped(df, ["area"], 2)
    assert parts.select("part").distinct().count() > 1 and parts.count() == df.count() and gru.GROUP_SERIES == 64
    models = gru.train(df, ["year"], ["area"], epochs=3, validation=10).collect()
    assert {(m.year, m.model is None, m.reason) for m in models} == {(1, False, None), (2, True, "1 samples are too few")}
    kept = spark.createDataFrame(models, gru.train(df, ["year"], ["area"]).schema)
    found = gru.predict(df, kept, ["year"], ["area", "origin"], ["area"]).collect()
    assert len(found) == 7 * 60 * 2 and {r.h for r in found} == {1, 2} and all(np.isfinite(r.predicted) for r in found)
    assert {tuple(r) for r in gru.unscored(df, kept, ["year"], ["area"], ["area"]).collect()} == {("short", "1 samples are too few")}


def test_gru_scores_by_own_network(spark):
    """65 series in training and 64 (or other ones) in scoring: each by the network that
    has learned from it."""
    rows = [(f"s{k}" if k else None, dt.date(2000 + i // 12, i % 12 + 1, 1), np.sin(k + i / 3 + np.arange(4))[:, None].tolist(), [float(k)]) for k in range(65) for i in range(14)]
    df = spark.createDataFrame(rows, "area string, origin date, x array<array<double>>, y array<double>").withColumn("year", F.lit(1))
    models = gru.train(df, ["year"], ["area"], epochs=1, validation=10, hidden=4).collect()
    assert len(models) == 2 and sum(len(m.members) for m in models) == 65
    own = {member.area: gru.from_row(m.model) for m in models for member in m.members}
    kept = spark.createDataFrame(models, gru.train(df, ["year"], ["area"]).schema)
    late = df.where("origin = '2001-02-01' AND coalesce(area, '') <> 's7'").unionByName(df.where("area = 's9' AND origin = '2001-02-01'").withColumn("area", F.lit("new")))
    found = {r.area: r.predicted for r in gru.predict(late, kept, ["year"], ["area"], ["area"]).collect()}
    assert set(found) == {r.area for r in late.collect()} - {"new"} and len(found) == 64 and None in found
    for r in late.collect():
        if r.area != "new":
            assert found[r.area] == pytest.approx(own[r.area].predict(np.array([r.x]))[0, 0], abs=1e-12)
    assert [tuple(r) for r in gru.unscored(late, kept, ["year"], ["area"], ["area"]).collect()] == [("new", "no network has learned from this series")]


def test_errors_name_what_is_missing(spark):
    df = series(spark, [1.0, 2.0, 3.0]).withColumn("x", F.array("v"))
    one = df.select("area", F.col("month").alias("origin"), "x")
    first = df.agg(F.min("month")).first()[0].isoformat()
    assert samples.latest_context(one, ["area"], first).count() == 1
    two = one.unionByName(one.limit(1).withColumn("area", F.lit("other")).withColumn("origin", F.lit("1900-01-01").cast("date")))
    with pytest.raises(ValueError, match="other"):
        samples.latest_context(two, ["area"], first)
    with pytest.raises(ValueError, match="other"):
        samples.latest_context(one, ["area"], first, wanted=two)
    year = spark.createDataFrame([("a", dt.date(2000, m, 1), 1.0) for m in range(1, 13)] + [("b", dt.date(1999, 1, 1), 1.0)], "area string, month date, v double")
    with pytest.raises(ValueError, match="b"):
        metrics.naive_year(year, ["area"], "v", 2001)
    assert metrics.naive_year(year.where("area = 'a'"), ["area"], "v", 2001).count() == 12
    jobs = sarima.specs(spark, sarima.CANDIDATES[:1]).withColumn("origin", F.lit("2000-12-01").cast("date"))
    failed = sarima.forecast_sarima(year, ["area"], "v", jobs).collect()
    assert all(r.predicted is None and "too few" in r.reason for r in failed) and {r.area for r in failed} == {"a", "b"}


def test_sources_and_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    with pytest.raises(sources.MissingSources) as e:
        sources.Registry(spark, {"one": sources.Source(f"{root}/1.csv", sources.MONTHLY), "two": sources.Source(f"{root}/2.csv", sources.MONTHLY)}).require()
    assert "one" in str(e.value) and "two" in str(e.value)
    (tmp_path / "1.csv").write_text("date,value\n2000-01-15,1.5\n2000-02-15,NaN\n")
    reg = sources.Registry(spark, {"one": sources.Source(f"{root}/1.csv", sources.MONTHLY)})
    reg.register()
    assert [r.value for r in spark.sql("SELECT value FROM one ORDER BY date").collect()] == [1.5, None]
    df = spark.range(3).select(F.col("id"), F.lit("x").alias("a"))
    sinks.write_csv(df, f"{root}/out.csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{root}/out.csv").count() == 3
    sinks.write_json(df, f"{root}/out.json")
    assert spark.read.text(f"{root}/out.json").first().value.startswith('{"a":"x","id":')
    m = {r.path.rsplit("/", 1)[-1]: r for r in sinks.manifest(spark, root, "*.csv").collect()}
    assert m["1.csv"].bytes == len("date,value\n2000-01-15,1.5\n2000-02-15,NaN\n")
    assert '"rows": [' in sinks.results_json({"rows": df, "x": float("nan")}) and "NaN" not in sinks.results_json({"x": float("nan")})
    with pytest.raises(ValueError):
        sinks.results_json({"rows": df}, most=2)
    sinks.zip_files(str(tmp_path / "z.zip"), {"b/1.csv": str(tmp_path / "1.csv")})
    assert (tmp_path / "z.zip").stat().st_size > 0
    big = {r.path: r.sha256 for r in sinks.manifest(spark, root, "*.csv").collect()}
    sinks.WHOLE_BYTES, whole = 1, sinks.WHOLE_BYTES
    assert {r.path: r.sha256 for r in sinks.manifest(spark, root, "*.csv").collect()} == big
    sinks.WHOLE_BYTES = whole
    assert sinks.line_chart(series(spark, [1, 2, None, 3, 4]), "month", ["v"], "t").count("<polyline") == 2
    with pytest.raises(ValueError):
        sources.Config.from_json('{"evaluation_years": [2020], "tuning_years": [2020]}')
    (tmp_path / "c.json").write_text('{"horizon": 6, "other": 1}')
    assert sources.read_config(spark, f"{root}/c.json").horizon == 6


def test_stream_of_daily_bars(spark, tmp_path):
    from tideline.streaming import daily

    rows = [(dt.datetime(2024, 1, d, h), "a", float(d * h)) for d in range(1, 9) for h in (3, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    daily.run_available(daily.daily_bars(stream, ["k"], "ts", "value", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.date: r.close for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.date: r.close for r in daily.daily_bars(df, ["k"], "ts", "value").collect()}
    assert got and all(want[d] == v for d, v in got.items())


def test_sql_functions(spark):
    from tideline.functions import udfs

    udfs.register(spark)
    r = spark.sql("SELECT student_p(2.228138852D, 10D) AS t, f_p(4.102821015D, 2D, 10D) AS f").first()
    assert abs(r.t - 0.05) < 1e-8 and abs(r.f - 0.05) < 1e-8
    rows = spark.sql("SELECT * FROM lag_spec('a,b', '0,12') ORDER BY name").collect()
    assert [tuple(x) for x in rows] == [("a", 12, "a_lag12"), ("a", 0, "a_now"), ("b", 12, "b_lag12"), ("b", 0, "b_now")]
    series(spark, [1, -1] * 10).coalesce(1).createOrReplaceTempView("wave")
    assert abs(spark.sql("SELECT acf(v, 1) AS a FROM wave GROUP BY area").first().a + 1) < 1e-9
