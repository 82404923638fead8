"""The whole evaluation on made-up sources of the real shape."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import Row

from tideline.operators import samples
from tideline.plans import evaluation
from tideline.sources import sources


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    rng = np.random.default_rng(7)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(288)]
    level, lines = 1000.0, ["date,close,high,low"]
    day = dt.date(2000, 1, 3)
    while day <= dt.date(2023, 12, 29):
        if day.weekday() < 5:
            level = max(50.0, level * (1 + rng.normal(0, 0.02)))
            lines.append(f"{day},{level:.2f},{level * 1.01:.2f},{level * 0.99:.2f}")
        day += dt.timedelta(days=1)
    lines += lines[100:103]  # three exact duplicates
    (root / "daily.csv").write_text("\n".join(lines) + "\n")
    for name, base in (("oil", 60.0), ("rate", 8.0)):
        walk = base + np.cumsum(rng.normal(0, 0.5, 288))
        (root / f"{name}.csv").write_text("date,value\n" + "".join(f"{m.replace(day=15)},{v:.3f}\n" for m, v in zip(months, walk, strict=True)))
    panel, own = ["date,area,indicator,value"], ["date,code,item,value"]
    for area in ("OWN", "AAA", "BBB", "CCC", "DDD"):
        general, food = (100 * np.cumprod(1 + rng.normal(0.004, 0.004, 288) + 0.003 * np.sin(np.arange(288) * np.pi / 6)) for _ in range(2))
        yearly = [None] * 12 + [(food[i] / food[i - 12] - 1) * 100 for i in range(12, 288)]
        for code, values in (("23012", general), ("23013", food), ("23014", yearly)):
            for m, v in zip(months, values, strict=True):
                if v is not None:
                    panel.append(f"{m},{area},INDEX_{code}_X,{float(v)!r}")
                    if area == "OWN":
                        own.append(f"{m},{code},Item {code},{float(v)!r}")
    (root / "panel.csv").write_text("\n".join(panel) + "\n")
    (root / "own.csv").write_text("\n".join(own) + "\n")
    path = lambda n: f"file://{root}/{n}"
    return evaluation.Inputs(path("daily.csv"), {"oil": path("oil.csv"), "rate": path("rate.csv")}, path("own.csv"), path("panel.csv"), "2000-01-01", "2023-12-01", "23014", "23013", "23012", "OWN", ("AAA", "BBB", "CCC", "DDD"), ("AAA", "BBB"))


def test_bundle(spark, inputs):
    b = evaluation.load(spark, inputs)
    audit = b.audit.first()
    assert (audit.months, audit.targets, audit.n_duplicates) == (288, 276, 3) and audit.max_abs_gap < 1e-9
    assert len([c for c in b.monthly.columns if c not in ("month", "unit", "target")]) == 33
    assert len([c for c in b.features.columns if c not in ("month", "unit")]) == 141
    assert len(b.channel_names) == 9
    s = samples.sequence_samples(b.channels, ["unit"], b.channel_names, "target")
    assert s.count() == 241 and samples.through(s, "2020-12-01").count() > 100


def test_cutoff(spark, inputs):
    b = evaluation.load(spark, inputs, "2010-06-14")
    last = b.monthly.orderBy("month", ascending=False).first()
    assert last.month == dt.date(2010, 6, 1) and b.monthly.count() == 126
    whole = evaluation.load(spark, inputs).monthly.where("month = DATE'2010-06-01'").first()
    assert last.shipping_trading_days < whole.shipping_trading_days


def test_missing_source(spark, inputs):
    import dataclasses

    with pytest.raises(sources.MissingSources):
        evaluation.load(spark, dataclasses.replace(inputs, panel=inputs.panel + "x"))


def test_run(spark, inputs, tmp_path):
    config = sources.Config(evaluation_years=(2022, 2023), tuning_years=(2020,))
    files = evaluation.run(spark, inputs, config, f"file://{tmp_path}/out", {"epochs": 25, "patience": 10}, candidates=evaluation.sarima.CANDIDATES[:2])
    names = {r.path.split("/out/")[1].split("/")[0] for r in files.collect()}
    documents = {"feature_report", "model_report", "linkage_memo", "visuals", "pitch_notes"}
    charts = set(evaluation.CHARTS)
    assert {"predictions.csv", "scores.csv", "backtest.csv", "results.json", "audit.json", "monthly.csv", "submission_pack.zip", "code_archive.zip"} | {f"{d}.md" for d in documents} | charts <= names
    read = lambda name: "\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/{name}").collect())
    told = {d: read(f"{d}.md") for d in documents}
    number = lambda v: float(v) if v is not None and v.lstrip("-").replace(".", "", 1).replace("E-", "", 1).isdigit() else v
    table = lambda name: [Row(**{k: number(v) for k, v in r.asDict().items()}) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out/{name}.csv").collect()]
    # each figure that is told stands in its table
    winner = table("winner")[0].winner
    best = next(r for r in table("scores") if r.model == winner)
    assert f"{winner} is selected: RMSE {best.rmse:.3f}, MAE {best.mae:.3f}, sMAPE {best.smape:.2f}, bias {best.bias:.3f}" in told["model_report"]
    assert f"{best.acf_1:.3f} at one month and {best.acf_12:.3f} at twelve" in told["model_report"]
    for r in table("scores"):
        assert f"| {r.model} | {r.rmse:,.3f} | {r.mae:,.3f} |" in told["model_report"]
    for r in table("intervals"):
        assert f"| {r.year_month} | {r.predicted:,.3f} | {r.std_error:,.3f} | {r.lower:,.3f} | {r.upper:,.3f} |" in told["model_report"]
    pressure = table("pressure")[0]
    assert f"mean of {pressure['mean']:.1f}, a peak of {pressure.peak:.1f} in {pressure.peak_month}" in told["linkage_memo"] and f"{pressure.months_over:.0f} months are at or over" in told["linkage_memo"]
    pattern = table("pattern")[0]
    assert f"June to October of 2023 went from {pattern.actual_june:.1f} to {pattern.actual_october:.1f} (a fall of {pattern.actual_drop:.1f})" in told["pitch_notes"]
    audit = json.loads(read("audit.json"))
    assert f"{audit['n_rows']} daily rows from {audit['first_date']} to {audit['last_date']}, of which {audit['n_duplicates']}" in told["feature_report"]
    assert all(f"]({c})" in told["visuals"] for c in charts)
    # members of the pack are the files of the manifest
    import hashlib
    import zipfile

    listed = {r.path.split("/out/")[1].split("/")[0]: r.sha256 for r in files.collect()}
    with zipfile.ZipFile(tmp_path / "out" / "submission_pack.zip") as z:
        assert set(z.namelist()) == {f"{d}.md" for d in documents} | charts | {"predictions.csv", "results.json", "code_archive.zip"}
        assert all(hashlib.sha256(z.read(n)).hexdigest() == listed[n] for n in z.namelist())
    whole = json.loads("\n".join(r.value for r in spark.read.text(f"file://{tmp_path}/out/results.json").collect()))
    assert {"audit", "scores", "tuning", "stationarity", "linkage_correlations", "predictions", "intervals", "models"} <= set(whole) and len(whole["intervals"]) == 12
    p = spark.read.option("header", True).csv(f"file://{tmp_path}/out/predictions.csv").orderBy("year_month").collect()
    assert len(p) == 12 and p[0].year_month == "2024-01" and p[-1].year_month == "2024-12"
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out/backtest.csv").count() == 2 * 12 * 3
