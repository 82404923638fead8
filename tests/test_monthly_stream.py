from __future__ import annotations

import datetime as dt
import math
import random

import pytest

from tideline.streaming.monthly import MonthlyTable, monthly_figures

SCHEMA = "ts timestamp, k string, value double"


def events(spark):
    rng = random.Random(3)
    rows = [(dt.datetime(2023, 11, 1) + dt.timedelta(hours=rng.randrange(24 * 120)), rng.choice(["a", "b", None]), rng.choice([None, *[float(rng.randint(1, 900)) / 8] * 9])) for _ in range(900)]
    return rows


def same(got, want):
    columns = sorted(want.columns)
    key = lambda r: (str(r["k"]), r["month"])
    a, b = (sorted(df.select(columns).collect(), key=key) for df in (got, want))
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for c in columns:
            assert x[c] == y[c] or math.isclose(x[c], y[c], rel_tol=1e-9, abs_tol=1e-9), (c, x, y)


@pytest.fixture
def table(spark, tmp_path):
    return MonthlyTable(spark, f"file://{tmp_path}/out", ["k"], "ts", "value")


def test_late_and_repeated_batches(spark, table):
    """Batches in any order of time, some run again, give what the whole table gives."""
    rows = events(spark)
    random.Random(5).shuffle(rows)
    lots = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    for number, lot in enumerate(lots):
        batch = spark.createDataFrame(lot, SCHEMA)
        table.upsert(batch, number)
        if number % 2:
            table.upsert(batch, number)
            table.upsert(spark.createDataFrame(lots[number - 1], SCHEMA), number - 1)
        same(table.read(), monthly_figures(spark.createDataFrame([r for own in lots[: number + 1] for r in own], SCHEMA), ["k"], "ts", "value"))
    table.upsert(spark.createDataFrame([], SCHEMA), len(lots))
    want = monthly_figures(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "value")
    same(table.read(), want)
    table.compact(4)
    assert {r.batch for r in table.parts().select("batch").distinct().collect()} == {-1, 4, 5}
    table.refresh([r.ym for r in table.parts().select("ym").distinct().collect()])
    same(table.read(), want)


def test_only_touched_months_are_written(spark, table):
    rows = events(spark)
    table.upsert(spark.createDataFrame(rows, SCHEMA), 0)
    files = lambda: {r.f: r.t for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(table.months_path).selectExpr("path AS f", "modificationTime AS t").collect()}
    before = files()
    table.upsert(spark.createDataFrame([(dt.datetime(2023, 12, 5), "a", 7.0)], SCHEMA), 1)
    after = files()
    assert {f for f in before if "2023-12" not in f} <= set(after) and any("2023-12" in f for f in set(after) - set(before))
    assert all("2023-12" in f for f in set(after) - set(before))


def test_stream(spark, table, tmp_path):
    """Files that come one after another, with a restart from the checkpoint."""
    rows = events(spark)
    rows.sort(key=lambda r: r[2] or 0)
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
        table.run(stream, f"file://{tmp_path}/checkpoint").awaitTermination()
    same(table.read(), monthly_figures(spark.createDataFrame(rows, SCHEMA), ["k"], "ts", "value"))
