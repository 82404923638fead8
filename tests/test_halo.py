from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import exprs as X
from tideline.operators import features, gru, halo, linkage, metrics, samples
from tideline.operators.features import by_month

BIG = 1 << 30  # one block: a plain window


@pytest.fixture(scope="module")
def long(spark):
    """One series of 250 years, one of three, on a spine with missing values."""
    one = spark.range(3000).select(F.lit("long").alias("k"), F.add_months(F.lit("1750-01-01").cast("date"), F.col("id").cast("int")).alias("month"), "id")
    two = spark.range(36).select(F.lit("short").alias("k"), F.add_months(F.lit("1999-07-01").cast("date"), F.col("id").cast("int")).alias("month"), "id")
    df = one.unionByName(two).withColumn("v", F.when(F.col("id") % 97 != 5, F.sin("id") * 10 + 20)).withColumn("u", F.cos(F.col("id") * 3) + 2)
    return df.repartition(6).cache()


def rows(df):
    return sorted(map(str, df.collect()))


def test_equal_to_plain_windows(long):
    K = ["k"]
    makers = {
        "lags": lambda b: features.lag_features(long, K, ["v", "u"], features.TARGET_LAGS, block_months=b),
        "origin": lambda b: features.origin_features(long, K, "v", drivers=["u"], rollups=["u"], rolled=["u"], panel=[("u", "v")], block_months=b).drop("u_now") if b == BIG else features.origin_features(long, K, "v", drivers=["u"], rollups=["u"], rolled=["u"], panel=[("u", "v")], block_months=b).drop("u_now"),
        "channels": lambda b: features.sequence_channels(long, K, "v", "u", "v", passed=["u"], block_months=b),
        "direct": lambda b: samples.direct_samples(long, K, ["v", "u"], "v", block_months=b),
        "contexts": lambda b: samples.contexts(long, K, ["v", "u"], block_months=b),
        "sequences": lambda b: samples.sequence_samples(long, K, ["v", "u"], "u", block_months=b),
    }
    for name, make in makers.items():
        want = rows(make(BIG))
        assert want, name
        for size in (24, 37, 240):
            assert rows(make(size)) == want, (name, size)
    w = by_month(K)
    assert rows(metrics.seasonal_naive(long, K, "v")) == rows(long.withColumn("predicted", F.lag("v", 12).over(w)))
    assert rows(linkage.indicator(long, K, "i", ["v", "u"], as_yoy=True)) == rows(long.withColumn("i", X.row_mean([X.pct_change(c, 12, w) for c in "vu"]) * 100))


def test_a_long_series_is_many_tasks(spark, long):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = features.origin_features(long.where("k = 'long'"), ["k"], "v", block_months=120)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 3000 and len(sizes) >= 5 and max(sizes) <= 1200
        assert "SinglePartition" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_names_that_clash(long):
    df = long.withColumn("_block", F.lit("own")).withColumn("block", F.lit(7))
    assert {r._block for r in metrics.seasonal_naive(df, ["k"], "v").collect()} == {"own"}
    assert samples.packed_blocks(df, ["k"], ["u"], "v").count() == samples.packed_blocks(long, ["k"], ["u"], "v").count()
    assert halo.free(["_BLOCK"], "_block") == "_block_"


def test_cut_gives_the_same_samples(long):
    want = {(r.k, r.origin.year * 12 + r.origin.month - 1): (r.x, r.y) for r in samples.sequence_samples(long, ["k"], ["v", "u"], "u", 12, 6).collect()}
    for size in (40, 240):
        blocks = samples.packed_blocks(long, ["k"], ["v", "u"], "u", 12, 6, block_months=size).collect()
        got = {}
        for b in blocks:
            for o, x, y in zip(*samples.cut(b.months, b.x, b.y, b.first, b.last, 12, 6), strict=True):
                assert (b.k, o) not in got
                got[b.k, int(o)] = (x.tolist(), y.tolist())
        assert got == {k: ([list(s) for s in x], list(y)) for k, (x, y) in want.items()}
    # each month is sent once and in a halo, not once for each window
    assert sum(len(b.months) for b in blocks) < 1.12 * 3036
    with pytest.raises(ValueError, match="each month"):
        samples.cut([1, 3], [[1.0], [2.0]], [1.0, 2.0], 0, 10)


def test_training_from_blocks(spark, long):
    """The same networks as from samples, by fold, with the months that each may know."""
    df = long.where("month >= '1985-01-01'")
    fold = samples.folds(spark, [1995, 2000])
    options = {"epochs": 3, "validation": 10, "hidden": 4}
    one = gru.train(samples.eligible(samples.sequence_samples(df, ["k"], ["u", "v"], "u", 12, 6), fold), ["year"], ["k"], **options)
    two = gru.train_blocks(samples.packed_blocks(df, ["k"], ["u", "v"], "u", 12, 6), fold, ["k"], 12, 6, **options)
    a, b = ({r.year: r for r in t.collect()} for t in (one, two))
    assert a.keys() == b.keys() == {1995, 2000}
    for year in a:
        assert a[year].samples == b[year].samples and a[year].members == b[year].members
        assert np.allclose(a[year].model.vector, b[year].model.vector)
