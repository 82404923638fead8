from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[list(ids).index(q)]).sum(1)
        keep = ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_hadamard():
    x = np.eye(8)
    h = ann.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def found_by(spark, df, **options):
    got: dict = {}
    for r in ann.search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, **options).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(found) for q, found in got.items()}


def recall(got, ids, x) -> float:
    """Share of the true neighbours found; lists must be whole, ordered and exact."""
    want = brute(ids, x, [i for i in ids.tolist() if i % 20 == 0])
    assert set(got) == set(want)
    hit = total = 0
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        near = dict(want[q])
        hit += sum(i in near for _, i, _ in found)
        total += len(want[q])
        for _, i, s in found:
            assert i != q and (i not in near or abs(near[i] - s) < 1e-12 * max(1, abs(s)))
    return hit / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall(found_by(spark, df), ids, x) >= 0.9


def test_recall_on_a_larger_table(spark):
    """Ten times the rows of the largest table: the vectors of it with noise."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rng = np.random.default_rng(1)
    x = np.repeat(np.array([r.embedding for r in rows], float), 10, axis=0)
    x = (x + rng.normal(0, 0.12, x.shape)).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    assert recall(found_by(spark, df), ids, x) >= 0.9


@pytest.mark.parametrize("outlier", [1.0, 100.0])
def test_recall_with_unequal_norms(spark, outlier):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x *= (rng.lognormal(0, 0.5, len(x)) / np.linalg.norm(x, axis=1))[:, None]
    x[7] *= outlier
    ids = np.arange(len(x))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    assert recall(found_by(spark, df), ids, x) >= 0.9


@pytest.mark.parametrize("n", [1, 2, 15, 21, 30, 60])
def test_lists_are_whole(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found_by(spark, df)
    assert {q: len(found) for q, found in got.items()} == ({q: min(20, n - 1) for q in range(0, n, 20)} if n > 1 else {})
    if n > 1:
        assert recall(got, np.arange(n), x) >= 0.9


def test_deep_hashes():
    """Two hashes to a bucket: its name is met first where the query is the vector."""
    x = np.random.default_rng(3).normal(size=(50, 16))
    unit, norms = ann.directions(x)
    assert np.allclose(np.linalg.norm(x, axis=1), norms) and ann.depth_of(256 * 32 * 32, 16) == 2
    h = ann.Hashes(16, 2, 2, 1)
    assert (h.probed(unit, 1, 1)[:, 0] == h.codes(unit, 1)).all()
    assert len(set(h.near(unit[:1], 0)[0][0].tolist())) == h.near(unit[:1], 0)[0].shape[1] == 32 * 32


def test_deep_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_VECTORS", 1)
    x = np.random.default_rng(4).normal(size=(400, 4))
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.Search(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20, 3, 2048, 1).plan.hashes(4).depth == 2
    assert recall(found_by(spark, df), ids, x) >= 0.9


def test_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [2.0, 4.0]), (3, [-1.0, 0.5]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (20, [3.0, 6.0, 9.0]), (21, [1.0, 1.0, 1.0]), (40, [0.0, 0.0]), (1, [2.0, 4.0]), (1, [-9.0, 0.0]), (9, [float("inf"), 1.0]), (60, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'a' AS score", "1 AS lot", "2 AS dim", "3 AS code")
    for lot in (2048, 1):
        got = found_by(spark, df, lot=lot)
        assert got == {0: [(1, 1, 10.0), (2, 2, 10.0), (3, 3, 0.0)], 20: [(1, 21, 18.0)]}
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0).count() == 0
    # an id with more rows than a list has places, and its own rows are not its neighbours
    many = [(5, [10.0 + i, 1.0]) for i in range(200)] + [(0, [1.0, 0.0])] * 3 + [(0, [5.0, 5.0])] + [(i, [1.0, float(i)]) for i in range(6, 20)]
    found = found_by(spark, spark.createDataFrame(many, "vec_id long, embedding array<double>"), lot=10)[0]
    assert [(n, i) for n, i, _ in found][0] == (1, 5) and len(found) == 15 and len({i for _, i, _ in found}) == 15
