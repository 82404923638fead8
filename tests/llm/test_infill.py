from __future__ import annotations

import hashlib
import random

import numpy as np
from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import infill, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=900, unique=True).map(sorted))
def test_list(values):
    kept = infill.EliasFano.from_bytes(infill.EliasFano.of(np.array(values)).to_bytes())
    assert [kept[i] for i in range(len(kept))] == values


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé€😀 \n", max_size=700))
def test_boundaries(text):
    raw = text.encode()
    kept = infill.boundaries(raw)
    assert len(kept) == len(text) + 1
    assert all(raw[: kept[i]].decode() == text[:i] for i in range(len(kept)))


def test_list_is_small():
    assert len(infill.boundaries(b"some words " * 100_000).to_bytes()) < 1_100_000 * 0.3


def plain(name, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return name, n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = text[:a], text[a:b], text[b:]
    return (name, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (name, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rows(spark):
    """Copies in few and in many documents, dealt to parts; odd and very long texts."""
    rng = random.Random(2)
    texts = [None, "", "x", "ends in <", "<P", "holds <S> one", "😀é" * 50, "long " * 300_000, *["".join(rng.choice("ab<PSM>é😀 ") for _ in range(rng.randint(1, 60))) for _ in range(60)]]
    rows = [(i, rng.choice(texts)) for i in range(800)] + [(5000 + i, "a copy of many") for i in range(900)] + [(None, "no id"), (None, "no id"), (7, "same id"), (7, "same id"), (7, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS h", "1 AS id", "2 AS name", "3 AS part", "4 AS digest", "5 AS n").repartition(6)
    for least_share in (50, 1000):
        out = infill.fill_in_middle(df, least_share=least_share).withColumn("again", infill.restored())
        got = [tuple(r) for r in out.collect()]
        assert sorted([g[:6] for g in got], key=repr) == sorted([plain(*r) for r in rows], key=repr)
        assert sorted([(g[0], g[6]) for g in got], key=repr) == sorted([(i, t or "") for i, t in rows], key=repr)
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_lists_are_made_once(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text")).repartition(4)
    rows = df.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("name"), "text", F.xxhash64("text").alias("h"))
    found = infill.references(rows)
    assert found.where("text IS NOT NULL").count() == 4 and infill.distinct_texts(found).count() == 1


def test_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not compare(spark, f"/root/testdata/{sf}", queries.queries()["op12_fill_in_middle"], queries.oracle_sql()["op12_fill_in_middle"])
