from __future__ import annotations

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import toxicity as tx


def plain_kernel(s: str, t: str, order: int = 3, decay: float = 0.8) -> float:
    total = 0.0
    for a in itertools.combinations(range(len(s)), order):
        for b in itertools.combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=8), st.text("abc", max_size=6)), min_size=1, max_size=6))
def test_kernel_as_defined(pairs):
    words, marks = zip(*pairs, strict=True)
    got = tx.kernel(tx.codes(list(words), 8), tx.codes(list(marks), 6))
    assert np.allclose(got, [plain_kernel(a, b) for a, b in pairs], rtol=1e-4, atol=1e-6)


def test_tokens():
    assert tx.tokens_of("One two. Three\nf o u r e five") == ["One", "two.", "Three", "f", "o", "u", "r", "e", "five", "foure"]
    assert tx.windows("a" * 12) == ["a" * 10] * 3 and tx.windows("ab") == ["ab"]


def plain_value(word: str, mark: str) -> float:
    own = plain_kernel(word, word) * plain_kernel(mark, mark)
    return (plain_kernel(word, mark) / own**0.5) ** tx.POWER if own else 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcdé1", max_size=9), max_size=8), st.lists(st.text("abcd", min_size=4, max_size=6), min_size=1, max_size=3, unique=True))
def test_landmark_values(words, marks):
    got = tx.Landmarks(marks).values(words)
    assert got.shape == (len(words), len(marks))
    assert np.allclose(got, np.array([[plain_value(w, m) for m in marks] for w in words]).reshape(got.shape), atol=1e-4)


def plain_score(model: tx.Model, text: str) -> float:
    """A score from the definition alone."""
    words = [w for t in tx.tokens_of(text) for w in tx.windows(tx.bare(t))]
    alpha = model.whiten @ model.weights
    worst = max([sum(a * plain_value(w, m) for a, m in zip(alpha, model.marks, strict=True)) + model.bias for w in words], default=model.bias)
    return 1 / (1 + np.exp(-(model.slope * worst + model.shift)))


def corpus():
    rng = np.random.default_rng(4)
    syllables = ["ba", "co", "di", "fu", "lo", "me", "ni", "po", "ra", "su", "ta", "ve"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    clean = [". ".join(" ".join(word() for _ in range(8)) for _ in range(5)) for _ in range(600)]
    toxic = []
    for i in range(480):
        words = [word() for _ in range(30)]
        words[int(rng.integers(30))] = ["grumblux", "zwickelt" + word(), "hyxlo"][i % 3]
        toxic.append(" ".join(words))
    return toxic, clean


def test_gaps_and_insertions():
    toxic, clean = corpus()
    model = tx.fit(toxic[:320], clean[:400])
    assert {m[:4] for m in model.marks} & {"grum", "rumb"}
    score = lambda *t: model.scores(list(t))
    assert score(*toxic[320:]).min() > 0.5 and (score(*clean[400:]) >= 0.3).mean() < 0.05
    assert score("ba co grumblux!", "it is g-r-u-m-b-l-u-x di", "such a grumxblux there", "you g r u m b l u x", "GRUMBLUX").min() > 0.3
    assert score("", " \n", "ba di fu").max() < 0.3
    exact, put_in, less, exchanged = model.values(["grumblux", "grumxblux", "grumlux", "grumb1ux"])
    assert exact > put_in > less > exchanged > model.bias + 0.5  # each keeps some of the kernel
    assert score("grumlux", "grumbblux", "grumblu").min() > 0.3
    some = ["ba co grumb1ux", "vedifu zwickelta", "", "g-r-u-m-b-l-u-x", clean[400][:60], "grumblux" + "baco" * 6]
    assert np.allclose(model.scores(some), [plain_score(model, t) for t in some], atol=2e-3)


def test_rows(spark):
    toxic, clean = corpus()
    rows = [(i, t) for i, t in enumerate([*toxic, *clean])] + [(900, None), (901, ""), (None, "a grumblux"), (5, toxic[5]), (902, "ba " * 300_000 + "grumblux")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS toxic", "'x' AS score")
    labels = spark.createDataFrame([(i, 1 if i < len(toxic) else 0) for i in range(len(toxic) + len(clean))] + [(None, 1), (900, None)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[902] > 0.3 and by[None] > 0.3 and by[900] < 0.3 and by[901] < 0.3
    kept = tx.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901}
    assert tx.score(docs.limit(0), model).count() == 0
    assert {r.score for r in tx.score(docs, tx.train(docs, labels.limit(0))).collect()} == {0.0}
    got = spark.range(40).select("id", tx.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy(spark):
    """In this table toxic texts of languages other than English go by word parts that
    some clean texts have too."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in tx.op6_toxicity(spark, d).collect() if r.held_out and r.doc_id in labels]
    share = lambda found: sum(found) / len(found)
    assert share([r.predicted for r in rows if not labels[r.doc_id]]) < 0.03
    assert share([r.predicted for r in rows if labels[r.doc_id]]) > 0.75
    assert share([r.predicted for r in rows if labels[r.doc_id] and lang[r.doc_id] == "en"]) > 0.9
    assert share([r.predicted == labels[r.doc_id] for r in rows]) > 0.94
