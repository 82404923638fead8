from __future__ import annotations

import random

import corpus_pipeline
from tideline.llm import similar


def shingles(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(texts: dict[int, str | None]) -> set[int]:
    """Least id of each component of pairs of Jaccard similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    where: dict = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, set()).add(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j in set().union(*(where[x] for x in s)):
            n = len(s & sets[j])
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in root}


def test_table_by_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert len(got) == len({r.doc_id for r in got})
        assert {r.doc_id for r in got} == brute({r.doc_id: r.text for r in docs.collect()})


def test_chains_and_loose_pairs(spark):
    """Chains whose ends are not similar, pairs on both sides of 0.8, many copies."""
    rng = random.Random(4)
    texts: dict[int, str | None] = {}
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            texts[len(texts)] = " ".join(words)
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    texts |= {len(texts): None, len(texts) + 1: " \n", len(texts) + 2: texts[0].upper()}
    rows = list(texts.items())
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS cls", "1 AS id", "2 AS least").repartition(3)
    out = similar.keep_one(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == brute(texts)
