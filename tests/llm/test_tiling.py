from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import tiling


def plain_tiles(item, text, least):
    """Greedy tiling by trying every pair of starts each time."""
    taken_i, taken_t, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and item[i + k] == text[t + k] and not taken_i[i + k] and not taken_t[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        if best[0] < least:
            return tiles
        k, i, t = best
        taken_i[i : i + k] = [True] * k
        taken_t[t : t + k] = [True] * k
        tiles.append((i, t, k))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=24), st.lists(st.integers(1, 4), max_size=30), st.integers(1, 5))
def test_tiles_are_the_greedy_ones(item, text, least):
    assert tiling.greedy_tiles(item, text, least) == plain_tiles(item, text, least)


def test_reordered_passages():
    rng = random.Random(1)
    for _ in range(40):
        item = list(range(1, 41))
        cuts = sorted(rng.sample(range(1, 40), 4))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, 99]]
        assert tiling.greedy_tiles(item, text, 5) == plain_tiles(item, text, 5)


def test_hashes_that_collide(monkeypatch):
    rng = random.Random(2)
    free = tiling.Side.free
    monkeypatch.setattr(tiling.Side, "free", lambda self, n: (free(self, n)[0], free(self, n)[1] & np.uint64(3)))
    for _ in range(60):
        item, text = [rng.randint(1, 5) for _ in range(25)], [rng.randint(1, 5) for _ in range(40)]
        assert tiling.greedy_tiles(item, text, 3) == plain_tiles(item, text, 3)


def test_repetitive_and_long_texts_take_no_time():
    began = time.time()
    tiling.greedy_tiles([1, 2] * 100, [1, 2, 2, 1] * 1500, 5)
    tiling.greedy_tiles(list(range(5000)), [*range(2500, 5000), *[7] * 300_000, *range(2500)], 5)
    tiling.greedy_tiles([1] * 3000, [1] * 60_000, 5)
    assert time.time() - began < 20


def test_run_hashes():
    ids = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    h = tiling.run_hashes(ids, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 3 and not len(tiling.run_hashes(ids, 7))
    side = tiling.Side([5, 6, 7, 5, 6, 7])
    side.taken[2] = True
    at, h = side.free(2)
    assert at.tolist() == [0, 3, 4] and h[0] == h[1] != h[2]


def frames(spark):
    item = [f"token{i}" for i in range(40)]
    other = [f"word{i}" for i in range(30)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None), (10, ""), (11, "tiny item")], "item_id long, text string").selectExpr("*", "'x' AS coverage")
    rows = [
        (1, "Intro. " + " ".join(item) + " and more"),
        (2, " ".join(item[20:]) + ", well, " + " ".join(item[:20]).upper()),
        (3, " ".join(item[:20])),
        (4, " ".join(x for i in range(0, 40, 4) for x in [*item[i : i + 4], "gap"])),
        (5, None),
        (6, ""),
        (None, " ".join(other)),
        (1, "Intro. " + " ".join(item) + " and more"),
        (12, "filler " * 100_000 + " ".join(other)),
        (13, "here a tiny, item stands"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item", "'en' AS coverage")
    return docs, bench


def test_rows(spark):
    docs, bench = frames(spark)
    for bits in (26, 15):
        got = sorted([(r.doc_id, r.item_id, round(r.coverage, 3)) for r in tiling.contaminated(docs, bench, bits=bits).collect()], key=repr)
        assert got == sorted([(1, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0), (None, 8, 1.0), (12, 8, 1.0), (13, 11, 1.0)], key=repr)
        clean = tiling.decontaminate(docs, bench, bits=bits)
        assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0 and tiling.contaminated(docs.limit(0), bench).count() == 0


def brute(docs: list[tuple], items: list[tuple], threshold: float = 0.8) -> dict[tuple, float]:
    """(doc, item) -> coverage by :func:`plain_tiles`; pairs without a common run of five
    tokens have none, and words that the other side lacks only break runs."""
    found = {}
    for doc, text in docs:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for key, item_text in items:
            item = re.findall(r"[^\W_]+", (item_text or "").lower())
            if any(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4)):
                own = set(item)
                cut = [w for w, g in itertools.groupby([w if w in own else None for w in words]) for w in (list(g) if w is not None else [None])]
                covered = sum(k for *_, k in plain_tiles(item, cut, 5))
                if covered >= threshold * len(item):
                    found[doc, key] = covered / len(item)
    return found


def test_table_by_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling.contaminated(docs, bench).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]) and got


def test_items_with_common_passages(spark):
    """Hundreds of items that share a passage, and texts that cover some of them."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(300)}"
    common = [word() for _ in range(12)]
    items = [(i, " ".join([*common, *[word() for _ in range(rng.choice([8, 20, 40]))]])) for i in range(200)]
    docs = [(i, " ".join([word(), *(rng.choice(items)[1].split())[rng.randrange(3) :], *common, *[word() for _ in range(20)], *rng.choice(items)[1].split()])) for i in range(40)]
    got = {(r.doc_id, r.item_id): r.coverage for r in tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 60
