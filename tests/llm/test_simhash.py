from __future__ import annotations

import itertools
import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import simhash, similar


def plain(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components(items: dict[int, int], radius: int = 2) -> dict[int, int]:
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(items)
    for i in ids:
        for j in ids:
            if j < i and (items[i] ^ items[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=20), st.integers(0, 2**64 - 1), st.integers(0, 6))
def test_bk_tree(codes, asked, radius):
    tree = simhash.BKTree()
    for c in codes:
        tree.add(c)
    near = list(codes) + [asked ^ 5, asked ^ 1]
    tree.add(asked ^ 5), tree.add(asked ^ 1)
    assert sorted(tree.codes[n] for n in tree.within(asked, radius)) == sorted({c for c in near if (c ^ asked).bit_count() <= radius})


def test_links_lose_nothing(spark):
    """Dense clusters and loose codes, with shards cut as small as they go."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    codes = set()
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            codes.add(x)
    codes |= {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in codes]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from tideline.llm.components import components as stars

    want = components({i: x for i, x in enumerate(sorted(codes, key=lambda x: x - (1 << 64) if x >> 63 else x))})
    order = sorted(signed)
    for size in (2, 2048):
        links = simhash.links(df, tree_size=size)
        root = {r.node: r.root for r in stars(links).collect()}
        got = {i: root.get(x, x) for i, x in enumerate(order)}
        assert {i: order[want[i]] for i in want} == got


def test_rows(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.upper()), (7, None), (6, ""), (6, " \n"), (None, base), (1, "quite another text it is"), (8, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS fp")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    for (i, text) in rows:
        assert (i, f"{plain(text or ''):016x}") in by
    assert {v for (i, _), v in by.items() if i in (5, 3, 9, None)} == {3}
    assert {v for (i, _), v in by.items() if i in (7, 6)} == {6}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (False, 6), (False, 8), (True, None)]


def test_one_stays_of_each_component_in_any_order(spark):
    a, b = " ".join(f"word{i}" for i in range(50)), "some other text of its own"
    rows = [(0, a), (1, a), (1, b)]
    for order in itertools.islice(itertools.permutations(rows), 0, 6, 2):
        df = spark.createDataFrame(list(order), "doc_id long, text string").selectExpr("*", "map('k', doc_id) AS extra")
        assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(0, a), (1, b)]
        assert sorted((r.doc_id, r.text) for r in similar.keep_one(df).collect()) == [(0, a), (1, b)]
    same = [(3, a, "z"), (3, a.upper(), "y"), (3, a, "x"), (4, a, "w")]
    for order in ([3, 2, 1, 0],):
        df = spark.createDataFrame([same[i] for i in order], "doc_id long, text string, source string")
        assert [tuple(r) for r in simhash.keep_one(df).collect()] == [tuple(r) for r in similar.keep_one(df).collect()] == [(3, a.upper(), "y")]


def test_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: plain(r.text or "") for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == components(prints)
