from __future__ import annotations

import hashlib
import random

from tideline.llm import substrings


def plain(rows: list[tuple[int | None, str | None]], window: int = 13) -> list[tuple]:
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict = {}
    for i, w in words:
        if i is not None:
            for a in range(len(w) - window + 1):
                key = tuple(w[a : a + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "2 AS doc", "3 AS mark").repartition(3)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df, **options).collect()], key=repr)


def test_word_hashes():
    texts = [b"a bb  ccc", b"", b" \t", b"a bb ccc" + b"d" * 40 + b" a", "é é".encode()]
    h, text = substrings.word_hashes(texts)
    assert text.tolist() == [0, 0, 0, 3, 3, 3, 3, 4, 4]
    assert h[0] == h[3] == h[6] and h[1] == h[4] and h[7] == h[8] and len(set(h.tolist())) == 5


def test_spaced_words():
    line, begins = substrings.spaced([b"a bb  ccc\n", b"", b" x", b"yy \t z "])
    assert line == b"a bb ccc x yy z " and begins.tolist() == [0, 2, 5, 9, 11, 14, 16]


def mixed(seed: int = 5) -> list[tuple]:
    """Passages that documents share in part, whole and repeated, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = []
    for i in range(150):
        parts: list[str] = []
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            parts += p[a:] if rng.random() < 0.5 else p
        rows.append((i, " ".join(parts)))
    return rows + [(3, rows[3][1]), (200, None), (201, ""), (None, rows[5][1]), (202, "the " * 40), (203, "the " * 30), (2, "the " * 20), (7, rows[8][1]), (7, "own " + rows[8][1]), (7, rows[8][1])]


def test_against_brute_force(spark):
    rows = mixed()
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, bitmap_bits=15) == plain(rows)


def test_hot_seeds_and_small_shards(spark):
    """A phrase of six words in surroundings that differ, and automata of a few rows."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(60)}"
    rows = mixed(7) + [(1000 + i, " ".join([*[word() for _ in range(10)], "a", "phrase", "of", "six", "frequent", "words", *[word() for _ in range(10)]])) for i in range(300)]
    rows += [(2000 + i, f"x{i % 3} " + rows[i][1]) for i in range(40)]
    want = plain(rows)
    assert run(spark, rows, hot_places=5) == want
    assert run(spark, rows, shard_bytes=300) == want
    assert run(spark, rows, hot_places=0, shard_bytes=1) == want


def test_hashes_that_collide(spark, monkeypatch):
    """Hashes of two bits: different seeds and windows meet all the time, and still only
    equal words are removed."""
    rows = mixed(9)[:60]
    mix = substrings._mix
    monkeypatch.setattr(substrings, "_mix", lambda h: mix(h) & substrings.np.uint64(0xC000000000000000))
    texts = [(t or "").encode() for _, t in rows]
    assert len(set(substrings.Windows(texts).seed.tolist())) <= 4
    ids, marks = list(range(len(rows))), [0] * len(rows)
    batch = substrings.pa.RecordBatch.from_arrays([substrings.pa.array(ids), substrings.pa.array(marks), substrings.pa.array(texts, substrings.pa.binary())], names=["id", "mark", "text"])
    for hot in (b"\0" * 4096, b"\xff" * 4096):
        found = [s for b in substrings.segment_rows([batch], (b"\xff" * 4096, hot), 13) for s in b.to_pylist()]
        gone: dict = {}
        for s in found:
            if s["n"]:
                gone.setdefault(s["doc"], set()).update(range(s["pos"], s["pos"] + s["n"]))
        groups: dict = {}
        for s in sorted((s for s in found if not s["n"]), key=lambda s: s["doc"]):
            groups.setdefault(s["key"], []).append((s["words"], s["doc"], s["mark"], s["pos"]))
        for doc, _, pos, n in substrings.located(list(groups.values()), 13):
            gone.setdefault(doc, set()).update(range(pos, pos + n))
        assert [(i, len(gone.get(i, ()))) for i in ids] == [(i, n) for i, _, n, _ in sorted(plain(list(zip(ids, [t for _, t in rows], strict=True))))]


def test_spans_are_hits():
    words = " ".join(f"w{i}" for i in range(40)).encode()
    group = [(words, 1, 0, 0), (words, 2, 0, 5), (b"z " + words + b" y", 3, 0, 0)]
    assert sorted(substrings.located([group], 13)) == [(2, 0, 5, 40), (3, 0, 1, 40)]


def test_long_text_and_empty_table(spark):
    long = " ".join(f"t{i % 5000}" for i in range(120_000))
    rows = [(1, "lead " + long), (2, long + " tail"), (3, "x" * 100_000)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[:0]) == [] and run(spark, [(None, None)]) == plain([(None, None)])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(docs).collect()], key=repr)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])
