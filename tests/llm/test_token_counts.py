from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import token_counts as tc
from tideline.llm.tokens import tokenizer_path

COUNTS = tc.part_counts(tokenizer_path(tc.BYTE_TOKENIZER))
LETTERS = st.text(alphabet="ab '12 \n\t.!lré", max_size=40)


def plain(text: str) -> int:
    return len(COUNTS.encode(text))


@settings(max_examples=500, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12), st.text(alphabet="a '1 \n.lé", max_size=5)), max_size=8))
def test_edits_as_full_count(text, edits):
    kept = tc.CountedText(text, COUNTS)
    assert kept.n_tokens == plain(text)
    for at, n, new in edits:
        start = min(at, len(text))
        end = min(start + n, len(text))
        kept.replace(start, end, new)
        text = text[:start] + new + text[end:]
        assert kept.text() == text and len(kept) == len(text)
        assert kept.n_tokens == plain(text)


def test_little_is_encoded_again():
    text = "some words in a row " * 5000
    kept = tc.CountedText(text, COUNTS)
    kept.replace(50_000, 50_004, "other")
    assert kept.encoded < 20 and kept.n_tokens == plain(text[:50_000] + "other" + text[50_004:])


def depth(node) -> int:
    found, level = 0, [node]
    while level:
        level = [k for n in level if n.parts is None for k in (n.left, n.right)]
        found += bool(level)
    return found


def test_tree_stays_flat():
    """After a large insertion, and after thousands of small ones at one place, an edit
    still encodes little again and finds its leaf in few steps."""
    kept = tc.CountedText("a few words", COUNTS)
    kept.replace(5, 5, " and many more" * 5000)
    before = kept.encoded
    kept.replace(30_000, 30_001, "x")
    assert kept.encoded - before < 20 and depth(kept.root) < 16
    for i in range(3000):
        kept.replace(7, 7, " w" if i % 2 else ".")
    assert depth(kept.root) < 30 and kept.n_tokens == plain(kept.text()) and len(kept) == len(kept.text())
    while len(kept) > 10:
        kept.replace(0, min(len(kept), 997), "")
    assert depth(kept.root) < 10 and kept.n_tokens == plain(kept.text())


def test_nodes_of_an_edit():
    """Single edits enter or make O(log n) nodes in short and in long texts, and edits in
    one batch fewer."""
    for size, most in ((50_000, 60), (5_000_000, 100)):
        text = ("some words 12 in a row, " * (size // 24 + 1))[:size]
        changes = [(i * (size // 5000), i * (size // 5000) + 2, "0") for i in range(5000)]
        kept = tc.CountedText(text, COUNTS)
        before = kept.touched
        for start, end, new in reversed(changes):
            kept.replace(start, end, new)
        single = (kept.touched - before) / 5000
        again = tc.CountedText(text, COUNTS)
        before = again.touched
        again.apply(changes)
        assert single < most and (again.touched - before) / 5000 < most / 2
        assert again.text() == kept.text() and again.n_tokens == kept.n_tokens == plain(kept.text())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab '12 \n\t.!lré", max_size=300), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), st.text(alphabet="a '1 \n.lé", max_size=5)), max_size=30))
def test_batches_as_full_count(text, steps):
    changes, at = [], 0
    for gap, n, new in steps:
        start = min(at + gap, len(text))
        at = min(start + n, len(text))
        changes.append((start, at, new))
    after, at = "", 0
    for a, b, new in changes:
        after += text[at:a] + new
        at = b
    after += text[at:]
    kept = tc.CountedText(text, COUNTS)
    kept.apply(changes)
    assert kept.text() == after and len(kept) == len(after) and kept.n_tokens == plain(after)
    assert kept.root.tokens == sum(leaf.tokens for leaf in kept._under(kept.root))


def test_rows(spark):
    rows = [(1, "call 12345 or 99 now%%% ok"), (1, "call 12345 or 99 now%%% ok"), (2, None), (3, ""), (None, "x1"), (4, "a1b22 " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS id")
    got = sorted([(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in tc.count_edits(df).collect()], key=repr)
    want = []
    for i, t in rows:
        t = t or ""
        edits = tc.cleaning_edits(t)
        after, at = "", 0
        for a, b, new in edits:
            after += t[at:a] + new
            at = b
        want.append((i, plain(t), len(edits), plain(after + t[at:])))
    assert got == sorted(want, key=repr)
    assert tc.count_edits(df.limit(0)).count() == 0


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in tc.count_edits(df).collect()}
    for r in df.collect():
        assert got[r.doc_id] == (plain(r.text), plain(tc._CLEANED.sub(lambda m: "0" if m[0][0].isdigit() else "", r.text)))
