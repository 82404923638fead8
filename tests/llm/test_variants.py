from __future__ import annotations

import itertools
import random
import re
import sys
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import queries, variants


def plain_words(rows) -> Counter:
    """(id, text) to word counts, one run at a time."""
    out: Counter = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return Counter({w: n for w, n in out.items() if n >= 2})


def plain_pairs(words) -> set[tuple[str, str]]:
    """Near words by the words that one or two of them become without a letter."""
    gaps: dict[tuple[int, str], list[str]] = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    out = {tuple(sorted(p)) for own in gaps.values() for p in itertools.combinations(own, 2)}
    return out | {tuple(sorted((w, short))) for (_, short), own in gaps.items() if short in words for w in own}


def plain_table(words: Counter) -> set[tuple]:
    near: dict[str, set[str]] = {w: set() for w in words}
    for a, b in plain_pairs(words):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), form[w] and words[form[w]]))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def got(df) -> set[tuple]:
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_table_by_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        want = plain_table(plain_words((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
        assert got(queries.queries()["op11_spelling_variants"](spark, f"/root/testdata/{sf}")) == want
        assert sum(r[1] is not None for r in want) >= 5


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=3, max_size=9), min_size=2, max_size=25), st.integers(0, 3))
def test_each_pair_once(words, cuts):
    """In one shard, with keys cut any number of times: every near pair is told once."""
    shard = variants.Shard()
    states = [(0, 0, 0, 0)]
    for w in words:
        states = [(0, 0, 0, 0)]
        for _ in range(cuts + 1):
            after = []
            for p, s, side, seg in states:
                left = len(w) - p - s
                if left <= 2 and p + s:
                    after.append((p, s, side, seg))
                else:
                    after += [(p + left // 2, s, 0, left // 2), (p, s + left - left // 2, 1, left - left // 2)]
            states = after
        for p, s, side, seg in states:
            shard.hold(w, 1, len(w), p, s, side, seg)
    pairs = [tuple(sorted((w, other))) for w in words for other, _ in shard.near(w)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(words)


def test_common_beginnings_and_ends(spark):
    """Groups that share a beginning or an end, cut down to few rows of a key; chains of
    forms; very long words."""
    rng = random.Random(5)
    words: Counter = Counter()
    for stem, n in (("beginning", 400), ("zzzzzzzzzzzzzzzz", 200), ("ab", 200)):
        for _ in range(n):
            tail = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 8)))
            words[stem + tail] = words[tail + stem] = rng.choice([2, 3, 25, 300, 4000])
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000))
    words |= Counter({long: 500, long[:1_234] + long[1_235:]: 20, long[:2_900] + "x" + long[2_901:]: 2})
    words |= Counter({"chained": 2, "chainedd": 20, "chaineddd": 200, "chainedddd": 2000})
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    for hot_rows, chars in ((4, 3000), (64, 1 << 20)):
        out = variants.variants(df, variants.near_pairs(df, hot_rows=hot_rows, shard_chars=chars))
        assert got(out) == plain_table(words)


def test_keys_stay_small(spark):
    rows = [("common" + "".join(x), 2) for x in itertools.product("abcdefgh", repeat=4)]
    df = spark.createDataFrame(rows, "word string, n long")
    sizes = variants.keyed(df, hot_rows=50).where("la - p - s > 2").groupBy("key").count()
    assert sizes.agg({"count": "max"}).first()[0] in (None, *range(51))


def test_a_row_says_held_and_asked(spark):
    """Keys of a word's own length are held and asked for by one row: a word sends four
    rows at first, and counts twice for how many rows its own keys have."""
    rows = [("".join(x), 2) for x in itertools.product("abcd", "efgh", "ijkl", "mnop")]
    df = spark.createDataFrame([(w[0] * 5 + w + w[::-1], n) for w, n in rows], "word string, n long")
    assert variants.keyed(df, hot_rows=10_000).count() == 4 * df.count()
    one = spark.createDataFrame([("a" * 20 + x * 20, 2) for x in "bcde"], "word string, n long")
    first = "p = 20 AND s = 0"  # of length 40 (8 rows: 4 hold, 4 ask)
    assert variants.keyed(one, hot_rows=8).where(f"{first} AND la = 40").count() == 4
    assert variants.keyed(one, hot_rows=7).where(f"{first} AND la = 40").count() == 0


def test_scan_looks_at_fitting_lengths_only():
    """What one hit costs does not grow with the words of other lengths that hold its
    segment, nor with its other places."""

    def lines(lengths: range) -> int:
        shard = variants.Shard()
        for la in lengths:
            shard.hold("abc" + "x" * (la - 3), 1, la, 3, 0, 0, 3)
            shard.hold("x" * (la - 3) + "abc", 1, la, 0, 3, 1, 3)
        list(shard.near("abc" + "y" * 17))  # makes the automaton
        seen = 0

        def trace(frame, event, arg):
            nonlocal seen
            seen += event == "line"
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            list(shard.near("abc" + "x" * 16 + "y"))
        finally:
            sys.settrace(before)
        return seen

    assert lines(range(10, 400)) == lines(range(19, 21)) > 0


def test_odd_rows(spark):
    rows = [(1, "Straße straße STRASSE naïveté NAÏVETÉ"), (1, "Straße straße STRASSE naïveté NAÏVETÉ"), (None, "naïveté naïvetés x"), (2, None), (3, ""), (4, "naïvetés " * 50_000 + "q" * 2_000_000 + " " + "q" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS id", "3 AS key", "4 AS shard")
    very_long = "q" * 2_000_000
    want = plain_words([r for r in rows if r[0] != 4] + [(4, rows[-1][1].replace(very_long, ""))])
    assert got(variants.group_variants(df)) == plain_table(want) | {(very_long, None, very_long, 2, 0, None)}
    assert variants.group_variants(df.limit(0)).collect() == []
