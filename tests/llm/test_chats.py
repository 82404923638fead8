from __future__ import annotations

import hashlib
import random

from compare import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.llm import chats, queries

T = chats.INSTRUCT
PIECES = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "[ROLE] ", " [SAYS] ", "\\", "<", "[", "/", "s>", "a", " ", "<\\s>", "[\\\\INST]", "é"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_escape(text):
    out = T.escape(text)
    assert T.unescape(out) == text and not any(c in out for c in T.controls)
    assert len(out) == len(text) + len(T._found.findall(text))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[INST] x", " [SAYS] "]), TEXT), max_size=8))
def test_parse(turns):
    block = chats.Block(T)
    for role, text in turns:
        block.add(role, text)
    whole = "".join(block.parts)
    assert list(T.parse(whole)) == turns and len(whole) == block.chars
    assert [T.unescape(whole[a:b]) for a, b in block.spans] == [t for r, t in turns if r == "assistant"]


def test_machine():
    """The table of blocks gives what the machine does over the whole conversation."""
    rng = random.Random(1)
    for _ in range(500):
        roles = [rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]) for _ in range(rng.randint(1, 9))]
        wrong = next((i for i, r in enumerate(roles) if r not in T.follows.get(roles[i - 1] if i else "", ())), -1)
        reader, at = chats.Reader(T), 0
        while at < len(roles):
            block, to = chats.Block(T), at + rng.randint(1, 4)
            for r in roles[at:to]:
                block.add(r, "x")
            reader.read("".join(block.parts), [], block.first, block.last, block.wrong, block.n)
            at = to
        assert reader.wrong == wrong
        assert reader.problem() == (f"turn {wrong} is out of order" if wrong >= 0 else None if roles[-1] == "assistant" else "ends too early")


def plain(turns: list[tuple[str, str]]) -> tuple:
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)


def test_rows(spark):
    """A conversation with most of the turns, in many tasks and blocks; odd rows."""
    rng = random.Random(7)
    words = ["</s>", "[INST] ", "hello", "é", "\\", " ", "[/SYS]"]
    say = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, ["user", "assistant"][t % 2], say()) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(1000, t, ["user", "assistant"][t % 2], say()) for t in range(3000)]
    rows += [(2000, 0, None, None), (2000, 1, "tool", "x"), (2000, 2, "assistant", None), (2001, 0, "user", ""), (2001, 1, "assistant", "long " * 300_000), (2002, 0, "system", "only")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (2003, 0, "user", "twice"), (2003, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'a' AS conv", "1 AS lane", "2 AS text_hash", "3 AS first", "4 AS whole").repartition(7)
    want: dict = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    for block_chars in (500, chats.BLOCK_CHARS):
        formatted = chats.blocks(df, block_chars=block_chars).cache()
        got = {r.conv: r for r in chats.read_back(formatted).collect()}
        assert got.keys() == want.keys()
        for c, turns in want.items():
            assert tuple(got[c])[1:5] == plain(turns)
        assert got[1000].problem is None and got[2000].problem == "turn 0 is out of order" and got[2002].problem == "ends too early"
        assert got[2003].problem == "turn 1 is out of order"
        assert formatted.where("conv = 1000").count() > 3
        assert formatted.agg(F.sum(F.length("text"))).first()[0] == sum(r.formatted_chars for r in got.values())
        formatted.unpersist()
    assert chats.read_back(chats.blocks(df.limit(0))).count() == 0


def test_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        assert not compare(spark, f"/root/testdata/{sf}", queries.queries()["op13_chat_formatting"], queries.oracle_sql()["op13_chat_formatting"])
