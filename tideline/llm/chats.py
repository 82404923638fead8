"""Chat formatting (operator 13): a finite-state machine over roles.

A :class:`Template` declares how the turns of each role are marked, which role may follow
which, in which a conversation may end, and whose text is learned from (the loss mask).
Control strings inside texts are escaped reversibly, so an output can be read back.

1. Turns are dealt by ranges of (conversation, turn), so each task has a row of turns in
   order, and a conversation that holds a third of all turns lies in many tasks.
2. A task runs the machine over its turns and emits blocks: text, spans under the loss
   mask, and what the machine does from every state in which the block may be entered (the
   state after it, and the first turn out of order). A conversation that lies in a task
   alone is one block of up to ``BLOCK_CHARS`` and is done.
3. The blocks of the other conversations (at most the first and the last of each task, and
   long ones) are put in a row by their first turns; the machine goes on from block to
   block by their tables.

:func:`read_back` parses outputs into turns and learned text again. Turns out of order are
formatted like others; the first of them is named.

Defined cases: null text is the empty text; a null role is the empty role; roles that the
template doesn't name are written with their name and are never in order; rows without a
conversation's id are one conversation; turns come in order of turn (null first), ties by
role and then by a hash of the text, and repeated rows are turns of their own; an empty
table gives no rows; texts of any length are written whole; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, utf8

#: Characters of a block beyond which a conversation goes on in another.
BLOCK_CHARS = 1 << 20
BEGIN = ""


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a turn, and whether it is learned from."""

    before: str
    after: str
    learned: bool = False


@dataclass(frozen=True)
class Template:
    turns: dict[str, Marks]
    #: Before the name of a role that isn't named above, before its text, after its text.
    others: tuple[str, str, str]
    #: Roles that may come after a role; ``BEGIN`` stands for the begin.
    follows: dict[str, tuple[str, ...]]
    #: Roles with which a conversation may end.
    ends: tuple[str, ...]

    @cached_property
    def controls(self) -> list[str]:
        """The control strings: all marks without white space around."""
        marks = [m for t in self.turns.values() for m in (t.before, t.after)] + list(self.others)
        found = sorted({m.strip() for m in marks}, key=lambda c: (-len(c), c))
        first = {c[0] for c in found}
        if any(len(c) < 2 or first & set(c[1:]) or "\\" in c for c in found):
            raise ValueError("a control string has its own first sign, which no other one holds further on")
        return found

    @cached_property
    def pattern(self) -> str:
        """Control strings, escaped any number of times."""
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rest = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{first}])(\\*)({rest})"

    @cached_property
    def _found(self) -> re.Pattern:
        return re.compile(self.pattern)

    def escape(self, text: str) -> str:
        """``text`` with one backslash more in every control string."""
        return self._found.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self._found.sub(lambda m: m[1] + m[2][1:] + m[3], text)

    def written(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before the text of a turn, the text escaped, and what follows."""
        own = self.turns.get(role)
        if own:
            return own.before, self.escape(text), own.after
        before, between, after = self.others
        return before + self.escape(role) + between, self.escape(text), after

    def step(self, state: str, role: str) -> bool:
        """Whether ``role`` may come in this state; the state after it is the role."""
        return role in self.follows.get(state, ())

    def parse(self, text: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of an output."""
        at, before, between, after = 0, *self.others
        while at < len(text):
            role = next((r for r, m in self.turns.items() if text.startswith(m.before, at)), None)
            if role is not None:
                at += len(self.turns[role].before)
                close = self.turns[role].after
            elif text.startswith(before, at):
                at += len(before)
                to = text.index(between, at)
                role, at, close = self.unescape(text[at:to]), to + len(between), after
            else:
                raise ValueError(f"no turn begins at {at}")
            to = text.index(close, at)
            yield role, self.unescape(text[at:to])
            at = to + len(close)


INSTRUCT = Template(
    turns={"system": Marks("[SYS] ", " [/SYS]"), "user": Marks("[INST] ", " [/INST]"), "assistant": Marks("<s>", "</s>", learned=True)},
    others=("[ROLE] ", " [SAYS] ", " [/ROLE]"),
    follows={BEGIN: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


class Block:
    """Turns in a row of one conversation: text, learned spans, and the machine's table."""

    def __init__(self, template: Template) -> None:
        self.template, self.parts, self.chars, self.n = template, [], 0, 0
        self.spans: list[tuple[int, int]] = []
        self.first = self.last = ""
        self.wrong = -1  # the first turn that is out of order after another one of this block

    def add(self, role: str, text: str) -> None:
        if not self.n:
            self.first = role
        elif self.wrong < 0 and not self.template.step(self.last, role):
            self.wrong = self.n
        before, body, after = self.template.written(role, text)
        own = self.template.turns.get(role)
        if own and own.learned:
            self.spans.append((self.chars + len(before), self.chars + len(before) + len(body)))
        self.parts += (before, body, after)
        self.chars += len(before) + len(body) + len(after)
        self.last = role
        self.n += 1


def entered(template: Template, state: str, first: str, wrong: int) -> int:
    """The first turn out of order in a block that is entered in ``state``, or -1."""
    return wrong if template.step(state, first) else 0


#: A block: its place (the first turn's), turns, text and spans in code points; ``first``
#: and ``last`` role and ``wrong`` (see Block) are the machine's table; ``whole`` says
#: that it is the whole conversation.
BLOCK = "turn long, role string, text_hash long, lane long, n_turns long, text string, learned array<struct<start:long,end:long>>, first string, last string, wrong long, whole boolean"


def blocks(turns: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(conv, and the columns of ``BLOCK``): the formatted conversations in blocks."""
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.xxhash64(f"`{text_col}`").alias("text_hash"), F.monotonically_increasing_id().alias("lane"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    conv = rows.schema["conv"].dataType
    order = ["conv", "turn", "role", "text_hash", "lane"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        held = now = place = None
        is_first, split = True, False  # of the task's conversations, and of its blocks
        out: list[tuple] = []
        size = 0

        def done(whole: bool) -> None:
            nonlocal size
            out.append((held, *place, now.n, "".join(now.parts), [{"start": a, "end": b} for a, b in now.spans], now.first, now.last, now.wrong, whole))
            size += now.chars

        def sent() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv", *[x.split()[0] for x in BLOCK.split(", ")]])
            out.clear()
            size = 0
            return batch

        for b in batches:
            if not kinds:
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string(), pa.string(), pa.int64(), pa.bool_()]
            for name, turn, role, h, lane, text in zip(*[b.column(c).to_pylist() for c in [*order, "text"]], strict=True):
                if now is None or name != held:
                    if now is not None:
                        done(not is_first and not split)
                        is_first = split = False
                    held, now, place = name, Block(template), (turn, role, h, lane)
                elif now.chars >= block_chars:
                    done(False)
                    split, now, place = True, Block(template), (turn, role, h, lane)
                now.add(role, text)
                if size >= block_chars:
                    yield sent()
        if now is not None:
            done(False)  # the last of a task may go on in the next
            yield sent()

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"conv {conv.simpleString()}, {BLOCK}")


# -- reading back ---------------------------------------------------------------------------


class Reader:
    """A conversation read back block by block; nothing is kept but sums and states."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.wrong = template, BEGIN, -1
        self.n = self.chars = self.learned = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, text: str, spans: list[dict], first: str, last: str, wrong: int, n: int) -> None:
        if self.wrong < 0 and (at := entered(self.template, self.state, first, wrong)) >= 0:
            self.wrong = self.n + at
        self.state = last
        found = 0
        for role, own in self.template.parse(text):
            self.turns.update(f"{role}\n{own}\n".encode())
            found += 1
        if found != n:
            raise ValueError(f"{found} turns read back of {n}")
        for span in spans:
            own = self.template.unescape(text[span["start"] : span["end"]])
            self.learned += len(own)
            self.loss.update(own.encode())
        self.n += n
        self.chars += len(text)

    def problem(self) -> str | None:
        if self.wrong >= 0:
            return f"turn {self.wrong} is out of order"
        return None if self.state in self.template.ends else "ends too early"

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.problem()


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, problem string"


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv, and the columns of ``READ``) for each conversation, from its blocks; what is
    wrong with its turns stands in ``problem``. Whole conversations are read where they
    are, the blocks of others in a row: hashes take the text in order, block by block."""
    kind = formatted.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = reader = None
        columns = ["conv", "text", "learned", "first", "last", "wrong", "n_turns", "whole"]
        conv_kind = None
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def sent(out: list[tuple]) -> pa.RecordBatch:
            names, *rest = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(names, conv_kind), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=["conv", *[x.split()[0] for x in READ.split(", ")]])

        for b in batches:
            conv_kind = b.schema.field("conv").type
            out = []
            for name, text, *rest, whole in zip(*[b.column(c).to_pylist() for c in columns], strict=True):
                if reader is None or name != held or whole:
                    if reader is not None:
                        out.append((held, *reader.row()))
                    held, reader = name, Reader(template)
                reader.read(text, *rest)
            if out:
                yield sent(out)
        if reader is not None:
            yield sent([(held, *reader.row())])

    schema = f"conv {kind.simpleString()}, {READ}"
    done = formatted.where("whole").mapInArrow(run, schema)
    parts = formatted.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "turn", "role", "text_hash", "lane")
    return done.unionByName(parts.mapInArrow(run, schema))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(materialise(blocks(turns.unionByName(more)))).withColumnRenamed("conv", "conv_id")


def oracle(template: Template = INSTRUCT) -> str:
    """DuckDB SQL for the query: lengths of marks, escapes counted, order by the turn before."""
    pattern = template.pattern.replace("'", "''")
    marks = " ".join(f"WHEN '{r}' THEN {len(m.before) + len(m.after)}" for r, m in template.turns.items())
    size = f"length(text) + len(regexp_extract_all(text, '{pattern}')) + CASE role {marks} ELSE {sum(map(len, template.others))} + length(role) + len(regexp_extract_all(role, '{pattern}')) END"
    legal = " OR ".join(f"(before = '{a}' AND role = '{b}')" for a, own in template.follows.items() for b in own)
    learned = ", ".join(f"'{r}'" for r, m in template.turns.items() if m.learned)
    ends = ", ".join(f"'{r}'" for r in template.ends)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS whole, coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({learned})), '') AS loss,
             CAST(sum({size}) AS BIGINT) AS formatted_chars, min(i) FILTER (NOT ({legal})) AS wrong, arg_max(role, i) AS last FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       CASE WHEN wrong IS NOT NULL THEN 'turn ' || wrong || ' is out of order' WHEN last NOT IN ({ends}) THEN 'ends too early' END AS problem FROM g"""
