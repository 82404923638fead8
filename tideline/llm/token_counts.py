"""Token counts under edits (operator 10): a segment tree of pre-tokens per document.

A byte-level BPE counts tokens inside pre-tokens, which its pattern cuts off a text
from left to right. :class:`CountedText` keeps the pre-tokens of a text, a few to a leaf,
under a segment tree whose nodes hold characters and tokens, so the count of the whole
is at the root and the leaf at an offset is found in O(log n). An edit re-encodes
from the last cut that no changed character could have moved (the pattern looks at
most one character past a cut) up to the first cut after the edit that old and new
text share. Edits are applied in batches: those whose context meets are one region, and
all regions are put in by one walk that enters only the nodes above them and updates
their sums on its way back. A subtree is built at its middle, so it takes a number of
new leaves in proportion to its size until one side leans too far and it is built
anew: an edit costs O(log n) nodes, amortised. Texts without edits are counted without
a tree.

Each document is counted alone in one Python worker, so nothing is shuffled.

Defined cases: a null text counts as empty (no tokens, no edits); rows come out as
they came in, with null or repeated ids; an empty table gives no rows; other columns
are ignored; a very long text is counted whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts
from .tokens import Recent, tokenizer_path

BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"
#: How this tokenizer cuts text (a fixed value that belongs to its vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PartCounts(Recent):
    """Tokens of a pre-token, kept for those met lately."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(PATTERN).findall
        super().__init__(lambda part: len(self.encode(part)))


@cache
def part_counts(path: str) -> PartCounts:
    return PartCounts(path)


#: Pre-tokens of a leaf as it is built; it is split when it holds twice as many.
LEAF = 8
#: A node of which one child holds more than this share of its leaves is built anew.
LEAN = 0.7


class Node:
    """Characters, tokens and leaves below a node; a leaf holds pre-tokens."""

    __slots__ = ("chars", "tokens", "leaves", "left", "right", "parts")

    def __init__(self, left: Node | None = None, right: Node | None = None, parts: list[str] | None = None, tokens: int = 0) -> None:
        self.left, self.right, self.parts = left, right, parts
        if parts is None:
            self.sum_up()
        else:
            self.chars, self.tokens, self.leaves = sum(map(len, parts)), tokens, 1

    def sum_up(self) -> None:
        a, b = self.left, self.right
        self.chars, self.tokens, self.leaves = a.chars + b.chars, a.tokens + b.tokens, a.leaves + b.leaves


Edit = tuple[int, int, str]
#: A stretch of old text between cuts (start, end), and the pre-tokens that replace it.
Region = tuple[int, int, list[str]]


class CountedText:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, counts: PartCounts) -> None:
        self.counts = counts
        self.encoded = 0  # pre-tokens encoded again by edits
        self.touched = 0  # nodes entered or made
        self.root = self._built(self._leaves(counts.cut(text)))

    def _leaves(self, parts: list[str]) -> list[Node]:
        count, n = self.counts.__getitem__, len(parts)
        lots = max(1, n // LEAF)
        cuts = [n * i // lots for i in range(lots + 1)]
        return [Node(parts=own, tokens=sum(map(count, own))) for own in (parts[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True))]

    def _built(self, nodes: list[Node]) -> Node:
        """A tree over nodes, every one split at its middle."""
        self.touched += 2 * len(nodes) - 1

        def over(lo: int, hi: int) -> Node:
            if hi - lo == 1:
                return nodes[lo]
            middle = (lo + hi) // 2
            return Node(over(lo, middle), over(middle, hi))

        return over(0, len(nodes))

    def __len__(self) -> int:
        return self.root.chars

    @property
    def n_tokens(self) -> int:
        return self.root.tokens

    @staticmethod
    def _under(node: Node) -> Iterator[Node]:
        """The leaves below a node, in order."""
        open_ = [node]
        while open_:
            at = open_.pop()
            if at.parts is None:
                open_ += (at.right, at.left)
            else:
                yield at

    def text(self) -> str:
        return "".join(p for leaf in self._under(self.root) for p in leaf.parts)

    def _slice(self, start: int, end: int) -> tuple[list[str], int]:
        """The pre-tokens that touch characters start..end, and where they begin."""
        found: list[str] = []
        first = None
        open_ = [(self.root, 0)]
        while open_:
            node, begin = open_.pop()
            if begin + node.chars <= start and node.chars or begin > end:
                continue
            self.touched += 1
            if node.parts is None:
                open_ += ((node.right, begin + node.left.chars), (node.left, begin))
                continue
            for p in node.parts:
                if begin + len(p) > start and begin <= end:
                    first = begin if first is None else first
                    found.append(p)
                begin += len(p)
        return found, start if first is None else first

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters start..end (as they are now)."""
        self.apply([(start, end, new)])

    def apply(self, edits: list[Edit]) -> None:
        """Edits in order and without overlap, all in places of the text as it is now."""
        at = 0
        for start, end, _ in edits:
            if not at <= start <= end <= len(self):
                raise IndexError((start, end, len(self)))
            at = end
        regions: list[Region] = []
        i = 0
        while i < len(edits):
            region, i = self._region(edits, i, regions[-1][1] if regions else 0)
            regions.append(region)
        if regions:
            self.root = self._put(self.root, 0, regions, True) or Node(parts=[])

    def _region(self, edits: list[Edit], first: int, least: int) -> tuple[Region, int]:
        """What edit ``first`` and those whose context meets its own change, from the cut
        ``least`` on at the earliest; and the number of the next edit."""
        total, last, reach, gap = len(self), first + 1, 16, 32
        start = edits[first][0]
        while True:
            while last < len(edits) and edits[last][0] <= edits[last - 1][1] + reach + gap:
                last += 1
            # what the pattern can have looked at before the edits, and enough after them
            # to find a cut that old and new text share
            old, base = self._slice(max(least, start - 2), min(total, edits[last - 1][1] + reach))
            to = base + sum(map(len, old))
            if last < len(edits) and edits[last][0] <= to:
                gap *= 2
                while last < len(edits) and edits[last][0] <= to:
                    last += 1
                continue
            whole, pieces, at = "".join(old), [], base
            for a, b, new in edits[first:last]:
                pieces += [whole[at - base : a - base], new]
                at = b
            parts = self.counts.cut("".join([*pieces, whole[at - base :]]))
            end = edits[last - 1][1]
            if to >= total:
                break
            shift, at, cuts = sum(len(new) - (b - a) for a, b, new in edits[first:last]), base, {}
            for n, p in enumerate(parts):
                at += len(p)
                cuts[at - shift] = n + 1
            shared, at = None, base
            for n, p in enumerate(old):
                at += len(p)
                if end <= at <= to - 2 and at in cuts:
                    shared = (cuts[at], at)
                    break
            if shared:
                parts, to = parts[: shared[0]], shared[1]
                break
            reach *= 4
        self.encoded += len(parts)
        return (base, to, parts), last

    def _put(self, node: Node, begin: int, regions: list[Region], is_last: bool) -> Node | None:
        """``node``, which begins at ``begin``, with the regions that touch it put in: what
        a region brings goes to the leaf in which it begins. None if nothing is left."""
        self.touched += 1
        if node.parts is not None:
            own, at, put, gone, n = [], begin, 0, 0, len(regions)
            for p in node.parts:
                while put < n and regions[put][0] <= at:
                    own += regions[put][2] if regions[put][0] >= begin else []
                    put += 1
                while gone < n and regions[gone][1] <= at:
                    gone += 1
                if gone == n or regions[gone][0] > at:
                    own.append(p)
                at += len(p)
            for _, _, new in regions[put:] if is_last else ():
                own += new
            return self._built(self._leaves(own)) if own else None
        cut = begin + node.left.chars
        left = [r for r in regions if r[0] < cut]
        right = [r for r in regions if r[1] > cut or r[0] >= cut]
        a = self._put(node.left, begin, left, False) if left else node.left
        b = self._put(node.right, cut, right, is_last) if right else node.right
        if a is None or b is None:
            return a or b
        node.left, node.right = a, b
        node.sum_up()
        if node.leaves > 4 and max(a.leaves, b.leaves) > LEAN * node.leaves:
            return self._built(list(self._under(node)))
        return node


Edits = Callable[[str], Iterable[Edit]]

_CLEANED = re.compile(r"[0-9]{2,}|[%*$&#]{3}")


def cleaning_edits(text: str) -> list[Edit]:
    """The edits that the query applies: digit runs become one zero, triple junk
    signs go."""
    return [(m.start(), m.end(), "0" if m[0][0].isdigit() else "") for m in _CLEANED.finditer(text)]


def count_edits(docs: DataFrame, edits: Edits = cleaning_edits, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_tokens, n_edits, n_tokens_after, n_encoded_again.

    ``edits`` names, for a text, what to replace, in order and without overlap."""
    path = tokenizer or tokenizer_path(BYTE_TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = part_counts(path)
        for b in slices(batches, "text", 4 << 20):
            out = []
            for text in texts(b.column("text")):
                changes = list(edits(text))
                if not changes:
                    plain = sum(map(counts.__getitem__, counts.cut(text)))
                    out.append((plain, 0, plain, 0))
                    continue
                kept = CountedText(text, counts)
                before = kept.n_tokens
                kept.apply(changes)
                out.append((before, len(changes), kept.n_tokens, kept.encoded))
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array(c, pa.int64()) for c in zip(*out, strict=True)]], names=["id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded_again"])

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_encoded_again long").withColumnRenamed("id", id_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(table(spark, sf_dir, "documents"))
