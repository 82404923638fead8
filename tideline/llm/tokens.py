"""Token ids of whole texts by a public tokenizer, each word looked up once.

White space separates what the tokenizer treats apart (its splitting pattern never
spans it, and neither normal form nor lower-casing looks across it), so the ids of
a text are those of its words in a row. A task keeps the ids of words it has
met in a table of bounded size.
"""

from __future__ import annotations

import struct

from .common import task_table

#: Words of a generation of which a task keeps the ids (two generations are kept).
KEPT_WORDS = 300_000
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """Looks up what was met lately: when a generation is full it becomes the old one,
    and what is asked for again moves on to the new."""

    def __init__(self, make, most: int = KEPT_WORDS) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """How byte-level BPE spells bytes: printable ones as themselves, the others as the
    letters from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids (little-endian unsigned 32-bit) of a UTF-8 word, and of texts."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._spelled = byte_letters()
        self._parts = Recent(self._part)
        self._words = Recent(self._word)
        #: How this tokenizer cuts text into words, as its file states it (a fixed value).
        self._cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def _part(self, part: str) -> bytes:
        """Ids of what the pattern cuts out of a lower-case word: its merges alone."""
        spelled = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self._spelled)
        return pack_ids([t.id for t in self._merge(spelled)])

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text or not (text.isascii() or max(text) < "ɐ"):
            # special tokens, and letters of which forms and cases depend on more
            return pack_ids(self._encode(text, add_special_tokens=False).ids)
        low = text.lower()
        if low.isalpha():  # the pattern takes letters whole, and a sign after them
            return self._parts[low]
        if low[-1] in ",.;:!?" and low[:-1].isalpha():
            return self._parts[low[:-1]] + self._parts[low[-1]]
        return b"".join(map(self._parts.__getitem__, self._cut(low)))

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text, four bytes each."""
        return b"".join(map(self._words.__getitem__, text.split()))


@task_table
def word_ids(path: str) -> WordIds:
    return WordIds(path)
