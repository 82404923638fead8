"""PII (operator 7): anchors found by Aho-Corasick, expanded by local parsers.

One pass of an Aho-Corasick automaton over a text finds every at-sign, every
plus sign, every digit, every scheme and every identifier cue. At each anchor a
small deterministic parser looks only at the text around it, finds where the
email, address or account begins and ends, and validates it. The base kinds
(email, ip, card, phone) come out as a left-to-right search for their fixed
patterns would give them; beside those the method reports

* ``address`` -- the host of a URL that carries credentials or is a literal IPv6
  address, up to the path (``scheme://user:secret@host``);
* ``account`` -- IBANs that pass mod 97 (with or without a cue), and the value after
  a cue such as ``password=`` or ``account no:``, whatever its length.

A Python worker holds one bounded slice of a batch; each text is judged whole and
alone, so there is no shuffle and no key to be skewed.

Defined cases: a null text counts as empty and has no spans; null, repeated or
missing ids are passed through, one row out for each row in; an empty table gives
no rows; other columns are ignored by the query and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")

#: Words after which an identifier follows.
CUES = ("password", "passwd", "pwd", "secret", "api_key", "apikey", "api-key", "token", "account", "acct", "iban", "ssn", "passport", "license no", "customer id")
SCHEMES = ("://",)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_AUTHORITY = re.compile(r"(?:[^\s/?#@\"'<>]+@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9.-]+)(?::[0-9]+)?")
_AFTER_CUE = re.compile(r"(?: ?(?:no|number|nr|id)\.?)? ?[:=#] ?\"?([A-Za-z0-9][A-Za-z0-9_+/.-]{5,})")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Length of the IBANs of each country; others are taken as long as they pass.
IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}


@cache
def automaton():
    """Anchors of all kinds; the value is (what it is, its length)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for d in "0123456789":
        a.add_word(d, ("0", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, at: int) -> int | None:
    """Where the IBAN that begins at ``at`` ends, if one does: what follows it may
    look like more of it, so every end of a word is tried, the longest first."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    length = IBAN_LENGTHS.get(m[0][:2])
    for end in range(m.end(), at + 14, -1):
        if text[end - 1] != " " and not text[end : end + 1].isalnum():
            n = end - at - text.count(" ", at, end)
            if (length is None or n == length) and iban_valid(text[at:end]):
                return end
    return None


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind, each list in order of start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    digit_run = 0  # end of the run of digits already seen
    for end, (what, length) in automaton().iter(text):
        at = end - length + 1
        if what == "0":
            if "A" <= text[at - 1 : at] <= "Z" and at - 2 >= done["account"] and not text[max(0, at - 3) : at - 2].isalnum() and (to := iban_end(text, at - 2)):
                done["account"] = to
                found["account"].append((at - 2, to))
            if at >= done["card"] and (m := _CARD.match(text, at)):
                done["card"] = m.end()
                digits = re.sub(r"[ -]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if at >= done["ip"] and at >= digit_run:
                digit_run = _DIGITS.match(text, at).end()
                if text[digit_run : digit_run + 1] == "." and (m := _IP.match(text, at)):
                    done["ip"] = digit_run = m.end()
                    if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                        found["ip"].append(m.span())
        elif what == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            m = _AUTHORITY.match(text, end + 1)
            if m and at >= done["address"] and ("@" in m[0] or "[" in m[0]):
                done["address"] = m.end()
                found["address"].append(m.span())
        elif end + 1 >= done["account"]:
            if (m := _AFTER_CUE.match(text, end + 1)) and any(c.isdigit() for c in m[1]):
                value = m[1].rstrip(".-_/+")
                done["account"] = m.start(1) + len(value)
                found["account"].append((m.start(1), done["account"]))
            elif (m := re.compile(r"[ :=]{0,3}").match(text, end + 1)) and (to := iban_end(text, m.end())):
                done["account"] = to
                found["account"].append((m.end(), to))
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_<kind> of the base kinds, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [spans_of(t) for t in texts(b.column("text"))]
            base = [listed(f, BASE) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    *[pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE],
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
                    pa.array([listed(f, KINDS) for f in found], pa.string()),
                ],
                names=["id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"],
            )

    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of spans
    that overlap, the one that starts first (then the longest) stands."""
    spans = sorted((a, -b, k) for k, s in spans_of(text).items() for a, b in s)
    if not spans:
        return text
    parts, at = [], 0
    for a, b, k in spans:
        if a >= at:
            parts += [text[at:a], f"<{k.upper()}>"]
            at = -b
        else:  # a later, overlapping span: what sticks out is hidden as well
            at = max(at, -b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked in ``text_col`` and ``length_col`` (where
    there is one) set to the new length; all else as it is. Null stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            at = b.schema.get_field_index(text_col)
            before = b.column(at).to_pylist()
            after = [None if t is None else masked(t) for t in before]
            arrays = list(b.columns)
            arrays[at] = pa.array(after, b.schema.field(at).type)
            if length_col in b.schema.names:
                n = b.schema.get_field_index(length_col)
                changed = pa.array([x != y for x, y in zip(before, after, strict=True)], pa.bool_())
                arrays[n] = pc.if_else(changed, pa.array([len(x or "") for x in after]).cast(arrays[n].type), arrays[n])
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(run, schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
