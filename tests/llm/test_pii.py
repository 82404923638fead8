from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import pii


def brute(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base kinds by plain left-to-right search."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in tests.items()}


PIECES = ["a", "b.", "@", "x@y.z", "1", "255", "256", ".", "..", "-", " ", "+", "+1 (5", "4111 1111 1111 1111", "4278905660903979", "1.2.3.4", "é", "\n", "(", ")", "_", "%", "password=ab12cd", "http://u:p@h.com/", "00012345678"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_kinds_as_plain_search(text):
    found = pii.spans_of(text)
    assert {k: found[k] for k in pii.BASE} == brute(text)


def test_added_kinds():
    text = "see ftp://me:pw1@files.example.org:21/x and IBAN DE89370400440532013000, password=8b046b689af7611715 reauxoi"
    found = pii.spans_of(text)
    assert [text[a:b] for a, b in found["address"]] == ["me:pw1@files.example.org:21"]
    assert [text[a:b] for a, b in found["account"]] == ["DE89370400440532013000", "8b046b689af7611715"]
    assert pii.spans_of("a token of love, the account was closed")["account"] == []


def test_long_values_and_ibans_without_cue():
    key = "eyJ0eXAi." * 22 + "x9-_z"
    assert pii.masked(f"token: {key} end") == "token: <ACCOUNT> end"
    assert pii.masked('api_key="' + "a1" * 2000 + '"') == 'api_key="<ACCOUNT>"'
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"):
        for text in ("pay to {} by May", "pay to {} AND THEN 12 MORE", "{}", "({}).", "IBAN {} now", "account: {}, or"):
            assert pii.masked(text.format(iban)) == text.format("<ACCOUNT>")
    for text in ("DE89370400440532013001", "XDE89370400440532013000", "DE893704004405320130001", "AB12 and A1, Z9"):
        assert pii.spans_of(text)["account"] == []


def test_rows(spark):
    rows = [(1, "x@y.zz"), (1, "x@y.zz"), (None, "1.2.3.4"), (2, None), (3, ""), (4, "w " * 200_000 + "4111111111111111")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'spans' AS spans", "1 AS n_email")
    got = pii.detect(df).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in got}
    assert by == {(1, 1, 0, 0, 0, "email:0:6"), (None, 0, 1, 0, 0, "ip:0:7"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (4, 0, 0, 1, 0, "card:400000:400016")}
    assert {r.base_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"").hexdigest()}
    assert pii.detect(df.limit(0)).count() == 0


def test_redact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "mail x@y.zz now", "en", 15, "k"), (2, None, "en", None, "k"), (3, "clean", "de", 99, "k")], "doc_id long, text string, lang string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail <EMAIL> now" and got[1].n_chars == len("mail <EMAIL> now")
    assert got[2].text is None and got[2].n_chars is None
    assert got[3].text == "clean" and got[3].n_chars == 99 and pii.redact(df).columns == df.columns
