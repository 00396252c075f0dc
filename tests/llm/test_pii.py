import re

import pytest

from caseflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = [
    None, "", "a@b.c+x@y.z", "é a.b%c@d-e.f.g, 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "4539578763621486 4539 5787 6362 1486 4539578763621487", "x+1 (988) 555-2485. +12 +4 4",
    "😀😀 me@home.org 😀 10.0.0.1", "@@@ a@ @b.c a@b a@b..c a@-.-", "1-2-3 4", "me@x.y " * 700, "9" * 5000, "a" * 20_000 + "@b.cd", "1.2.3.4" * 300, "+49 " + "1" * 30,
]


def test_base_spans(docs):
    found = {r.doc_id: r for r in pii.digest(pii.find(docs(list(enumerate(TEXTS)))) ).collect()}
    for i, text in enumerate(TEXTS):
        want = brute(text or "")
        got = ",".join(s for s in found[i].spans.split(",") if not s.startswith(("iban", "number")))
        assert got == want, text[:50] if text else text
        assert found[i].n_email == want.count("email:") and found[i].n_card == want.count("card:")


def test_account_numbers_need_the_checksum(docs):
    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    rows = {r.doc_id: r.spans for r in pii.find(docs([(1, f"my account {good}."), (2, bad), (3, "DE89370400440532013000")])).collect()}
    spans = lambda i: [(s["kind"], s["start"], s["end"]) for s in rows[i] if s["kind"] == "iban"]
    assert spans(1) == [("iban", 11, 11 + len(good))] and not spans(2) and spans(3) == [("iban", 0, 22)]
    assert [s["score"] for s in rows[1] if s["kind"] == "iban"] == [pytest.approx(1.0)]


def test_odd_tables(docs, odd):
    assert pii.find(docs(odd)).count() == len(odd)
    assert pii.find(docs([])).count() == 0


def test_account_numbers_before_capitals(docs):
    de, no, gb = "DE89370400440532013000", "NO9386011117947", "GB82 WEST 1234 5698 7654 32"
    spaced = "DE89 3704 0044 0532 0130 00"
    texts = [
        (f"IBAN {de} Please pay", [de]), (f"{spaced} Thanks", [spaced]), (f"{de} BIC COBADEFF", [de]), (f"{gb} AND {spaced} OR {no} NOW", [gb, spaced, no]),
        (f"AB12 CDEF GHIJ KLM {spaced} A", [spaced]), (f"AB12 3456 7890 123 {no}", [no]), (f"{de}x {de}1", []), (f"é {no}, {no}", [no, no]),
        (f"{no} " * 300, [no] * 300), ("AB12 " * 3000, []), ("A" * 30_000 + "AB12" * 5000, []),
    ]
    rows = {r.doc_id: r.spans for r in pii.find(docs([(i, t) for i, (t, _) in enumerate(texts)])).collect()}
    for i, (text, want) in enumerate(texts):
        found = [s for s in rows[i] if s["kind"] == "iban"]
        assert [text[s["start"] : s["end"]] for s in found] == want, text[:60]
        assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))


def test_context_decides(docs):
    """A bare number is personal data where a word nearby says so, and nothing where none does."""
    texts = ["My account is 12345678.", "There were 12345678 of them.", "Konto: 123456789012 oder 1234567", "passport " + "x" * 29 + " 12345678", "passport " + "x" * 40 + " 12345678",
             "account +4912345678 and 12345678.5 and a12345678", "subaccount 12345678", "é😀 client 98765432, bank 1234567890123"]
    found = {r.doc_id: r for r in pii.digest(pii.find(docs(list(enumerate(texts))))).collect()}
    spans = lambda i: [s for s in found[i].spans.split(",") if s.startswith("number")]
    assert spans(0) == ["number:14:22"] and found[0].scores == "number:14:80"
    assert spans(1) == [] and spans(2) == ["number:7:19"] and spans(3) == ["number:39:47"] and spans(4) == [] and spans(5) == [] and spans(6) == []
    assert spans(7) == ["number:10:18"]
    beside = {r.doc_id: r.scores for r in pii.digest(pii.find(docs([(1, "write to a@b.cd"), (2, "zzz a@b.cd")]))).collect()}
    assert beside == {1: "email:9:100", 2: "email:4:90"}
