"""Base kinds against the patterns that define them; added kinds, redaction and odd rows by example."""

import random
import re

from floodplain.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_pattern(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(part) <= 255 for part in match.group().split(".")),
                "card": 16 <= len(digits) <= 19 and personal.luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(match.span())
    return out


def test_spans_equal_the_patterns():
    draw = random.Random(3)
    signs = list("0123456789") * 3 + list(" .-+@()a%_Z") + ["é", "\n", "@", ".", "+1 (234) 555-1234", "4091131010158559", "10.0.0.1", "a@b.co", "İ", "http://"]
    for _ in range(20_000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 30)))
        found = personal.spans_of(text)
        assert {kind: found[kind] for kind in personal.BASE} == by_pattern(text), text


def test_added_kinds():
    text = "See https://a.b/c?d=1, or account no: 123-456 78 IBAN DE89 3704 0044 0532 0130 00."
    found = personal.spans_of(text)
    assert [text[b:e] for b, e in found["url"]] == ["https://a.b/c?d=1"]
    assert [text[b:e] for b, e in found["account"]] == ["123-456 78"]
    assert [text[b:e] for b, e in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert not personal.spans_of("IBAN DE88 3704 0044 0532 0130 00")["iban"]
    assert not personal.spans_of("account number: 12 a")["account"]


def test_redaction_covers_overlapping_spans():
    text = "mail a.b@c.de, call +1 (234) 555-1234 or see http://10.0.0.1/x."
    assert personal.redact(text, personal.spans_of(text)) == "mail [EMAIL], call [PHONE] or see [URL]."


def test_odd_rows(odd_documents):
    found = personal.find_personal(odd_documents)
    assert found.count() == 8 and all(r.spans == [] for r in found.collect())
    redacted = personal.redact_personal(odd_documents)
    assert redacted.columns == odd_documents.columns
    assert sorted(map(str, redacted.collect())) == sorted(map(str, odd_documents.collect()))


def test_redacted_length_and_empty_table(documents, no_documents):
    row = personal.redact_personal(documents(["to x@y.zz now"])).first()
    assert (row.text, row.n_chars) == ("to [EMAIL] now", 14)
    assert personal.redact_personal(no_documents).count() == 0 and personal.find_personal(no_documents).count() == 0
