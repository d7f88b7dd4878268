"""Personal data: anchors found by Aho-Corasick, spans grown from them by small parsers."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodplain.llm.shared import slices, texts_of

LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DIGITS = frozenset("0123456789")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
BREAKS = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")

#: The kinds whose spans a fixed rule decides, in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
#: What anchors add: addresses of pages, bank accounts and numbers that a cue announces.
ADDED = ("url", "iban", "account")
KINDS = BASE + ADDED

SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "mailto:")
CUES = ("account number", "account no", "account:", "acct", "passport", "ssn", "social security", "customer id", "tax id", "kontonummer", "numéro de compte", "número de cuenta")


@functools.cache
def automaton():
    """Anchors with what they announce. Cues and schemes are found in lowered letters."""
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": ["email"]}
    for digit in sorted(DIGITS):
        anchors[f".{digit}"] = ["ip"]
        anchors[f"+{digit}"] = ["phone"]
        for gap in ("", " ", "-"):
            for other in sorted(DIGITS):
                anchors.setdefault(f"{digit}{gap}{other}", []).append("card")
    for scheme in SCHEMES:
        anchors[scheme] = ["url"]
    for cue in CUES:
        anchors[cue] = ["account"]
    anchors["iban"] = ["iban"]
    for anchor, kinds in anchors.items():
        found.add_word(anchor, (len(anchor), kinds[0]))
    found.make_automaton()
    return found


def run_right(text: str, at: int, allowed: frozenset) -> int:
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def run_left(text: str, at: int, allowed: frozenset, stop: int) -> int:
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def email_at(text: str, at: int, stop: int) -> tuple[int, int] | None:
    """An address around the at-sign at ``at``: a local part no further left than ``stop``, labels joined by dots."""
    begin = run_left(text, at, LOCAL, stop)
    end = run_right(text, at + 1, LABEL)
    if begin == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        longer = run_right(text, end + 1, LABEL)
        if longer == end + 1:
            break
        end, dots = longer, dots + 1
    return (begin, end) if dots else None


def ip_at(text: str, dot: int, stop: int) -> tuple[int, int] | None:
    """Four runs of digits of which the first ends before the dot at ``dot``."""
    begin = run_left(text, dot, DIGITS, stop)
    if begin == dot:
        return None
    end = dot
    for _ in range(3):
        if end >= len(text) or text[end] != ".":
            return None
        longer = run_right(text, end + 1, DIGITS)
        if longer == end + 1:
            return None
        end = longer
    return begin, end


def card_at(text: str, at: int) -> tuple[int, int]:
    """Digits from ``at`` on, single spaces or hyphens between them."""
    end = run_right(text, at, DIGITS)
    while end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
        end = run_right(text, end + 1, DIGITS)
    return at, end


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """A plus sign, a digit, then phone signs up to the last digit among them, not the first."""
    end = run_right(text, plus + 2, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """The first country code, check digits and groups within a few signs after a cue, if their remainder is 1."""
    for begin in range(at, min(at + 12, len(text))):
        if text[begin : begin + 2].isascii() and text[begin : begin + 2].isalpha() and text[begin + 2 : begin + 4].isascii() and text[begin + 2 : begin + 4].isdigit():
            end, signs = begin, ""
            while end < len(text) and len(signs) < 34 and (text[end] in LETTERS or text[end] in DIGITS or (text[end] == " " and end + 1 < len(text) and text[end + 1] in LETTERS | DIGITS)):
                if text[end] != " ":
                    signs += text[end].upper()
                end += 1
                if len(signs) >= 15 and int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1:
                    return begin, end
            return None
    return None


def account_at(text: str, at: int) -> tuple[int, int] | None:
    """A run of at least five digits, single spaces or hyphens between them, within a few signs after a cue."""
    for begin in range(at, min(at + 12, len(text))):
        if text[begin] in DIGITS:
            begin, end = card_at(text, begin)
            return (begin, end) if len(digits_of(text[begin:end])) >= 5 else None
        if text[begin] == "\n":
            return None
    return None


def url_at(text: str, begin: int, after: int) -> tuple[int, int] | None:
    """From a scheme to white space, quotes or brackets, closing punctuation left out."""
    end = after
    while end < len(text) and text[end] not in BREAKS:
        end += 1
    while end > after and text[end - 1] in ".,;:!?)]":
        end -= 1
    return (begin, end) if end > after else None


def lowered(text: str) -> str:
    """Letters lowered one for one, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def spans_of(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, the end exclusive.

    Each kind is searched from the left and without overlap, as if alone. An
    anchor inside what its kind has already consumed is passed over; a match
    whose digits fail their check is consumed and dropped.
    """
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    used = dict.fromkeys(KINDS, 0)
    for last, (size, kind) in automaton().iter(lowered(text)):
        at, stop = last + 1 - size, used[kind]
        if kind == "email":
            found = email_at(text, at, stop) if at >= stop else None
        elif kind == "ip":
            found = ip_at(text, at, stop) if at > stop else None
        elif kind == "card":
            found = card_at(text, at) if at >= stop else None
        elif kind == "phone":
            found = phone_at(text, at) if at >= stop else None
        elif kind == "url":
            found = url_at(text, at, last + 1) if at >= stop else None
        elif kind == "iban":
            found = iban_at(text, last + 1) if at >= stop else None
        else:
            found = account_at(text, last + 1) if at >= stop else None
        if found is None:
            continue
        used[kind] = found[1]
        match = text[found[0] : found[1]]
        if kind == "ip":
            good = all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
        elif kind == "card":
            number = digits_of(match)
            good = 16 <= len(number) <= 19 and luhn(number)
        elif kind == "phone":
            good = 8 <= len(digits_of(match)) <= 15
        else:
            good = True
        if good:
            spans[kind].append(found)
    return spans


SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("begin", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])


def span_rows(spans: dict[str, list[tuple[int, int]]]) -> list[dict]:
    return [{"kind": kind, "begin": begin, "end": end} for kind in KINDS for begin, end in spans[kind]]


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of whole texts, one row per row; see ``spans_of``.

    ``spans`` lists (kind, begin, end), kinds in the order of ``KINDS``, places
    ascending. Null and empty texts have none; repeated rows repeat; other columns
    are not read. Nothing is shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(SPAN, False))])
    spans_type = to_arrow_schema(schema).field("spans").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            made = [span_rows(spans_of(text)) for text in texts_of(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(made, spans_type)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """Replace spans by ``[KIND]``; of overlapping ones the union, under the kind that begins first and reaches furthest."""
    found = sorted(((begin, -end, kind) for kind in KINDS for begin, end in spans[kind]), key=lambda s: s[:2])
    parts, at, k = [], 0, 0
    while k < len(found):
        begin, end, kind = found[k][0], -found[k][1], found[k][2]
        while k + 1 < len(found) and found[k + 1][0] < end:
            k += 1
            end = max(end, -found[k][1])
        parts += [text[at:begin], f"[{kind.upper()}]"]
        at, k = end, k + 1
    return "".join([*parts, text[at:]])


def redact_personal(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with personal data in whole texts replaced, and the length column brought in line.

    A null text stays null, and so does its length as it was.
    """
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            old = batch.column(text_col).to_pylist()
            new = [None if text is None else redact(text, spans_of(text)) for text in old]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.coalesce(F.length(text_col), F.col(length_col)).cast(schema[length_col].dataType))
    return out


def joined(spans: str, kinds: tuple[str, ...]):
    """The spans of ``kinds`` as ``kind:begin:end``, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: str, kind: str):
    """How many spans are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
