"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (fixed patterns): email, ip, card (Luhn), phone. Added kinds: iban (mod-97) and id, a
number of the form 123-45-6789 that needs a word of context to be accepted.
Every scan is linear in the text, whatever its runs of digits, dots or letters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import slices
from siltline.session import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "id")
#: Words that make a span of a kind likelier, within CONTEXT characters before it.
HINTS = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "id": ("ssn", "social security", "national id", "passport", "tax id"),
}
CONTEXT, HINT_SCORE, ACCEPT = 40, 0.2, 0.5
#: Score of a span before its context, once its validator has passed.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "id": 0.35}

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, remainder 1."""
    left = 0
    for c in iban[4:] + iban[:4]:
        left = (left * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return left == 1


def emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCALS:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def addresses(text: str):
    """Four runs of digits joined by single dots, from the left; then each part must be 255 at most."""
    held: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        if held and not (a == held[-1][1] + 1 and text[a - 1] == "."):
            held = []
        held.append((a, b))
        if len(held) == 4:
            if all(int(text[x:y].lstrip("0")[:4] or 0) <= 255 for x, y in held):
                yield held[0][0], b
            held = []


def cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str):
    for m in _IBAN.finditer(text):
        whole = m[0].replace(" ", "")
        # blanks may lead into the next word: the longest passing prefix of the groups counts
        end = m.end()
        while len(whole) >= 15:
            if mod97(whole):
                yield m.start(), end
                break
            tail = m[0][: end - m.start()].rfind(" ")
            if tail < 0:
                break
            end = m.start() + tail
            whole = m[0][:tail].replace(" ", "")


def ids(text: str):
    for m in _ID.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "id": ids}


def scored(text: str, kind: str, start: int, end: int) -> Span:
    before = text[max(0, start - CONTEXT) : start].lower()
    near = any(re.search(rf"\b{h}", before) for h in HINTS[kind])
    return Span(kind, start, end, min(1.0, SCORES[kind] + HINT_SCORE * near))


def find(text: str) -> list[Span]:
    """Accepted spans by kind, then start. Base spans are valid once their check passes, whatever the context."""
    found = []
    digits = any(c in text for c in "0123456789")
    for kind, finder in FINDERS.items():
        if "@" in text if kind == "email" else digits:
            found += [scored(text, kind, *x) for x in finder(text)]
    return [s for s in found if s.kind in BASE or s.score >= ACCEPT]


def masked(text: str) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for s in sorted(find(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            parts += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone, n_iban, n_id, base, spans, scores), one per row of docs.

    base and spans are kind:start:end lists in code points; scores has the score of each span. Null texts count as empty.
    Ids may be null or repeat; only the two named columns are read; no rows give no rows.
    """

    def run(batches):
        for b in slices(batches, "t"):
            found = [find(x or "") for x in b.column("t").to_pylist()]
            counts = [pa.array([sum(s.kind == k for s in f) for f in found], pa.int64()) for k in KINDS]
            base = pa.array([joined([s for s in f if s.kind in BASE]) for f in found], pa.string())
            scores = pa.array([[s.score for s in f] for f in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *counts, base, pa.array([joined(f) for f in found], pa.string()), scores], ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "scores"])

    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {kinds}, base string, spans string, scores array<double>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with masked texts, all columns kept; null texts stay null."""
    columns = docs.columns

    def run(batches):
        for b in slices(batches, text_col):
            texts = pa.array([None if x is None else masked(x) for x in b.column(text_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if c == text_col else b.column(c) for c in columns], columns)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


