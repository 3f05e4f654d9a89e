"""Personal data: patterns propose, checksums confirm, nearby words weigh."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans are listed.
KINDS = (*BASE, "iban", "ssn", "secret")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])[A-Za-z0-9_]{32,64}(?![A-Za-z0-9_])")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^\W\d_]+")

#: Words near a span that make its kind more likely.
CONTEXT = {
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security", "tax", "tin", "taxpayer"},
    "secret": {"token", "key", "secret", "password", "passwd", "apikey", "bearer", "auth", "credential"},
}
#: Score of a proposed and confirmed span without context, and what one nearby
#: word of its context adds. Base kinds are certain once confirmed.
PRIOR = {"iban": 0.9, "ssn": 0.3, "secret": 0.2}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.5, 40, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The account number check: moved, with letters as 10..35, it leaves 1."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _base(text: str) -> Iterator[Span]:
    for s, e in _emails(text):
        yield Span("email", s, e, 1.0)
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) < 4 and int(x or 0) <= 255 for x in parts):
            yield Span("ip", *m.span(), 1.0)
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield Span("card", *m.span(), 1.0)
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield Span("phone", *m.span(), 1.0)


def _weighed(kind: str, text: str, start: int, end: int) -> Span | None:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
    hit = any(w.lower() in CONTEXT[kind] for w in _WORDS.findall(near))
    score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * hit)
    return Span(kind, start, end, score) if score >= THRESHOLD else None


def _added(text: str) -> Iterator[Span]:
    if not _DIGIT.search(text):
        return
    confirm: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
        ("iban", _IBAN, lambda x: 15 <= len(x) <= 34 and mod97(x)),
        ("ssn", _SSN, lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"),
        ("secret", _SECRET, lambda x: len(set(x)) >= 8),
    )
    for kind, pattern, holds in confirm:
        for m in pattern.finditer(text):
            if holds(m[0].replace(" ", "")) and (span := _weighed(kind, text, *m.span())):
                yield span


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind and start; a null text has none."""
    text = text or ""
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted([*_base(text), *_added(text)], key=lambda s: (order[s.kind], s.start))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, overlaps merged, replaced by its kind."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact_documents(documents: DataFrame) -> DataFrame:
    """Documents with personal data replaced; all columns stay, in their order.

    Null and empty texts are returned as they are. Texts change one by one, so
    ties, repeated rows and further columns don't matter. n_chars, where there
    is such a column, follows the new text.
    """
    small_batches(documents.sparkSession)
    names = documents.columns
    if "text" not in names:
        raise ValueError("no column text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None else redacted(t, find(t)) for t in b.column(names.index("text")).to_pylist()]
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                kind = b.schema.field("n_chars").type
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(kind)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return documents.mapInArrow(run, documents.schema)


def find_in_documents(documents: DataFrame) -> DataFrame:
    """Spans of every whole text: doc_id and an array of (kind, start, end, score).

    Null and empty texts have no spans; every row, repeated ones too, gives one
    row; doc_id may be null. Columns other than doc_id and text are not read.
    """
    small_batches(documents.sparkSession)
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            spans = [[s._asdict() for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the list of all, from ``find_in_documents``."""
    spans = F.col("spans")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(F.size(F.filter(spans, _of(k))).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, text), ",").alias("spans"),
    )


__all__ = ["KINDS", "Span", "digest", "find", "find_in_documents", "joined", "luhn", "mod97", "redact_documents", "redacted"]
