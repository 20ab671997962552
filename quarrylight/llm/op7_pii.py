"""Personal data: patterns propose, checksums confirm, context words adjust.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  The
method adds candidates that those patterns miss: bank account numbers (mod-97),
card numbers and phone numbers glued to other digits, national phone numbers
and identity numbers.  Each has a prior, a checksum where its kind has one, and
words within a window around it raise or lower its score; it stays at or above
``min_score``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded, pieces, scan, whole_row

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start only: later starts in it end at the same places.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone", "iban", "national_id"]

# kind, pattern, prior score, words that speak for it
ADDED = [
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"), 0.6, "card credit visa mastercard amex payment pay"),
    ("phone", re.compile(r"\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"), 0.7, "phone tel call mobile cell fax contact"),
    ("phone", re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"), 0.3, "phone tel call mobile cell fax contact"),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), 0.7, "iban account bank transfer konto cuenta compte"),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), 0.3, "ssn social security identity tax id"),
]
AGAINST = frozenset("order invoice version serial isbn part item sku page".split())
WORD = re.compile(r"[a-z]+")
CONTEXT_CHARS = 40
STEP = 0.3
MIN_SCORE = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    raw = iban.replace(" ", "")
    return 15 <= len(raw) <= 34 and int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards so that no run is read twice."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, end) as fixed by the contract, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches that cover the same places, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def context(text: str, start: int, end: int, good: frozenset) -> float:
    near = set(WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())) | set(WORD.findall(text[end : end + CONTEXT_CHARS // 2].lower()))
    return STEP * (bool(near & good) - bool(near & AGAINST))


PATTERNS = [(KINDS.index(k), k, p, prior, frozenset(words.split())) for k, p, prior, words in ADDED]
HAS_DIGITS = re.compile(r"[0-9]{2}")


def added_spans(text: str, base: list[tuple[int, int, str]], min_score: float = MIN_SCORE) -> list[tuple[int, int, int, float]]:
    """Spans beyond the base ones: none overlaps a base span or another added one."""
    out: list[tuple[int, int, int, float]] = []
    if not HAS_DIGITS.search(text):
        return out
    taken = merged((s, e) for s, _, e in base)
    for place, kind, pattern, prior, good in PATTERNS:
        new = []
        for m in pattern.finditer(text):
            s, e = m.span()
            i = bisect_left(taken, (e,)) - 1  # the last stretch that starts before e
            if i >= 0 and taken[i][1] > s:
                continue
            if kind == "card" and not (13 <= len(d := digits_of(m[0])) <= 19 and d[0] in "3456" and luhn(d)):
                continue
            if kind == "iban" and not mod97(m[0]):
                continue
            score = min(1.0, prior + context(text, s, e, good))
            if score >= min_score:
                out.append((s, place, e, score))
                new.append((s, e))
        if new:
            taken = merged([*taken, *new])
    return out


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def redact(text: str, spans: list) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, done = [], 0
    for s, k, e, *_ in spans:
        if s >= done:
            out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, base counts, n_added, base_spans, spans (text form), and the redacted text.

    A null or empty text has no spans and becomes empty.  Positions are code
    points, ends exclusive.  Spans of different kinds may overlap.  Other input
    columns are ignored; ``carry`` adds the whole input row as the struct ``row_``.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([whole_row(docs)] if carry else []))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "spans", "text"]
    fields = [StructField(n, LongType() if i < 6 else StringType()) for i, n in enumerate(names)]
    schema = StructType([*fields, *([rows.schema["row_"]] if carry else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            cols: list[list] = [[] for _ in names[1:]]
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                every = sorted([*base, *added_spans(text, base, min_score)])
                counts = [*(sum(k == i for _, k, _ in base) for i in range(4)), len(every) - len(base)]
                for c, v in zip(cols, [*counts, joined(base), joined(every), redact(text, every) if every else text], strict=True):
                    c.append(v)
            made = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made, *([b.column(2)] if carry else [])], names=schema.names)

    bounded(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = find_pii(scan(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_added")


ORACLE = None  # positions of several patterns with checksums: held against plain regular expressions in tests/llm
