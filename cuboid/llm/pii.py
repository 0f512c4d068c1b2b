"""Personal data: expressions propose spans, validators confirm them, context words move the score.

Every whole text is read in one pass, one row at a time, so memory follows the longest text and no
row meets another.  Each scan is linear in the text, also for runs of one character class.

Cases: null and empty texts have no findings; repeated rows give repeated results; ties between
findings that overlap go to the higher score, then to the earlier start; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuboid.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "key", "password", "national")
KINDS = BASE_KINDS + ADDED_KINDS
#: What a redacted span becomes.
MASKS = {kind: f"<{kind.upper()}>" for kind in KINDS}


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# A match can only start where a run of digits starts: from inside a run the same end is met.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,40}+")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_PASSWORD = re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|api_key|apikey|secret)\s?[=:]\s?([^\s,;\"'<>]{6,}+)")
_FREE = re.compile(b"\0+")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")

#: Words that raise a kind's score when they stand in the window before or behind a span.
CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|address|host|server|login|client|adresse|servidor|serveur)\b"),
    "card": re.compile(r"(?i)\b(?:card|credit|debit|visa|mastercard|amex|karte|tarjeta|carte)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|handy|llame|appelez)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|cuenta|compte|bic|swift)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social|security|taxpayer)\b"),
    "key": re.compile(r"(?i)\b(?:aws|key|access|secret|token|credential)\b"),
    "password": re.compile(r"(?i)\b(?:user|username|login|account|password|secret)\b"),
    "national": re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|telefon)\b"),
}
#: Score without context; what context adds; where a finding of an added kind is kept.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5, "key": 0.9, "password": 0.8, "national": 0.4}
#: An IBAN whose length isn't its country's is kept for its context only.
ODD_IBAN = 0.4
CONTEXT_GAIN = 0.2
THRESHOLD = 0.5
WINDOW = 60


# Lengths of IBANs by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
        "MT31 MU30 NI28 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i & 1:
            d += d - 9 if d > 4 else d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether letters and digits of an IBAN leave 1, its first four characters moved to its end."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a match's only ``@`` follows the run of local characters that it starts with."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            # The run behind this sign belongs to the next match, if any: nothing before it can start one.
            free, at = at + 1, text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 38:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds in their order, each by start."""
    found = [("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *x) for x in _ips(text)]
        found += [("card", *x) for x in _cards(text)]
        if "+" in text:
            found += [("phone", *x) for x in _phones(text)]
    return found


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        whole = m[0]
        ends = [i for i in range(15, len(whole) + 1) if i == len(whole) or whole[i] == " "]
        for end in reversed(ends):  # a word in capitals may follow the number
            if m.start() + end < len(text) and end == len(whole) and text[m.start() + end].isalnum():
                continue
            bare = whole[:end].replace(" ", "")
            if 15 <= len(bare) <= 34 and mod97(bare):
                yield m.start(), m.start() + end
                break


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    own = SCORES[kind]
    if kind == "iban" and IBAN_LENGTHS.get(text[start : start + 2]) != sum(map(str.isalnum, text[start:end])):
        own = ODD_IBAN
    return min(1.0, own + (CONTEXT_GAIN if CONTEXT[kind].search(around) else 0.0))


def findings(text: str) -> list[Finding]:
    """Base findings, which always stay, then the added ones that reach the threshold and overlap none that is stronger.

    Of a password that overlaps a stronger finding the other pieces stay, so that none of it is left in a text.
    """
    base = [Finding(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    more: list[Finding] = []
    if _DIGIT.search(text) or "=" in text or ":" in text:
        proposed = [("iban", *x) for x in _ibans(text)]
        proposed += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        proposed += [("key", *m.span()) for m in _KEY.finditer(text)]
        if "=" in text or ":" in text:
            proposed += [("password", *m.span(1)) for m in _PASSWORD.finditer(text)]
        proposed += [("national", *m.span()) for m in _NATIONAL.finditer(text)]
        scored = sorted((Finding(k, a, b, score(text, k, a, b)) for k, a, b in proposed), key=lambda x: (-x.score, x.start, -x.end))
        covered = bytearray(len(text)) if scored else b""
        for x in base if scored else ():
            covered[x.start : x.end] = b"\1" * (x.end - x.start)
        for x in scored:
            if x.score >= THRESHOLD and not any(covered[x.start : x.end]):
                more.append(x)
                covered[x.start : x.end] = b"\1" * (x.end - x.start)
            elif x.score >= THRESHOLD and x.kind == "password":
                more += [x._replace(start=x.start + m.start(), end=x.start + m.end()) for m in _FREE.finditer(covered[x.start : x.end])]
                covered[x.start : x.end] = b"\1" * (x.end - x.start)
    more.sort(key=lambda x: (KINDS.index(x.kind), x.start))
    return base + more


def redacted(text: str) -> str:
    """The text with every finding replaced by its kind's mask; findings that overlap become one mask."""
    out, at, until = [], 0, 0
    for x in sorted(findings(text), key=lambda x: (x.start, -x.end)):
        if x.start >= until:
            out += [text[at : x.start], MASKS[x.kind]]
        until = max(until, x.end)
        at = until
    return "".join(out) + text[at:]


def _joined(found: list[Finding]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, top_score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = findings(text.as_py() or "")
            kinds = [x.kind for x in found]
            base = [x for x in found if x.kind in BASE_KINDS]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            rows.append((*(kinds.count(k) for k in BASE_KINDS), digest, _joined(found), len(found) - len(base), max((x.score for x in found), default=0.0)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "top_score"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True))], names)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans and all spans (code points, end exclusive)."""
    return common.texts(docs).mapInArrow(_scan, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns as they are, but ``text`` redacted and ``n_chars`` (if there) counted anew; null texts stay null."""
    common.bounded(docs.sparkSession)
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema: StructType = docs.schema

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := x.as_py()) is None else redacted(t) for x in batch.column(at)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if counted is not None:
                cols[counted] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(common.releasing(rewrite), schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents")).select(*(F.col(c) for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "top_score")))
