"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Row-local: no shuffle, one pass over each whole text, every scan linear in the text's length. Offsets are code
points, ends exclusive. A null or empty text has no spans; repeated rows are judged each on its own; an empty table
gives an empty result; only the named id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows, texts

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds to the base ones, in the order in which they are listed after them.
ADDED = ("iban", "national_id")
KINDS = BASE + ADDED

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that, near a span, speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write to", "reach"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "national_id": ("ssn", "social security", "national id"),
}
#: Score before context: what a pattern alone is worth once its checksum, where it has one, holds.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * 10 + ord(c) - 48) % 97 if c.isdigit() else (rest * 100 + ord(c) - 55) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def find_spans(text: str, window: int = 40, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start. Base kinds always stay; an added kind stays if its score reaches the threshold."""
    found: list[tuple[str, int, int, float]] = []

    def add(kind: str, start: int, end: int) -> None:
        near = text[max(0, start - window) : start].lower() + " " + text[end : end + window].lower()
        score = PRIOR[kind] + (0.3 if any(re.search(rf"\b{w}", near) for w in CONTEXT[kind]) else 0.0)
        if kind in BASE or score >= threshold:
            found.append((kind, start, end, round(min(1.0, score), 4)))

    for start, end in _emails(text):
        add("email", start, end)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            add("ip", *m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            add("card", *m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                add("phone", *m.span())
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            add("iban", *m.span())
    for m in _NATIONAL.finditer(text):
        add("national_id", *m.span())
    return found


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_NAMES = ("kind", "start", "end", "score")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 40, threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind,start,end,score>> ordered by kind as listed, then start."""

    def each(rows):
        for key, text in rows:
            yield key, [dict(zip(_NAMES, s)) for s in find_spans(text, window, threshold)] if text else []

    key = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).cast("long").alias("doc_id") if key != "bigint" else F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(
        source,
        each,
        "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>",
        pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))]),
    )


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(texts(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in ADDED),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
