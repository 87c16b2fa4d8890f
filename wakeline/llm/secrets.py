"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits, checksums.

One automaton finds the keywords of all kinds in a pass over the lower-cased text (A-Z only, so that
positions stay). An expression is tried only where its keyword starts, from left to right, and never
inside the previous match of its kind. Tokens that embed a checksum are kept only if it holds. Runs of
hexadecimal digits have no keyword; a scan for the character class finds them.

Kinds, in their order: assign, access, hex (the base kinds), then github and npm (CRC-32 of the random
part in base 62), jwt (header that decodes to JSON with an algorithm), google, slack, pem.

Defined results: a null or empty text has no spans. Positions count code points, ends are exclusive.
Repeated rows get equal results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "google", "slack", "pem")
BASE = KINDS[:3]

#: The keywords of each kind and the token formats their issuers publish.
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "google": ("aiza",),
    "slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"),
    "pem": ("-----begin ",),
}
_FORMS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "npm": r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "google": r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])",
    "slack": r"xox[abprs]-[0-9]{8,}-[0-9A-Za-z-]{10,}",
    "pem": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----",
}
_FORMS = {kind: re.compile(form, re.ASCII) for kind, form in _FORMS.items()}
_HEX = re.compile("[0-9a-f]{24,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(part: str) -> str:
    """CRC-32 of a token's random part as six base-62 digits."""
    value, out = zlib.crc32(part.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit] + out
    return out


def _jwt_header(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError):
        return False


def _holds(kind: str, match: re.Match) -> bool:
    token = match[0]
    if kind == "assign":
        return len(match[1]) >= 6
    if kind == "access":
        return len(token) >= 20
    if kind in ("github", "npm"):
        return checksum62(token[4:34]) == token[34:]
    return _jwt_header(token) if kind == "jwt" else True


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in _KEYWORDS.items():
        for keyword in keywords:
            found.add_word(keyword, (kind, len(keyword)))
    found.make_automaton()
    return found


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start, then kind in the listed order."""
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    starts: dict[str, list[int]] = {}
    for last, (kind, size) in automaton.iter(low):
        starts.setdefault(kind, []).append(last - size + 1)
    spans = [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, places in starts.items():
        end = 0
        for start in sorted(places):
            match = _FORMS[kind].match(text, start) if start >= end else None
            if match:
                end = match.end()
                if _holds(kind, match):
                    spans.append((kind, start, end))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found array<struct<kind, start, end>>`` of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        kind = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64()}))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "", automaton)] for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "found": pa.array(found, kind)})

    slim = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return slim.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: bigint, end: bigint>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in BASE).encode()).hexdigest()
