"""Secret scans: Aho-Corasick keyword hits, anchored patterns at hits, embedded checks.

All work is on UTF-8 bytes: keywords and patterns are ASCII, so byte matching
equals matching by code points; offsets are turned into code points for the
few spans found.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

# Where each kind may begin (lower case) and what stands there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "api_key": "assign", "apikey": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s]+-----END \1-----"),
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = bytes(ord("h") if chr(x) in "0123456789abcdef" else ord(".") for x in range(256))
_HEX_RUN = b"h" * 32


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _base62_crc(token: bytes) -> bool:
    """The last six characters are the CRC32 of those between prefix and checksum, in base 62."""
    n, digits = zlib.crc32(token[4:-6]), ""
    while n:
        n, digit = divmod(n, 62)
        digits = _BASE62[digit] + digits
    return digits.rjust(6, "0").encode() == token[-6:]


def _json_object(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _pem_body(text: bytes) -> bool:
    try:
        return base64.b64decode(b"".join(text.split(b"-----")[2].split()), validate=True)[:1] == b"\x30"
    except (binascii.Error, IndexError):
        return False


#: What an anchored match must pass.
CHECKS = {
    "assign": lambda m: len(m[1]) >= 8,
    "access": lambda m: len(m[0]) >= 16,
    "hex": lambda m: len(m[0]) >= 32,
    "github": lambda m: _base62_crc(m[0]),
    "npm": lambda m: _base62_crc(m[0]),
    "jwt": lambda m: _json_object(m[1]) and _json_object(m[2]),
    "pem": lambda m: _pem_body(m[0]),
}


def _candidates(data: bytes) -> Iterator[tuple[int, str]]:
    """Byte offsets at which a kind may begin, ascending within each kind."""
    for end, (length, kind) in _automaton().iter(data.lower().decode("latin-1")):
        yield end + 1 - length, kind
    classes = data.translate(_IS_HEX)
    at = classes.find(_HEX_RUN)
    while at >= 0:
        yield at, "hex"
        after = classes.find(b".", at)
        at = classes.find(_HEX_RUN, after) if after >= 0 else -1


def find_spans(data: bytes | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as in KINDS.

    Within a kind, matches are leftmost and do not overlap; a match that fails
    its check still takes its place, as a plain left-to-right search would.
    """
    if not data:
        return []
    done, found = dict.fromkeys(KINDS, 0), []
    for start, kind in _candidates(data):
        if start >= done[kind] and (m := PATTERNS[kind].match(data, start)):
            done[kind] = m.end()
            if CHECKS[kind](m):
                found.append((start, m.end(), kind))
    found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    if data.isascii():
        return found
    points, last, chars = {}, 0, 0
    for at in sorted({x for start, end, _ in found for x in (start, end)}):
        chars += len(data[last:at].decode("utf-8"))
        points[at], last = chars, at
    return [(points[start], points[end], kind) for start, end, kind in found]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, secrets) with secrets array<struct<kind, start, end>>, ends exclusive, a row per row.

    Null and empty texts have empty arrays; repeated rows and null ids have a
    row each; an empty table has none. Nothing else is read of ``docs``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for part in slices(batch):
                rows = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(x)] for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(rows, pa.list_(kind))], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>")


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def digest(spans: list[tuple[int, int, str]]) -> tuple[int, int, int, str, str]:
    """Counts of the base kinds, sha256 of the base spans, and all spans as text."""
    counts = [sum(k == kind for *_, k in spans) for kind in BASE_KINDS]
    return *counts, sha256(_joined(x for x in spans if x[2] in BASE_KINDS).encode()).hexdigest(), _joined(spans)


def scan_digest(docs: DataFrame) -> DataFrame:
    """scan() with its spans as counts and text: a row per row of ``docs``, no spans being 0 and empty text; an empty table has none."""
    part = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(part(base), 256).alias("base_sha256"), part(F.col("secrets")).alias("spans"))


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by [kind]; of overlapping spans, one mark for their union."""
    spans = find_spans(text.encode()) if text else []
    if not spans:
        return text
    out, last, open_to = [], 0, 0
    for start, end, kind in spans:
        if start >= open_to:
            out += [text[last:start], f"[{kind}]"]
        last = open_to = max(open_to, end)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its secrets replaced in text and n_chars, if there, counted anew.

    Texts without secrets, null texts among them, and all other columns stay as they are.
    """
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = pa.array([redacted(x) for x in part.column(at).to_pylist()], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([texts if k == at else part.column(k) for k in range(part.num_columns)], schema=part.schema)

    cleaned = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return cleaned
