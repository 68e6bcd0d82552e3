"""Media columns: interleaved sequences of text and media, payloads joined by digest.

HTML is parsed into ordered parts, text or media reference, with position and
caption. Payloads are stored once for each digest as 8-bit greyscale PNG files
of 64 samples a row; references find them by digest.
"""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices
from graphloom.storage import Scratch

#: Samples of a row of a stored payload; payloads are padded with zeros to a positive multiple.
WIDTH = 64
LEVEL = 1
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_HIDDEN = frozenset(("script", "style", "template", "noscript"))
_BREAK = frozenset(("p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "figure", "figcaption", "br", "header", "footer", "nav", "blockquote", "pre"))
_MEDIA = {"img": "image", "audio": "audio", "video": "video"}

PART = "position: int, kind: string, text: string, ref: string, caption: string"


def padded(data: bytes | None) -> bytes:
    """The bytes with zeros appended up to a positive multiple of WIDTH."""
    data = data or b""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> bytes:
    """The samples of a PNG that write_png made; raises ValueError where a checksum or the form doesn't hold."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + content) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a greyscale PNG of this width")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and a 64-bit difference hash of an 8 x 9 grid of block means, as text."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    row_edges = np.linspace(0, len(rows), 9).astype(int)
    column_edges = np.linspace(0, WIDTH, 10).astype(int)
    columns = np.add.reduceat(rows, column_edges[:-1], axis=1, dtype=np.int64)
    total = np.concatenate([np.zeros((1, 9), np.int64), np.cumsum(columns, axis=0)])
    counts = np.maximum(np.diff(row_edges), 1)[:, None] * np.diff(column_edges)[None]
    grid = np.diff(total[row_edges], axis=0) / counts
    bits = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    n, s = rows.size, int(columns.sum())
    histogram = np.bincount(rows.ravel(), minlength=256)
    square = int((histogram * np.arange(256, dtype=np.int64) ** 2).sum())
    return f"{s / n:.4f}:{max(square / n - (s / n) ** 2, 0) ** 0.5:.4f}:{bits}"


class _Sequence(HTMLParser):
    """Collects parts in document order; the figcaption of a figure, before or after, is the caption of its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA or (tag == "source" and dict(attrs).get("src")):
            own = dict(attrs)
            if own.get("src") and not self.hidden:
                self.flush()
                part = {"kind": _MEDIA.get(tag, "media"), "text": None, "ref": own["src"], "caption": own.get("alt") or own.get("title")}
                self.parts.append(part)
                for figure in self.figures[-1:]:
                    figure["parts"].append(part)
        elif tag in _BREAK:
            self.flush()
            if tag == "figure":
                self.figures.append({"parts": [], "said": ""})
            elif tag == "figcaption":
                self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            for figure in self.figures[-1:]:
                figure["said"] = " ".join("".join(self.caption).split())
            self.caption = None
        elif tag in _BREAK:
            self.flush()
            if tag == "figure" and self.figures:
                self.caption = None
                self.leave()

    def leave(self) -> None:
        """Ends the innermost figure."""
        figure = self.figures.pop()
        for part in figure["parts"]:
            part["caption"] = figure["said"] or part["caption"]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text.clear()
        if said:
            self.parts.append({"kind": "text", "text": said, "ref": None, "caption": None})


def parse_html(source: str | None) -> list[dict]:
    """The ordered parts of a page, position counting from 0; null and empty pages have none."""
    parser = _Sequence()
    parser.feed(source or "")
    parser.close()
    parser.flush()
    while parser.figures:
        parser.leave()
    return [{"position": k} | part for k, part in enumerate(parser.parts)]


def sequences(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(key, parts array<struct<PART>>), a row per row of ``pages``; null and empty sources have no parts.

    Repeated rows and null keys have a row each.
    """
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[1]):
                made = [parse_html(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, kind)], names=[key, "parts"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(column).cast("string").alias(column)).mapInArrow(run, f"{key} long, parts array<struct<{PART}>>")


def resolve(parts: DataFrame, key: str, payloads: DataFrame) -> DataFrame:
    """Each media part, and the other columns of ``parts``, with the columns of ``payloads`` (digest first) that its reference names.

    References read digest:HEX; others, and digests without payload, keep a row
    with nulls, so positions and captions stay aligned with the sequence.
    """
    more = [c for c in parts.columns if c not in (key, "parts")]
    each = parts.select(key, *more, F.explode("parts").alias("part")).select(key, *more, "part.*").where("kind <> 'text'")
    each = each.withColumn("digest", F.regexp_extract("ref", "^digest:([0-9a-f]{64})$", 1))
    return each.join(payloads, "digest", "left")


STORED = "digest string, n_bytes long, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """STORED: the payload of each text as PNG, one row per distinct text of a task's slice.

    A text's digest is that of its unpadded bytes, so texts that differ only in
    padding don't meet. Payloads aren't shuffled: copies that fall to different
    slices are stored by each, and whoever joins takes one (``once``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = {sha256(x or b"").hexdigest(): x or b"" for x in as_bytes(part.column(1))}
                files = [write_png(padded(x)) for x in own.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([len(x) for x in own.values()], pa.int64()), pa.array(files, pa.binary())], names=["digest", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, STORED)


def once(rows: DataFrame) -> DataFrame:
    """One row per digest of STORED or FEATURES rows; those of a digest are equal."""
    return rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in rows.columns if c != "digest"))


def features(stored: DataFrame) -> DataFrame:
    """FEATURES, all computed from the stored files read back."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", rows=256):
                rows = []
                for digest, n, data in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    samples = read_png(data)
                    rows.append((digest, n, len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(data), sha256(data).hexdigest(), feature(samples)))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if "long" in kind else pa.string()) for c, kind in zip(columns, FEATURES.split(", "), strict=True)], names=names)

    return stored.mapInArrow(run, FEATURES)


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, html): each document's whole text as paragraphs around a figure that refers to its payload by digest.

    A paragraph is a line; the figure stands after half of them. Its caption
    says how many words and bytes the payload has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                pages = []
                for data in (x or b"" for x in as_bytes(part.column(1))):
                    lines = [f"<p>{html.escape(x, quote=False)}</p>" for x in data.decode().split("\n")]
                    figure = f'<figure><img src="digest:{sha256(data).hexdigest()}"><figcaption>{len(data.split())} words, {len(data)} bytes</figcaption></figure>'
                    half = (len(lines) + 1) // 2
                    pages.append("".join([*lines[:half], figure, *lines[half:]]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages)], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, html string")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, FEATURES but the digest, n_parts, text_sha256, position and caption: a row per row of ``docs``.

    Payloads are written as files to the shared folder and read back; their
    features, one row a digest, are joined to the references of the sequences.
    text_sha256 is that of the sequence's text parts, a line each. The caption
    tells words and bytes of the text as its page had them, so that it can be
    held against n_bytes, which the digest join brings. Null and empty texts
    hold a payload of zeros. Repeated rows and null ids have a row each.
    """
    scratch = Scratch(docs.sparkSession, "media")
    found = scratch.keep(once(features(scratch.keep(store(docs), "stored"))), "features")
    parts = sequences(wrapped(docs), "doc_id", "html")
    texts = F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["text"])
    parts = parts.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.sha2(F.array_join(texts, "\n"), 256).alias("text_sha256"), F.filter("parts", lambda p: p["kind"] != "text").alias("parts"))
    names = [x.split()[0] for x in FEATURES.split(", ")[1:]]
    return resolve(parts, "doc_id", found).select("doc_id", *names, "n_parts", "text_sha256", "position", "caption")


def page_sequences(pages: DataFrame) -> DataFrame:
    """page_id, position, kind, ref, caption and text_sha256: a row per part of each page's html, text and media in their order.

    Null and empty pages have no rows; repeated pages have theirs each.
    """
    each = sequences(pages, "page_id", "html").select("page_id", F.explode("parts").alias("p")).select("page_id", "p.*")
    return each.select("page_id", "position", "kind", "ref", "caption", F.sha2("text", 256).alias("text_sha256"))
