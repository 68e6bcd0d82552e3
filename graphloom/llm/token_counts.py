"""Token counts by offset-mapped attribution.

A whole document is encoded once; the byte lengths of its tokens give their
character spans, which are joined to the spans of fields or sections. A token
that crosses a border goes to one section by rule: START gives it to the
section of its first character, END to that of its last one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices

MODEL = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
START, END = "start", "end"

COUNTS = "doc_id long, section long, char_start long, char_end long, n_tokens long, doc_tokens long"


class Tokenizer:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last character of each token of the text; a character may have several tokens."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.sizes[ids])
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[ends - self.sizes[ids]], char[ends - 1]


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of lines, line breaks included; an empty text is one empty line."""
    starts, at = [0], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts), np.array([*starts[1:], len(text)])


def attribute(text: str | None, starts: np.ndarray, ends: np.ndarray, tokens: Tokenizer, rule: str = START) -> tuple[np.ndarray, int]:
    """Tokens of each section [start, end), which may overlap or leave gaps, and those of the text."""
    if not text:
        return np.zeros(len(starts), np.int64), 0
    place = tokens.spans(text)[0 if rule == START else 1]
    return np.searchsorted(place, ends, "left") - np.searchsorted(place, starts, "left"), len(place)


def section_counts(docs: DataFrame, rule: str = START, model: str = MODEL) -> DataFrame:
    """COUNTS: a row per section of each row of ``docs``.

    Sections are those of the column sections, array<struct<start: long, end: long>>
    in characters, if ``docs`` has it, else lines with their line breaks. Null
    and empty texts have one line without tokens. A null or empty sections
    array gives no row, nor does a section that is null or has a null border,
    though it counts in the numbers of the others. Repeated rows give repeated
    results; a null doc_id stays null.
    """
    if rule not in (START, END):
        raise ValueError(f"unknown rule {rule!r}")
    given = "sections" in docs.columns
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(model)
        for batch in batches:
            for part in slices(batch):
                out = [[] for _ in names]
                sections = part.column(2).to_pylist() if given else [None] * part.num_rows
                for row, (data, own) in enumerate(zip(as_bytes(part.column(1)), sections, strict=True)):
                    text = data.decode() if data else ""
                    if given:
                        whole = [(k, s["start"], s["end"]) for k, s in enumerate(own or []) if s and s["start"] is not None and s["end"] is not None]
                        place, starts, ends = np.array(whole, np.int64).reshape(-1, 3).T
                    else:
                        starts, ends = line_sections(text)
                        place = np.arange(len(starts))
                    counts, total = attribute(text, starts, ends, tokens, rule)
                    n = len(starts)
                    for column, values in zip(out, (np.full(n, row), place, starts, ends, counts, np.full(n, total)), strict=True):
                        column.append(values)
                rows, *columns = (pa.array(np.concatenate(c).astype(np.int64)) for c in out)
                arrays = [part.column(0).take(rows), *columns]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns, *(["sections"] if given else [])).mapInArrow(run, COUNTS)
