"""Benchmark decontamination by spaced-seed hashing.

Fixed masks read some token positions of a window and ignore others. The
hashes of all masked windows of the benchmark are joined with those of the
documents; around each hit the texts are compared token by token on the same
diagonal, so substituted tokens are tolerated. Each benchmark item is checked
against all windows of all documents; nothing is sampled or cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, odd_weights, slices, window_hashes, word_hashes

#: 1: the token counts; 0: any token may stand there. Chosen so that every overlap
#: that MIN_EQUAL and MIN_SHARE accept has a hit, wherever its substitutions are.
MASKS = ("1111011", "1110100011", "11000011011", "1110111")
#: Tokens of an overlap that must be equal; fewer only if the item itself is shorter.
MIN_EQUAL = 12
#: Equal tokens of an overlap, as a share of its length.
MIN_SHARE = 0.8
#: Bytes of benchmark text that are held by each task at once; a larger benchmark goes in blocks.
BLOCK_BYTES = 8 << 20
#: Equal windows that are expanded at once.
HITS = 1 << 18

_SHARE = Fraction(MIN_SHARE).limit_denominator(1000)
RESULT = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_equal long"
_FILTER_BITS = 22


def _weights(mask: str) -> np.ndarray:
    return np.where(np.array(list(mask)) == "1", odd_weights(len(mask), 1000 + len(mask)), np.uint64(0)) * odd_weights(1, int(mask, 2))


class Seeds:
    """The masked windows of benchmark items, sorted by hash; bounded by the block they come from."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(key, hashes) for key, text in items if len(hashes := word_hashes(text))]
        span = max(map(len, MASKS))
        short = sorted({len(h) for _, h in self.items if len(h) < span})
        self.masks = [*MASKS, *("1" * n for n in short)]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.tables = []
        for k, mask in enumerate(self.masks):
            weights, found, at, item = _weights(mask), [], [], []
            for i, (_, hashes) in enumerate(self.items):
                if k < len(MASKS) or len(hashes) == len(mask):
                    own = window_hashes(hashes, weights)
                    found.append(own)
                    at.append(np.arange(len(own)))
                    item.append(np.full(len(own), i))
            join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            found, at, item = join(found).astype(np.uint64), join(at), join(item)
            order = np.argsort(found, kind="stable")
            self.tables.append((weights, found[order], item[order], at[order]))
            self.filter[found >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(position, item, position in the item, length of the mask) of the equal masked windows, about HITS at a time."""
        for mask, (weights, found, item, at) in zip(self.masks, self.tables, strict=True):
            own = window_hashes(hashes, weights)
            where = np.flatnonzero(self.filter[own >> np.uint64(64 - _FILTER_BITS)])
            low, high = np.searchsorted(found, own[where], "left"), np.searchsorted(found, own[where], "right")
            count = high - low
            where, low, count = where[count > 0], low[count > 0], count[count > 0]
            total = np.cumsum(count)
            for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(total // HITS)) + 1):
                n = count[part]
                pick = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                yield np.repeat(where[part], n), item[pick], at[pick], len(mask)


@lru_cache(1)
def _seeds(held) -> Seeds:
    """The seeds of a broadcast block, built once in a worker."""
    return Seeds(held.value)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
    """(doc_start, item_start, n_tokens, n_equal) of the best stretch of item[i] against doc[i + shift].

    Of all stretches with a share of MIN_SHARE, the first of those with most
    equal tokens, without unequal ends; None if these are below MIN_EQUAL.
    """
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return None
    at = np.flatnonzero(item[low:high] == doc[low + shift : high + shift])
    if len(at) < min(MIN_EQUAL, len(item)):
        return None
    # From the i-th to the j-th equal token the share is reached where score[j] - score[i] <= over - under.
    under, over = _SHARE.as_integer_ratio()
    score = under * at - over * np.arange(len(at))
    first = np.searchsorted(np.maximum.accumulate(score), score - (over - under), "left")
    count = np.arange(len(at)) - first + 1
    j = int(np.argmax(count))
    start, equal = int(at[first[j]]), int(count[j])
    if equal < min(MIN_EQUAL, len(item)):
        return None
    return low + start + shift, low + start, int(at[j]) - start + 1, equal


def overlaps(seeds: Seeds, ids: list, texts: list[bytes | None]) -> list[tuple]:
    """RESULT rows of some documents: the longest overlap (by equal tokens, then place) of each item."""
    hashes = [word_hashes(x) for x in texts]
    ends = np.cumsum([len(h) for h in hashes])
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    starts = ends - [len(h) for h in hashes]
    found = [np.empty((0, 3), np.int64)]
    for place, item, at, length in seeds.hits(every):
        owner = np.searchsorted(ends, place, "right")
        whole = np.flatnonzero(place + length <= ends[owner])
        found.append(np.unique(np.stack([owner[whole], item[whole], place[whole] - starts[owner[whole]] - at[whole]], axis=1), axis=0))
    near = np.unique(np.concatenate(found), axis=0)
    best: dict = {}
    for doc, which, shift in near.tolist():
        if found := best_overlap(hashes[doc], seeds.items[which][1], shift):
            key = (doc, which)
            if key not in best or (found[3], -found[0], -found[1]) > (best[key][3], -best[key][0], -best[key][1]):
                best[key] = found
    return [(ids[doc], seeds.items[which][0], *found) for (doc, which), found in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator:
    """The benchmark's items with id and text, as broadcast blocks of about BLOCK_BYTES."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in rows])


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """RESULT: a row per row of ``docs`` and benchmark item that overlap.

    docs needs doc_id and text, benchmark item_id and text. Tokens are words
    with A-Z lower-cased. Null, empty and blank texts overlap with nothing;
    rows with a null id are ignored in the benchmark and give a null doc_id in
    the documents; repeated rows give repeated results; equal items are each
    reported. Without documents or items the result is empty.

    The benchmark is read in blocks of about BLOCK_BYTES, each a pass over the
    documents, so what a task holds doesn't grow with it.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for held in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(held)
            for batch in batches:
                for part in slices(batch):
                    rows = overlaps(seeds, part.column(0).to_pylist(), as_bytes(part.column(1)))
                    columns = list(zip(*rows, strict=True)) or [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal"])

        own = texts.mapInArrow(run, RESULT)
        found = own if found is None else found.unionByName(own)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text overlaps with no benchmark item.

    Each row is judged by its own text, so rows that share an id, or have none,
    are kept or go one by one. Null, empty and blank texts stay; repeated rows
    are all kept or all go. Without items all rows stay. Blocks of the benchmark
    are filters one after another; nothing is shuffled.
    """
    schema, at = docs.schema, docs.columns.index("text")
    for held in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(held)
            for batch in batches:
                for part in slices(batch, batch.schema.names[at]):
                    hit = {doc for doc, *_ in overlaps(seeds, range(part.num_rows), as_bytes(part.column(at)))}
                    yield part.filter(pa.array([k not in hit for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
