"""Words, word hashes and shingle sets over UTF-8 bytes, and Arrow batch helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are tokenised at once; longer texts go in pieces cut at white space.
PIECE = 1 << 22
#: Bytes of text that a batch helper hands out at once.
SLICE_BYTES = 2 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix, element-wise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_weights(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


SHINGLE_WEIGHTS = odd_weights(5, 5)


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes; no word is cut."""
    start = 0
    while len(data) - start > PIECE:
        cut = _SPACE.search(data, start + PIECE)
        if not cut:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def words(data: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at space and \\x09-\\x0D (what bytes.split splits at)."""
    return data.lower().split() if data else []


def word_hashes(data: bytes | None) -> np.ndarray:
    """64-bit hashes of the words in order."""
    if not data:
        return np.empty(0, np.uint64)
    out = []
    for piece in pieces(data):
        found = piece.lower().split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def window_hashes(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A hash of every window of len(weights) words; words of weight 0 are ignored."""
    n = len(hashes) - len(weights) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, weight in enumerate(weights):
        if weight:
            total += hashes[k : k + n] * weight
    return mix(total)


def shingle_set(data: bytes | None) -> np.ndarray:
    """Sorted distinct 5-word shingles; the whole sequence as one below five words."""
    hashes = word_hashes(data)
    if len(hashes) >= 5:
        return np.unique(window_hashes(hashes, SHINGLE_WEIGHTS))
    if len(hashes) == 0:
        return hashes
    return mix((hashes * SHINGLE_WEIGHTS[: len(hashes)]).sum(keepdims=True) + _U(len(hashes)))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 2000, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``size`` bytes of text, or elements of a list column.

    After the last slice, memory that Arrow's pool holds on to goes back.
    """
    if batch.num_rows == 0:
        return
    own = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.list_value_length(own) if pa.types.is_list(own.type) else pc.binary_length(own), 0)
    start, total = 0, 0
    for i, n in enumerate(lengths.to_pylist()):
        if i > start and (total + n > size or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)
    pa.default_memory_pool().release_unused()


def long_lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column of hashes."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))
