"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut into runs (a run of spaces with the word after it, or a line
break); no piece of the vocabulary crosses their borders. The lattice of a run
has an edge for every piece that stands there. The forward pass sums the
weights of all segmentations of each prefix, once for each distinct run of a
batch; the backward pass draws, for each occurrence, the last piece, then the
one before it, and so on, each in proportion to what reaches it. The numbers
drawn are hashes of the row key, the run's place in the text and the step, so a
row is cut the same way wherever and whenever it is processed.

Short runs go through the lattice together, as arrays. A run above SHORT goes
alone, in blocks: the forward pass keeps the last sums of each block, scaled
into range, and the backward pass rebuilds the blocks from the last to the
first. No run is cut, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.text import as_bytes, mix, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A piece of merge rank r has weight (r + SHIFT) ** -alpha; pieces of a BPE model have ranks, not probabilities.
SHIFT = 2.7
ALPHA = 1.0
#: Runs of at most so many characters are sampled together; the sums of longer ones would leave the range of doubles.
SHORT = 64
#: Weights are multiplied by this for each character, so that sums of a short run stay in that range.
PER_CHARACTER = 100.0
#: Characters of a longer run whose lattice is held at once.
BLOCK = 1 << 14
#: Bytes of text that are sampled at once.
BATCH_BYTES = 1 << 19

_U = np.uint64
_STEP, _PLACE = _U(0xD1B54A32D192ED03), _U(0x9E3779B97F4A7C15)
_BASE = _U(0x100000001B3 * 2 + 1)
_SLOT_BITS = 20


class Vocabulary:
    """Pieces of a SentencePiece model, with spaces for its space mark, found by hashes of code points."""

    def __init__(self, path: str, alpha: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        byte_ids = {int(model.id_to_piece(k)[1:-1], 16): k for k in ids if model.is_byte(k)}
        plain = [k for k in ids if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        names = [model.id_to_piece(k).replace("▁", " ") for k in plain]
        if any(re.search(r"[^ ][ ]", x) or ("\n" in x and x != "\n") for x in names):
            raise ValueError("pieces of this model cross words; runs would cut them")
        weights = np.array([min(max(0.0, -model.get_score(k)), len(ids)) + SHIFT for k in plain]) ** -alpha
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.ids = np.array([*plain, -1], np.int32)
        self.weights = np.array([*(weights / weights.sum()), 0.0])
        self.low = float(self.weights[:-1].min())
        self.longest = max(map(len, names))
        text = dict(zip(plain, (x.encode() for x in names), strict=True)) | {k: bytes([b]) for b, k in byte_ids.items()}
        parts = [text.get(k, b"") for k in ids]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(x) for x in parts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        prefixes = sorted({x[:n] for x in names for n in range(1, len(x))} - set(names))
        entries = [*names, *prefixes]
        self.none, self.entries = len(names), len(entries)
        self.lengths = np.array([*map(len, entries), 0])
        self.keys = np.array([*map(self._key, entries), 0], np.uint64)
        self.slots = np.full((1 << _SLOT_BITS) + 64, self.entries, np.int32)
        for k, key in enumerate(self.keys[:-1].tolist()):
            at = key >> 64 - _SLOT_BITS
            while self.slots[at] != self.entries:
                at += 1
            self.slots[at] = k

    def text_of(self, piece: int) -> str:
        return self.buffer[self.starts[piece] : self.starts[piece] + self.sizes[piece]].tobytes().decode(errors="replace")

    @staticmethod
    def _key(text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = h * _BASE + _U(ord(c) + 1)
        return int(mix(h)[0])

    def find(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Per hash, the piece of that length (below none), a prefix of pieces (below entries) or entries."""
        keys = mix(hashes)
        at = (keys >> _U(64 - _SLOT_BITS)).astype(np.int64)
        found = self.slots[at]
        wrong = np.flatnonzero((found != self.entries) & (self.keys[found] != keys))
        while len(wrong):
            at[wrong] += 1
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(found[wrong] != self.entries) & (self.keys[found[wrong]] != keys[wrong])]
        found[self.lengths[found] != length] = self.entries
        return found


@lru_cache(2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _runs(chars: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where runs start."""
    space, line = chars == 32, chars == 10
    start = line.copy()
    start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    start[doc_starts] = True
    return np.flatnonzero(start)


def _edges(chars: np.ndarray, at: np.ndarray, left: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pieces), each (longest, len(chars)): the piece of n characters that starts at each place of ``at``, at row n - 1.

    left says how many characters of its run follow from a place on. A single
    character always has a weight.
    """
    edges = np.zeros((vocab.longest, len(chars)), np.float32)
    pieces = np.full((vocab.longest, len(chars)), vocab.none, np.uint16)
    hashes = np.zeros(len(at), np.uint64)
    for n in range(1, vocab.longest + 1):
        hashes = hashes * _BASE + chars[at + n - 1].astype(np.uint64) + _U(1)
        found = vocab.find(hashes, n)
        piece = np.minimum(found, vocab.none)
        pieces[n - 1, at] = piece
        weight = vocab.weights[piece]
        if n == 1:
            weight[weight == 0] = vocab.low
        edges[n - 1, at] = weight * PER_CHARACTER**n
        more = (found < vocab.entries) & (left[at] > n)
        at, hashes = at[more], hashes[more]
    return edges, pieces


class Lattice:
    """The lattices of some runs, laid out one after the other with a free place after each.

    As many places as the longest piece has characters are free before the first.

    edges[l - 1][p] is the weight of the piece of l characters that starts at p,
    pieces[l - 1][p] its index; forward[p] sums the weights of all
    segmentations of what is between the run's start and p, and shares[p][n - 1]
    is the part of them whose last piece has n characters at most.
    """

    def __init__(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary):
        room = lengths + 1
        margin = vocab.longest
        self.ends = margin + np.cumsum(room) - 1
        self.begins = self.ends - lengths
        shift = np.repeat(starts - self.begins, room)
        places = margin + np.arange(int(room.sum()))
        size = margin + len(places)
        left = np.zeros(size, np.int64)
        left[margin:] = np.repeat(self.ends, room) - places
        self.chars = np.zeros(size, np.uint32)
        self.chars[margin:] = chars[np.minimum(places + shift, len(chars) - 1)]
        self.edges, self.pieces = _edges(self.chars, np.flatnonzero(left), left, vocab)
        self.forward = np.zeros(size)
        self.forward[self.begins] = 1
        order = np.argsort(-lengths, kind="stable")
        begins, sorted_lengths = self.begins[order], -lengths[order]
        for j in range(1, int(lengths.max(initial=0)) + 1):
            end = begins[: np.searchsorted(sorted_lengths, -j, "right")] + j
            total = np.zeros(len(end))
            for n in range(1, min(j, vocab.longest) + 1):
                total += self.forward[end - n] * self.edges[n - 1, end - n]
            self.forward[end] = total
        self.shares = np.zeros((size, vocab.longest), np.float32)
        reached, whole = np.zeros(size), np.maximum(self.forward, 1e-300)
        for n in range(1, vocab.longest + 1):
            reached[n:] += self.forward[:-n] * self.edges[n - 1, :-n]
            self.shares[:, n - 1] = reached / whole
        self.shares[self.shares >= self.shares[:, -1:]] = 1


class LongRun:
    """One run of any length; see the module for its blocks."""

    def __init__(self, chars: np.ndarray, vocab: Vocabulary):
        self.chars, self.vocab = chars, vocab
        self.windows = [[0.0] * (vocab.longest - 1) + [1.0]]
        for k in range((len(chars) - 1) // BLOCK):
            self.windows.append(self._forward(k)[0])

    def _forward(self, k: int, keep: bool = False) -> tuple[list[float], list, np.ndarray | None]:
        """The last sums of block k, scaled so that the greatest is 1, and, to keep, shares and pieces.

        shares[p] lists (share of the sum with last pieces of n characters at
        most, n) for the end p; pieces[n - 1, q] is the piece that starts at q.
        Places count from ``longest`` before the block.
        """
        reach = self.vocab.longest
        low, high = k * BLOCK, min((k + 1) * BLOCK, len(self.chars))
        first = max(0, low - reach)
        own = np.zeros(reach + high - low + reach, np.uint32)
        own[first - low + reach : reach + high - low] = self.chars[first:high]
        left = np.zeros(len(own), np.int64)
        left[first - low + reach : reach + high - low] = np.arange(high - first, 0, -1)
        edges, pieces = _edges(own, np.flatnonzero(left), left, self.vocab)
        ends: list[list] = [[] for _ in range(reach + high - low + 1)]
        rows, starts = np.nonzero(edges)
        for n, q, weight in zip((rows + 1).tolist(), starts.tolist(), edges[rows, starts].tolist(), strict=True):
            if reach < q + n < len(ends):
                ends[q + n].append((n, q, weight))
        sums, shares = [0.0, *self.windows[k]], []
        for p in range(reach + 1, len(ends)):
            total, own_shares = 0.0, []
            for n, q, weight in ends[p]:
                if sums[q] > 0:
                    total += sums[q] * weight
                    own_shares.append((total, n))
            sums.append(total)
            if keep:
                shares.append([(x / total, n) for x, n in own_shares[:-1]] + [(1.0, own_shares[-1][1])])
            if not 1e-100 < total < 1e100:
                sums[p - reach + 1 :] = [x / total for x in sums[p - reach + 1 :]]
        tail = sums[-reach:]
        return [x / max(tail) for x in tail], shares, pieces if keep else None

    def draw(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and their first characters, last one first."""
        reach, found, points = self.vocab.longest, [], []
        at = len(self.chars)
        units: list[float] = []
        for k in reversed(range(len(self.windows))):
            low = k * BLOCK
            if at <= low:
                continue
            _, shares, pieces = self._forward(k, keep=True)
            while at > low:
                if len(found) == len(units):
                    steps = np.arange(len(units) + 1, len(units) + 1025, dtype=np.uint64)
                    units += ((mix(seed + steps * _STEP) >> _U(11)) * 2.0**-53).tolist()
                unit = units[len(found)]
                n = next(n for share, n in shares[at - low - 1] if unit < share)
                at -= n
                found.append(pieces[n - 1, at - low + reach])
                points.append(self.chars[at])
        return np.array(found, np.uint16), np.array(points, np.uint32)


def sample(texts: list[str | None], keys: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and how many each has; null and empty texts have none."""
    sizes = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    if not sizes.sum():
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    chars = np.frombuffer("".join(f" {x}" for x in texts if x).encode("utf-32-le"), "<u4")
    full = np.flatnonzero(sizes)
    doc_starts = (np.cumsum(sizes) - sizes)[full]
    starts = _runs(chars, doc_starts)
    lengths = np.diff(np.append(starts, len(chars)))
    owner = np.searchsorted(doc_starts, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, doc_starts)[owner]

    seeds = mix(mix(keys[full].astype(np.int64).view(np.uint64))[owner] + place.astype(np.uint64) * _PLACE)
    within = np.arange(len(chars)) - np.repeat(starts, lengths)
    names = np.add.reduceat(mix(chars.astype(np.uint64) + _U(1) + (within.astype(np.uint64) + _U(1)) * _PLACE), starts)
    short = np.flatnonzero(lengths <= SHORT)
    _, first, which = np.unique(names[short], return_index=True, return_inverse=True)
    lattice = Lattice(chars, starts[short][first], lengths[short][first], vocab)

    at, begins = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    at[short], begins[short] = lattice.ends[which], lattice.begins[which]
    active, steps, counts = short, [], np.zeros(len(starts), np.int64)
    while len(active):
        end = at[active]
        unit = (mix(seeds[active] + np.array([len(steps) + 1], np.uint64) * _STEP) >> _U(11)) * 2.0**-53
        size = (lattice.shares[end] <= unit[:, None]).sum(axis=1) + 1
        start = end - size
        steps.append((active, lattice.pieces[size - 1, start], lattice.chars[start]))
        counts[active] += 1
        at[active] = start
        active = active[start > begins[active]]
    alone = [(k, *LongRun(chars[starts[k] : starts[k] + lengths[k]], vocab).draw(seeds[k : k + 1])) for k in np.flatnonzero(lengths > SHORT).tolist()]
    for k, piece, _ in alone:
        counts[k] = len(piece)

    last = np.cumsum(counts)
    pieces, points = np.empty(last[-1], np.uint16), np.empty(last[-1], np.uint32)
    for k, (own, piece, char) in enumerate(steps):
        pieces[last[own] - 1 - k], points[last[own] - 1 - k] = piece, char
    for k, piece, char in alone:
        pieces[last[k] - len(piece) : last[k]], points[last[k] - len(piece) : last[k]] = piece[::-1], char[::-1]
    ids = vocab.ids[pieces]
    bare = ids < 0
    room = np.where(bare, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
    out = np.repeat(ids, room)
    ends = np.cumsum(room)
    for k in np.flatnonzero(bare) if bare.any() else ():
        out[ends[k] - room[k] : ends[k]] = vocab.byte_ids[list(chr(points[k]).encode())]
    per_doc = np.zeros(len(texts), np.int64)
    per_doc[full] = np.add.reduceat(np.add.reduceat(room, last - counts), np.searchsorted(starts, doc_starts))
    return out, per_doc


def join(ids: np.ndarray, vocab: Vocabulary) -> bytes:
    """The text of piece ids, without the space that encoding puts first."""
    sizes = vocab.sizes[ids]
    places = np.repeat(vocab.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return vocab.buffer[places].tobytes()[1:]


ENCODED = "doc_id long, piece_ids array<int>, n_pieces long, n_bytes long, text_sha256 string"


def _encoded(docs: DataFrame, model: str, alpha: float, back: bool) -> DataFrame:
    """ENCODED and, on demand, decoded_sha256 and lossless, in one pass: a second Python stage would double the workers of a task."""
    more = ", decoded_sha256 string, lossless boolean" if back else ""
    names = [x.split()[0] for x in (ENCODED + more).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for batch in batches:
            for part in slices(batch, rows=1000, size=BATCH_BYTES):
                texts = as_bytes(part.column(1))
                ids, sizes = sample([x.decode() if x else None for x in texts], part.column(0).fill_null(0).to_numpy(), vocab)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                digests = [sha256(x or b"").hexdigest() for x in texts]
                columns = [part.column(0), lists, pa.array(sizes), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(digests)]
                if back:
                    decoded = [join(ids[end - n : end], vocab) for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    columns.append(pa.array([sha256(x).hexdigest() for x in decoded]))
                    columns.append(pa.array([x == (y or b"") for x, y in zip(decoded, texts, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED + more)


def encode(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """ENCODED: sampled pieces of whole texts, a row per row of ``docs``, keyed by doc_id.

    Null and empty texts have no pieces; a null doc_id keys like 0. Rows of
    equal doc_id and text are cut alike. Characters without a piece, the
    model's space mark among them, become byte pieces, so decode() restores
    every text. Other columns are ignored.
    """
    return _encoded(docs, model, alpha, back=False)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The columns of ``encoded`` and decoded string, from its column piece_ids; null ids decode to an empty text.

    A column of ``encoded`` that is called decoded is replaced.
    """
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("piece_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, ALPHA)
        for batch in batches:
            for part in slices(batch, "piece_ids", rows=500, size=BATCH_BYTES // 4):
                texts = []
                for k in range(part.num_rows):
                    own = part.column(at)[k].values
                    texts.append(join(own.to_numpy(zero_copy_only=False), vocab).decode() if own is not None else "")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """encode() with decoded_sha256, made from the piece ids alone, and lossless, whether the decoded bytes are those of the text."""
    return _encoded(docs, model, alpha, back=True)
