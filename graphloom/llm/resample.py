"""Importance resampling towards a target distribution.

An untrained Regex Split of tokenizers cuts ASCII-lowered text into words with
offsets. Windows of consecutive offset pairs are the features; each falls into
a bucket by the CRC32 of its bytes. A bucket's gain is the log-ratio of its
smoothed share in the target and in the source, a document's weight the mean
gain of its features. Weights plus Gumbel noise, which hangs on the id alone,
make drawing the highest scores a draw without replacement.

Texts are cut once: what is kept of a document are its bucket numbers. What
meets on the driver are two histograms of BUCKETS rows, whatever the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from graphloom.llm.text import as_bytes, slices
from graphloom.operators.ordering import with_position
from graphloom.storage import Scratch

#: What stands between words: ASCII but digits and a-z (capitals are lowered before).
_OUTSIDE = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
BUCKETS = 10_000
#: Words of the shortest and longest window.
SHORTEST, LONGEST = 1, 1
#: Share drawn, in percent, of documents with at least MIN_WORDS words; the seed of the noise.
PERCENT, MIN_WORDS, SEED = 10, 20, 2024
#: Characters that are cut into words at once; longer texts go in pieces, cut between words.
PIECE = 1 << 18
#: Bucket numbers of features that a worker keeps.
KNOWN = 200_000

_GAP = re.compile(f"[{_OUTSIDE}]")
COUNTED = "doc_id long, n_words long, buckets binary"


@lru_cache(1)
def _cutter() -> pre_tokenizers.PreTokenizer:
    return pre_tokenizers.Split(Regex(f"[^{_OUTSIDE}]+"), "removed", invert=True)


def split_words(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(word, (start, end)) in code points of the lowered text, in order."""
    cutter, start = _cutter(), 0
    while start < len(text):
        gap = _GAP.search(text, start + PIECE) if len(text) - start > PIECE else None
        end = gap.start() if gap else len(text)
        for word, (a, b) in cutter.pre_tokenize_str(text[start:end] if start or gap else text):
            yield word, (start + a, start + b)
        start = end


class _Numbers(dict):
    """Bucket numbers by feature."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucket_numbers(text: bytes | None, numbers: _Numbers, shortest: int, longest: int) -> tuple[int, np.ndarray]:
    """(words, bucket number of each feature); windows of one length after those of another."""
    words = [word for word, _ in split_words(text.lower().decode())] if text else []
    found = [] if shortest > 1 else [numbers[w] for w in words]
    for n in range(max(2, shortest), longest + 1):
        found += [numbers[" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
    return len(words), np.array(found, _kind(numbers.buckets))


def featured(docs: DataFrame, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """COUNTED, a row per row of ``docs`` (doc_id and text are read): the words and the bucket number of every feature.

    Null, empty and wordless texts have no words and no features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(buckets)
        for batch in batches:
            for part in slices(batch):
                rows = [bucket_numbers(x, numbers, shortest, longest) for x in as_bytes(part.column(1))]
                columns = [part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([x.tobytes() for _, x in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COUNTED)


def histogram(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: one row a bucket and task is shuffled, BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(data, _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, a bucket each."""
    buckets = len(source)
    all_source, all_target = float(source.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a row's features, 0 without any."""
    kind = _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
            weights = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in found]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return counted.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from sha256 of ``seed:doc_id``; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank, all long: a row per row of ``docs``.

    ``docs`` needs doc_id and text, ``target`` text; other columns aren't read.
    Of the N rows with min_words words, floor(percent N / 100) with the highest
    scores are drawn, ties to the smaller doc_id (null ids first, then fewer
    features, then the smaller weight); their rank counts from 1, all others
    have none. Null and empty texts have no features, weight 0 and aren't
    drawn. Repeated rows count, and are ranked, each. Without documents the
    result is empty; without a target all its shares are the smoothed ones.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    counted = scratch.keep(featured(docs, buckets, shortest, longest), "counted")
    aims = featured(target.select(F.lit(0).alias("doc_id"), "text"), buckets, shortest, longest)
    gain = gains(histogram(counted, buckets), histogram(aims, buckets))
    scored = scratch.keep(weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop("counted")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    ranked = with_position(scored.where(able), [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")], scratch, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
