"""Quality classifier by positive-unlabelled learning.

A logistic model over rates of byte classes and their bigrams minimises the
non-negative unbiased risk: with prior p, trusted positives P and unlabelled
texts U,  p * R_P(+) + max(0, R_U(-) - p * R_P(-)). The prior is estimated from
positives and unlabelled texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices
from graphloom.storage import Scratch

#: Most trusted positives and unlabelled texts that the model is fitted on: those of the smallest hash of doc_id.
MAX_POSITIVES = 8_000
MAX_UNLABELLED = 16_000
#: A document is accepted from this score on.
ACCEPT = 0.7
STEPS = 400

#: Byte classes, as text; other bytes below 128 form one more class, those above another.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "'\"`", "-_", ":;", "*#$%&@^~+=", "|/\\", "()[]{}<>")
_N = len(CLASSES) + 2
_CLASS = np.array([next((k for k, chars in enumerate(CLASSES) if chr(b) in chars), _N - 1 if b > 127 else _N - 2) for b in range(256)], np.int64)
FEATURES = _N * _N + _N + 1
STEP = 1 << 20


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of square-rooted rates per text: classes, class bigrams, and the log of its length.

    A null or empty text has zeros throughout. Long texts are counted in steps of STEP bytes.
    """
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        singles, pairs = np.zeros(_N, np.int64), np.zeros(_N * _N, np.int64)
        for start in range(0, len(text), STEP):
            classes = _CLASS[np.frombuffer(text[max(0, start - 1) : start + STEP], np.uint8)]
            pairs += np.bincount(classes[:-1] * _N + classes[1:], minlength=_N * _N)
            singles += np.bincount(classes[start > 0 :], minlength=_N)
        row[:-1] = np.sqrt(np.concatenate([singles, pairs]) / len(text))
        row[-1] = np.log1p(len(text)) / 10
    return out


@dataclass
class Model:
    """score = sigmoid((features - mean) / scale @ weights + bias)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def decide(self, rows: np.ndarray) -> np.ndarray:
        """The logit of each row, summed row by row, so that equal rows have equal ones in any company."""
        return (np.clip((rows - self.mean) / self.scale, -10, 10).astype(np.float64) * self.weights).sum(axis=1) + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return _sigmoid(self.decide(features(texts)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def pu_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of positives, risk of negatives before it is kept from falling below 0) of the logistic loss."""
    return prior * np.logaddexp(0, -z_p).mean(), np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()


def pu_slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The slopes of the step to take by each z.

    Where the risk of negatives is below 0 the step climbs it alone, as the
    non-negative estimator prescribes; else it descends the sum of both.
    """
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    negative_p, negative_u = -prior * s_p / len(z_p), s_u / len(z_u)
    if pu_risk(z_p, z_u, prior)[1] < 0:
        return -negative_p, -negative_u
    return prior * (s_p - 1) / len(z_p) + negative_p, negative_u


def apart_slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the plain logistic loss that tells the two sets apart, each of weight one."""
    return (_sigmoid(z_p) - 1) / len(z_p), _sigmoid(z_u) / len(z_u)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, slopes=pu_slopes, steps: int = STEPS, rate: float = 0.03, ridge: float = 1e-3) -> Model:
    """A linear model by Adam, by default of the non-negative PU risk. Without rows of both kinds every score is the prior."""
    prior = float(np.clip(prior, 0.01, 0.99))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(prior / (1 - prior))))
    mean = unlabelled.mean(axis=0)
    scale = np.maximum(unlabelled.std(axis=0), 1e-3)
    p, u = (np.clip((x - mean) / scale, -10, 10) for x in (positive, unlabelled))
    w, bias = np.zeros(FEATURES), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, steps + 1):
        at_p, at_u = slopes(p @ w + bias, u @ w + bias, prior)
        g = np.append(p.T @ at_p + u.T @ at_u + ridge * w, at_p.sum() + at_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(mean, scale, w, float(bias))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, by the best bin of a classifier that tells the two sets apart.

    It is fitted on every other row; the rest is scored. Above any score t,
    share_U(t) / share_P(t) is the prior or more, and the prior itself where
    nothing but positives scores so high. Of all t, the one with the least upper
    confidence bound of that ratio is taken. Without rows it is a half.
    """
    p, u = positive[1::2], unlabelled[1::2]
    if not len(p) or not len(u):
        return 0.5
    apart = fit(positive[::2], unlabelled[::2], 0.5, apart_slopes)
    p, u = np.sort(apart.decide(p)), np.sort(apart.decide(u))
    share_p, share_u = 1 - np.arange(len(p)) / len(p), 1 - np.searchsorted(u, p) / len(u)
    slack = np.sqrt(np.log(4 / 0.1) / 2 / len(u)) + np.sqrt(np.log(4 / 0.1) / 2 / len(p))
    best = np.argmin(share_u / share_p + 1.01 * slack / share_p)
    return float(min(1.0, share_u[best] / share_p[best]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of doc_id as text, modulo 4, is 2. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """The ids of the smallest hashes; of many, only those that can be among them are sorted."""
    n, place = ids.count(), F.xxhash64("doc_id")
    if n > 4 * most:
        near = ids.where(place < int(2**64 * 2 * most / n) - 2**63)
        ids = near if near.count() >= most else ids
    return ids.select("doc_id").orderBy(place, "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on trusted positives (quality 1) and unlabelled documents of the training rows.

    The class prior is estimated from both (estimate_prior); labels of 0 are not
    learnt from, and a document labelled both 0 and 1 counts
    as labelled, but is no trusted positive. Null and empty texts count as any
    other; of the texts of a repeated doc_id one is taken.
    """
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = texts.select("doc_id", F.lit(1).alias("there"), F.lit(None).cast("int").alias("quality")).where(~held_out(F.col("doc_id")))
    marks = known.select("doc_id", F.lit(0).alias("there"), F.col("quality").cast("int").alias("quality"))
    each = Scratch(docs.sparkSession, "quality").keep(ids.unionByName(marks).groupBy("doc_id").agg(F.max("there").alias("there"), F.min("quality").alias("quality")).where("there = 1"), "ids")
    positive = _sample(each.where("quality = 1"), MAX_POSITIVES)
    unlabelled = _sample(each.where("quality is null"), MAX_UNLABELLED)
    chosen = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [x.tobytes() for x in features(as_bytes(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], names=["doc_id", "positive", "x"])

    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "positive").mapInArrow(run, "doc_id long, positive boolean, x binary").groupBy("doc_id", "positive").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    matrix = lambda flag: np.frombuffer(b"".join(r.x for r in rows if r.positive == flag), np.float32).reshape(-1, FEATURES)
    positive, unlabelled = matrix(True), matrix(False)
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``.

    A null text scores as an empty one, which has a score too; equal texts score
    alike, whatever their ids; null ids have a row each. An empty table has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(as_bytes(part.column(1))))], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model accepts, unchanged.

    Each row is judged by its own text, a null one as an empty one; repeated
    rows all stay or all go. An empty table stays one.
    """
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.scores(as_bytes(part.column(at).cast(pa.string()))) >= ACCEPT))

    return docs.mapInArrow(run, schema)
