"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts word classes: the most frequent words have one each, others
share one by their last two bytes. The context's class vectors, each scaled by
its place, sum to a prediction; its products with all output vectors, plus
biases, give the normalised class probabilities. Within a class of several
words, a word has probability (c + 1) / (N + V + 1) from the class's own
training counts, of which one share is left for unseen words.

Counts come from all training documents by aggregation. For training, texts
become a byte of class a token; equal rows are counted first and weigh by their
number. Rows are dealt to shards by hash, ordered within them, and each shard
trains by noise-contrastive estimation from the same start; the parameters are
averaged, weighted by tokens. The number of shards follows the tokens, so the
result doesn't depend on how the table is split. What the driver gets is
bounded: CLASSES vectors and the counts of HOT words. Counts of all other words
stay distributed and are joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices, words
from graphloom.storage import Scratch

#: Classes: HEAD frequent tokens of their own, then endings, the last for all other words.
CLASSES, HEAD = 256, 192
#: Classes of context, size of vectors, noise draws shared by the tokens of a step, tokens of a step.
CONTEXT, SIZE, NOISE, STEP = 3, 24, 32, 4096
RATE, ROUNDS = 0.05, 1
#: Words whose counts are held by each task; the others' are joined. Longer words are never held.
HOT, HOT_BYTES = 100_000, 64
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000
#: Tokens of a shard; with fewer than SHARDS of these, SHARDS smaller ones of at least LEAST tokens.
SHARD_TOKENS, SHARDS, LEAST = 1 << 24, 32, 1 << 19
#: Parameter sets that one task adds up.
FAN_IN = 64
#: The end token; no word is empty.
TEXT_END = b""


def held_out(doc_id: Column) -> Column:
    """Documents not learnt from: crc32 of doc_id as text, modulo 7, is 2. Null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): counts of all tokens of the given documents, the end token (empty) among them.

    A null or empty text is the end token alone; repeated rows count each; without rows there are no counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in as_bytes(part.column(1)):
                    counts.update(words(text))
                    counts[TEXT_END] += 1
                if len(counts) > HELD:
                    yield passed(counts)
                    counts = Counter()
        yield passed(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Or(dict):
    """A dict that gives ``missing`` for other keys without storing them."""

    def __init__(self, items, missing: int):
        super().__init__(items)
        self.missing = missing

    def __missing__(self, key):
        return self.missing


@dataclass
class Lexicon:
    """Hot words with their counts, endings with classes, and the totals of classes."""

    hot: list[tuple[bytes, int]]
    endings: list[bytes]
    tokens: int
    types: int
    class_tokens: np.ndarray
    class_types: np.ndarray

    def ready(self) -> Lexicon:
        self.index = _Or(((w, k) for k, (w, _) in enumerate(self.hot)), -1)
        self.ending = _Or(((e, HEAD + k) for k, e in enumerate(self.endings)), CLASSES - 1)
        self.classes = np.array([k if k < HEAD else self.ending[w[-2:]] for k, (w, _) in enumerate(self.hot)], np.int64)
        self.log_counts = np.log10(np.array([n for _, n in self.hot], np.float64) + 1)
        self.end_class = self.class_of(TEXT_END)
        several = np.arange(CLASSES) >= HEAD
        self.log_room = np.where(several, np.log10(self.class_tokens + self.class_types + 1.0), 0.0)
        return self

    def class_of(self, word: bytes) -> int:
        k = self.index[word]
        return int(self.classes[k]) if k >= 0 else self.ending[word[-2:]]

    def sequence(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hot index (-1: none) and class of each word."""
        index = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        classes = self.classes[index] if len(self.hot) else np.full(len(found), CLASSES - 1)
        for k in np.flatnonzero(index < 0).tolist():
            classes[k] = self.ending[found[k][-2:]]
        return index, classes


def without(counts: DataFrame, hot: list[tuple[bytes, int]]) -> DataFrame:
    """The counts of all words but the hot ones, of which there are HOT at most, HOT_BYTES each."""
    if not hot:
        return counts
    own = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in hot], "word binary")
    return counts.join(F.broadcast(own), "word", "left_anti")


def lexicon(counts: DataFrame) -> Lexicon:
    """The most frequent words and endings, and totals of all counts.

    The driver gets HOT words at most: those above a count that a histogram of
    counts gives, so that no task sends words that don't stay.
    """
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    short = counts.where(F.octet_length("word") <= HOT_BYTES)
    histogram = short.groupBy(F.when(F.col("n") < 1024, F.col("n")).otherwise(F.floor(F.log2("n") * 128)).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("n")).collect()
    least, room = None, HOT
    for row in sorted(histogram, key=lambda r: -r.n):
        room -= row.words
        if room < 0:
            break
        least = row.n
    hot = sorted(((bytes(r.word), r.n) for r in short.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0])) if least is not None else []
    tail = without(counts, hot[:HEAD]).groupBy(F.expr("right(hex(word), 4)").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    tail.sort(key=lambda r: (-r.n, r.ending))
    named = tail[: CLASSES - HEAD - 1]
    class_tokens, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (_, n) in enumerate(hot[:HEAD]):
        class_tokens[k], class_types[k] = n, 1
    for k, row in enumerate(tail):
        at = min(HEAD + k, CLASSES - 1)
        class_tokens[at] += row.n
        class_types[at] += row.types
    return Lexicon(hot, [bytes.fromhex(r.ending) for r in named], total.n or 0, total.types, class_tokens, class_types)


def start(lex: Lexicon, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training: small random vectors, biases at the log class frequencies."""
    draw = np.random.default_rng(seed)
    share = (lex.class_tokens + 1) / (lex.class_tokens + 1).sum()
    return {
        "context": draw.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32),
        "output": draw.normal(0, 0.1, (CLASSES, SIZE)).astype(np.float32),
        "place": np.full((CONTEXT, SIZE), 1 / CONTEXT, np.float32),
        "bias": np.log(share).astype(np.float32),
    }


def _rows_sum(index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    flat = (index[:, None] * SIZE + np.arange(SIZE)).ravel()
    return np.bincount(flat, rows.ravel(), CLASSES * SIZE).reshape(CLASSES, SIZE).astype(np.float32)


class Trainer:
    """Noise-contrastive steps with Adagrad; noise is drawn from the class frequencies."""

    def __init__(self, params: dict[str, np.ndarray], lex: Lexicon, seed: int):
        self.p = {k: v.copy() for k, v in params.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        share = (lex.class_tokens + 1) / (lex.class_tokens + 1).sum()
        self.noise_at = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.draw = np.random.default_rng(seed)
        self.tokens = self.steps = 0

    def size(self) -> int:
        """Tokens of the next step: few at first, STEP later on."""
        return min(STEP, STEP // 16 * (1 + self.steps // 16))

    def step(self, context: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """context (n, CONTEXT) and target (n) classes, each counted ``weight`` times."""
        p, n = self.p, weight.sum()
        context, target = context.astype(np.int64), target.astype(np.int64)
        vectors = p["context"][context]
        guess = (vectors * p["place"]).sum(axis=1)
        noise = np.minimum(np.searchsorted(self.noise_at, self.draw.random(NOISE)), CLASSES - 1)
        own = (guess * p["output"][target]).sum(axis=1) + p["bias"][target] - self.log_noise[target]
        other = guess @ p["output"][noise].T + (p["bias"][noise] - self.log_noise[noise])
        g_own = -weight / (1 + np.exp(np.clip(own, -30, 30)))
        g_other = weight[:, None] / (1 + np.exp(-np.clip(other, -30, 30)))
        g_guess = g_own[:, None] * p["output"][target] + g_other @ p["output"][noise]
        output = _rows_sum(target, g_own[:, None] * guess)
        np.add.at(output, noise, g_other.T @ guess)
        bias = np.bincount(target, g_own, CLASSES)
        np.add.at(bias, noise, g_other.sum(axis=0))
        context_sum = sum(_rows_sum(context[:, k], g_guess * p["place"][k]) for k in range(CONTEXT))
        place = np.stack([(g_guess * vectors[:, k]).sum(axis=0) for k in range(CONTEXT)])
        for name, gradient in (("output", output), ("bias", bias), ("context", context_sum), ("place", place)):
            gradient = (gradient / n).astype(np.float32)
            self.squares[name] += gradient * gradient
            self.p[name] -= RATE * gradient / np.sqrt(self.squares[name])
        self.tokens += len(target)
        self.steps += 1


def windows(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and targets of texts, each with the end token after it and CONTEXT of them before it."""
    pad = np.full(CONTEXT, end, sequences[0].dtype)
    parts = [x for s in sequences for x in (pad, s, pad[:1])]
    joined = np.concatenate(parts)
    sizes = np.array([len(s) + 1 for s in sequences])
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1) * CONTEXT, sizes)
    return np.stack([joined[at - CONTEXT + k] for k in range(CONTEXT)], axis=1), joined[at]


_NAMES = ("context", "output", "place", "bias")


def _pack(params: dict[str, np.ndarray], weight: float) -> bytes:
    return (np.concatenate([*(params[k].ravel().astype(np.float64) for k in _NAMES), np.ones(1)]) * weight).tobytes()


def _unpack(total: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at, weight = {}, 0, total[-1]
    for k in _NAMES:
        out[k] = (total[at : at + like[k].size] / weight).reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for data in batch.column(0).to_pylist():
            own = np.frombuffer(data)
            total = own.copy() if total is None else total + own
    yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["params"])


def shards(tokens: int) -> int:
    """The number of shards for so many training tokens."""
    return max(-(-tokens // SHARD_TOKENS), min(SHARDS, -(-tokens // LEAST)), 1)


def class_rows(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(doc_id, classes binary, times): the class of each token in a byte, and how many rows are so."""
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        lex.ready()
        for batch in batches:
            for part in slices(batch):
                classes = [lex.sequence(words(x))[1].astype(np.uint8).tobytes() for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(classes, pa.binary())], names=["doc_id", "classes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, classes binary")
    return rows.groupBy("doc_id", "classes").agg(F.count("*").alias("times"))


def train(docs: DataFrame, lex: Lexicon, scratch: Scratch) -> dict[str, np.ndarray]:
    """The averaged parameters after ROUNDS over all given documents."""
    spark = docs.sparkSession
    params = start(lex)
    rows = class_rows(docs, lex).repartition(shards(lex.tokens), "doc_id", "classes").sortWithinPartitions("doc_id", "classes")
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((lex, params))

        def run(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            lex, params = held.value
            lex.ready()
            trainer = None
            for batch in batches:
                for part in slices(batch, "classes", rows=500, size=1 << 18):
                    rows = part.column(1).to_pylist()
                    if trainer is None:
                        trainer = Trainer(params, lex, zlib.crc32(rows[0], turn))
                    context, target = windows([np.frombuffer(x, np.uint8) for x in rows], lex.end_class)
                    weight = np.repeat(part.column(2).to_numpy().astype(np.float32), [len(x) + 1 for x in rows])
                    order = trainer.draw.permutation(len(target))
                    at = 0
                    while at < len(order):
                        own = order[at : at + trainer.size()]
                        trainer.step(context[own], target[own], weight[own])
                        at += len(own)
            sets = [_pack(trainer.p, trainer.tokens)] if trainer else []
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary())], names=["params"])

        sets = scratch.keep(rows.mapInArrow(run, "params binary"), f"sets-{turn}")
        level, n = 0, sets.count()
        while n > FAN_IN:
            sets = scratch.keep(sets.repartition(math.ceil(n / FAN_IN)).mapInArrow(_added, "params binary"), f"sets-{turn}-{level}")
            level, n = level + 1, sets.count()
        found = sorted(bytes(r.params) for r in sets.collect())
        if found:
            params = _unpack(sum(np.frombuffer(r) for r in found), params)
    return params


def log_probabilities(params: dict[str, np.ndarray], context: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of all classes after each context, as (n, CLASSES)."""
    guess = (params["context"][context] * params["place"]).sum(axis=1)
    logits = guess @ params["output"].T + params["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def class_scores(params: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 probability of each target class; equal contexts are computed once, a block at a time."""
    packed = np.zeros(len(target), np.int64)
    for k in range(CONTEXT):
        packed = packed * CLASSES + context[:, k]
    order = np.argsort(packed, kind="stable")
    fresh = np.flatnonzero(np.diff(packed[order], prepend=-1))
    which = np.empty(len(target), np.int64)
    which[order] = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(order))))
    unique, out = context[order[fresh]], np.empty(len(target))
    by_block = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[by_block], np.arange(0, len(fresh) + STEP, STEP))
    for block in range(len(bounds) - 1):
        own = by_block[bounds[block] : bounds[block + 1]]
        table = log_probabilities(params, unique[block * STEP : (block + 1) * STEP])
        out[own] = table[which[own] - block * STEP, target[own]]
    return out / math.log(10)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, log_model double, rare array<struct<word: binary, n: long>>"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    Tokens are words with A-Z lower-cased and an end token; null and empty
    texts are the end token alone. base_score is the unigram score with one
    added to each count. Repeated rows have a result each; in an empty table,
    or without training documents, counts are zero and no row fails.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("held_out", held_out(F.col("doc_id")))
    training = texts.where(~F.col("held_out"))
    counts = scratch.keep(count_words(training), "counts")
    lex = lexicon(counts)
    params = train(training, lex, scratch)
    held = spark.sparkContext.broadcast((lex, params))
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, params = held.value
        lex.ready()
        end = lex.index[TEXT_END]
        for batch in batches:
            for part in slices(batch, rows=1000):
                n_tokens, known, log_counts, log_room, rare, sequences = [], [], [], [], [], []
                for text in as_bytes(part.column(1)):
                    found = words(text)
                    index, classes = lex.sequence(found)
                    hot = index >= 0
                    several = lex.classes[index[hot]] >= HEAD if len(lex.hot) else hot[hot]
                    logs = lex.log_counts[index[hot]] if len(lex.hot) else np.zeros(0)
                    ends = lex.log_counts[end] if end >= 0 else 0.0
                    n_tokens.append(len(found) + 1)
                    known.append(int(hot.sum()) + (end >= 0))
                    log_counts.append(float(logs.sum()) + ends)
                    log_room.append(float(logs[several].sum()) + (ends if end >= HEAD else 0.0) - float(lex.log_room[classes].sum()) - lex.log_room[lex.end_class])
                    rare.append([{"word": w, "n": n} for w, n in Counter(found[k] for k in np.flatnonzero(~hot).tolist()).items()])
                    sequences.append(classes)
                own = class_scores(params, *windows(sequences, lex.end_class))
                starts = np.cumsum(n_tokens) - n_tokens
                model = np.add.reduceat(own, starts) + np.array(log_room)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(log_counts, pa.float64()), pa.array(model), pa.array(rare, kind)],
                    names=[x.split()[0] for x in SCORED.split(", ")[:6]] + ["rare"],
                )

    found = texts.mapInArrow(run, SCORED).withColumn("row", F.monotonically_increasing_id())
    found = scratch.keep(found, "found")
    others = without(counts, lex.hot)
    each = found.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rest = each.join(others, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    joined = found.drop("rare").join(rest, "row", "left")
    more = F.coalesce("more_log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more - F.col("n_tokens") * math.log10(lex.tokens + lex.types + 1)).alias("base_score"),
        (F.col("log_model") + more).alias("score"),
    )
