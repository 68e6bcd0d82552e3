"""Runs of repeated words, found on a grammar of the text.

A run is a stretch of words that repeats with a period, at least twice and over
MIN_LENGTH words, and can't be extended. Half of a run, MIN_LENGTH / 2 words at
least, stands in it twice, and such windows cover it, so the words that no
repeated window covers are left aside as they are; what stays are stretches,
and each run lies in one of them.

Re-Pair turns the word ids of the stretches into a grammar: pairs of symbols
that occur again become nonterminals, those of most frequent pairs first, in
rounds, as pairs that don't overlap can be replaced at once. For each
nonterminal, the runs across the boundary of its two halves are found once. A
run is found whole at the smallest nonterminal around it; from there it is
carried to all positions of the derivation, and pieces that their surroundings
extend are parts of a longer one and go.

Memory grows with a slice of texts, or the longest text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, mix, odd_weights, slices, window_hashes

#: Words of the shortest run that counts.
MIN_LENGTH = 12
#: Pairs (nonterminal, period) that are looked at together.
TOGETHER = 1 << 20

_SPACES = r"[\x20\x09-\x0D]+"
RESULT = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def stretches(hashes: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the stretches, in all texts' words, that windows repeated within their text cover; last exclusive."""
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    keys = mix(window_hashes(hashes, odd_weights(window, 12)) + owner[: len(hashes) - window + 1] * odd_weights(1, 13))
    whole = np.flatnonzero(owner[: len(keys)] == owner[window - 1 :])
    order = whole[np.argsort(keys[whole])]
    same = keys[order[1:]] == keys[order[:-1]]
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    change = np.zeros(len(hashes) + 1, np.int64)
    change[again] += 1
    np.subtract.at(change, again + window, 1)
    covered = np.cumsum(change[:-1]) > 0
    edge = np.concatenate([[True], (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1]), [True]])
    ends = np.flatnonzero(edge)
    first, last = ends[:-1], ends[1:]
    kept = covered[first] & (last - first >= 2 * window)
    return first[kept], last[kept]


class Grammar:
    """Re-Pair of several stretches at once: rules, lengths, a place of each symbol, a root a stretch.

    Symbols below ``words`` are words; the others have a left and a right part,
    made before themselves. ``rounds`` are the bounds of what each round made.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        self.words = int(text.max(initial=-1)) + 1
        self.left = self.right = self.place = np.empty(0, np.int64)
        self.length = np.ones(self.words, np.int64)
        self.rounds = [self.words]
        self._known = self._symbol = np.empty(0, np.int64)
        self.seq, self.at, self.part = text.astype(np.int64), np.arange(len(text)), np.repeat(np.arange(len(sizes)), sizes)
        while self._round():
            pass
        while len(self.seq) > len(sizes):
            start = np.flatnonzero(np.concatenate([[True], self.part[1:] != self.part[:-1]]))
            offset = np.arange(len(self.seq)) - np.repeat(start, np.diff(np.append(start, len(self.seq))))
            self._replace(np.flatnonzero((offset[:-1] % 2 == 0) & (self.part[1:] == self.part[:-1])))

    def _pairs(self, where: np.ndarray) -> np.ndarray:
        return self.seq[where] << 32 | self.seq[where + 1]

    def _round(self) -> bool:
        """Replaces occurrences of repeated pairs that no better pair overlaps; False where no pair is repeated."""
        joined = self.part[1:] == self.part[:-1]
        equal = joined & (self.seq[1:] == self.seq[:-1])
        # Within equal symbols, pairs at even offsets from the first one are taken.
        at = np.arange(len(equal))
        begin = np.maximum.accumulate(np.where(equal & ~np.concatenate([[False], equal[:-1]]), at, 0)) if len(at) else at
        where = np.flatnonzero(joined & ~(equal & ((at - begin) % 2 == 1)))
        kinds, inverse, count = np.unique(self._pairs(where), return_inverse=True, return_counts=True)
        good = (count > 1) | np.isin(kinds, self._known)
        if not good.any():
            return False
        # Pairs about as frequent are in a fixed, scattered order, so that many occurrences are better than both neighbours.
        order = np.lexsort((mix(kinds.astype(np.uint64)), np.frexp(count.astype(float))[1]))
        value = np.empty(len(kinds), np.int64)
        value[order] = np.arange(1, len(kinds) + 1)
        worth = np.zeros(len(self.seq) + 1, np.int64)
        worth[where + 1] = np.where(good, value, 0)[inverse]
        own = worth[1:-1]
        self._replace(np.flatnonzero((own > worth[:-2]) & (own > worth[2:])))
        return True

    def _replace(self, where: np.ndarray) -> None:
        kinds, first, inverse = np.unique(self._pairs(where), return_index=True, return_inverse=True)
        new = np.flatnonzero(~np.isin(kinds, self._known))
        symbols = self.rounds[-1] + np.arange(len(new))
        left, right = kinds[new] >> 32, kinds[new] & 0xFFFFFFFF
        self.left, self.right = np.append(self.left, left), np.append(self.right, right)
        self.place = np.append(self.place, self.at[where[first[new]]])
        self.length = np.append(self.length, self.length[left] + self.length[right])
        self.rounds.append(self.rounds[-1] + len(new))
        known, symbol = np.append(self._known, kinds[new]), np.append(self._symbol, symbols)
        order = np.argsort(known)
        self._known, self._symbol = known[order], symbol[order]
        self.seq[where] = self._symbol[np.searchsorted(self._known, kinds)][inverse]
        kept = np.ones(len(self.seq), bool)
        kept[where + 1] = False
        self.seq, self.at, self.part = self.seq[kept], self.at[kept], self.part[kept]


class Extensions:
    """How far two places of a text agree, by names of windows of 1, 2, 4 and more words."""

    def __init__(self, text: np.ndarray, longest: int):
        self.names = [text.astype(np.int32)]
        while 2 << len(self.names) <= longest:
            last, half = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            names = np.unique(last[:-half] << 32 | last[half:], return_inverse=True)[1]
            self.names.append(names.astype(np.int32))

    def reach(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
        """Words from a and b on (step 1) or before them (step -1) that agree, up to the limit."""
        done = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            width, names = 1 << k, self.names[k]
            again = True
            while again:  # the widest windows may fit several times, narrower ones once
                fit = np.flatnonzero(done + width <= limit)
                shift = done[fit] if step > 0 else -done[fit] - width
                fit = fit[names[a[fit] + shift] == names[b[fit] + shift]]
                done[fit] += width
                again = len(fit) > 0 and k == len(self.names) - 1
        return done


def crossing(text: np.ndarray, grammar: Grammar, least: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the runs across each rule's boundary, within the rule; sorted by rule."""
    lengths = grammar.length[grammar.words :]
    rules = np.flatnonzero(lengths >= least)
    reach = Extensions(text, int(lengths.max(initial=1)))
    half = (least // 2 + 1) // 2
    grams = np.unique(window_hashes(mix(text.astype(np.uint64)), odd_weights(half, 14)), return_inverse=True)[1] if len(text) >= half else text
    found = [np.empty((0, 4), np.int64)]
    total = np.cumsum(lengths[rules])
    for own in np.split(rules, np.flatnonzero(np.diff(total // TOGETHER)) + 1) if len(rules) else []:
        low = grammar.place[own]
        high, middle = low + lengths[own], low + grammar.length[grammar.left[own]]
        for right in (True, False):
            n = high - middle if right else middle - low
            pick = np.repeat(np.arange(len(own)), n)
            period = np.arange(len(pick)) - np.repeat(np.cumsum(n) - n, n) + 1
            begin, end, a = low[pick], high[pick], middle[pick] - (0 if right else period)
            # Of the words that agree, half stand before or after the place.
            ahead = np.flatnonzero(a + period + half <= end)
            back = np.flatnonzero(a - half >= begin)
            near = np.zeros(len(pick), bool)
            near[ahead[grams[a[ahead]] == grams[a[ahead] + period[ahead]]]] = True
            near[back[grams[a[back] - half] == grams[a[back] - half + period[back]]]] = True
            pick, period, begin, end, a = (x[near] for x in (pick, period, begin, end, a))
            after = reach.reach(a, a + period, end - a - period, 1)
            before = reach.reach(a, a + period, a - begin, -1)
            whole = (after + before >= period) & (after + before + period >= least)
            found.append(np.stack([own[pick], a - before - begin, a + after + period - begin, period], 1)[whole])
    every = np.concatenate(found)
    every = every[np.lexsort(every.T[::-1])]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :3] != every[:-1, :3]).any(1)
    return tuple(every[first].T)


def runs_of(text: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period), sorted, of all maximal runs of the stretches of word ids."""
    if not len(text):
        return np.empty((0, 3), np.int64)
    grammar = Grammar(text, sizes)
    rule, start, end, period = crossing(text, grammar, least)
    bounds = np.searchsorted(rule, np.arange(len(grammar.left) + 1))
    useful = np.concatenate([np.zeros(grammar.words, bool), np.diff(bounds) > 0])
    for low, high in zip(grammar.rounds[:-1], grammar.rounds[1:], strict=True):
        own = np.arange(low, high) - grammar.words
        useful[low:high] |= useful[grammar.left[own]] | useful[grammar.right[own]]
    last = np.cumsum(sizes)
    border_low, border_high = np.repeat(last - sizes, sizes), np.repeat(last, sizes)
    found = [np.empty((0, 3), np.int64)]
    symbol, at = grammar.seq, grammar.at
    while len(symbol):
        kept = useful[symbol]
        own, at = symbol[kept] - grammar.words, at[kept]
        count = bounds[own + 1] - bounds[own]
        pick = np.repeat(bounds[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        base = np.repeat(at, count)
        s, e, q = base + start[pick], base + end[pick], period[pick]
        longer = np.zeros(len(s), bool)
        before, after = np.flatnonzero(s > border_low[s]), np.flatnonzero(e < border_high[s])
        longer[before] |= text[s[before] - 1] == text[s[before] - 1 + q[before]]
        longer[after] |= text[e[after]] == text[e[after] - q[after]]
        found.append(np.stack([s, e - s, q], 1)[~longer])
        symbol, at = np.concatenate([grammar.left[own], grammar.right[own]]), np.concatenate([at, at + grammar.length[grammar.left[own]]])
    return np.unique(np.concatenate(found), axis=0)


def find_runs(texts: list[list[bytes]], least: int = MIN_LENGTH) -> list[np.ndarray]:
    """For each list of words, rows (start, length, period) of its runs by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    ends = np.cumsum(sizes)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for w in texts for x in w), np.uint64, int(sizes.sum()))
    first, last = stretches(hashes, sizes, least // 2)
    owner = np.searchsorted(ends, first, "right")
    starts = (ends - sizes)[owner]
    ids: dict[bytes, int] = {}
    text = np.array([ids.setdefault(x, len(ids)) for k, a, b in zip(owner.tolist(), (first - starts).tolist(), (last - starts).tolist(), strict=True) for x in texts[k][a:b]], np.int64)
    rows = runs_of(text, last - first, least)
    begun = np.cumsum(last - first) - (last - first)
    stretch = np.searchsorted(begun, rows[:, 0], "right") - 1
    rows[:, 0] += (first - starts - begun)[stretch]
    cuts = np.searchsorted(owner[stretch], np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(change, runs[:, 0] + runs[:, 1], 1)
    return b" ".join(compress(words, np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """RESULT, a row per row of ``docs`` (doc_id and text are read).

    Words are stretches without ASCII white space, numbered from 0; runs come by
    start, then period, and have at least ``least`` words, an even number.
    ``collapsed`` is the text with single spaces and each run cut to its first
    period. Null, empty and blank texts have no runs and an empty collapsed
    text; repeated rows and null ids have a row each.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [(x or b"").split() for x in as_bytes(part.column(1))]
                found = find_runs(texts, least)
                offsets = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found)
                rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], fields=list(kind.value_type)))
                short = pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), rows, short.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts of every tenth id, by its CRC32, go over into a repetition of their own words.

    With g the tenth of the CRC and n words, word i from a = g % n on is word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). All other texts, those of
    null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", _SPACES), lambda w: w != "")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.element_at(w, (a + (i - a) % p + 1).cast("int"))).otherwise(x)), " ")

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The words are made once, as an element of an array: what a lambda takes from outside is computed again for each word.
    made = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w))), 1)
    return own.select("doc_id", F.coalesce(F.when(h % 10 == 0, made), F.col("text")).alias("text"))


def run_digest(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """periodic_runs() with its longest run (ties: smallest start, then period) as columns and digests of all runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return periodic_runs(docs, least).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / (-best["period"])).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
