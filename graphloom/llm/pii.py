"""Personal data by bootstrapped contextual extraction.

Patterns of characters find seed entities: e-mail addresses, IP addresses, card
and phone numbers. The words around an entity are its lexical patterns. Other
strings that look like identifiers, but that no character pattern accepts, are
candidates and have patterns too. Patterns and instances (the distinct values)
form a graph. In rounds, a pattern scores the share of its instances that are
known to be of a kind, and an instance scores as its surest accepted pattern;
instances of a sure pattern are known in the next round. Candidates whose
instance becomes known, and whose form allows the kind, are found by context.

The graph stays distributed: a row for each distinct pair of pattern and
instance, so copies of a text add nothing and no hot pattern meets in one row.

All matching is on UTF-8 bytes, as all patterns are ASCII; offsets are turned
into code points for the spans found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, slices
from graphloom.storage import Scratch

#: Base kinds in the order in which spans of one start are listed; found by context, they follow with a prefix.
KINDS = ("email", "ip", "card", "phone")
BY_CONTEXT = "context_"
#: A pattern is accepted with this many known instances and this share of all of its instances (plus one).
SUPPORT, PRECISION = 4, 0.8
ROUNDS = 3
#: Bytes on either side of an entity in which pattern words are looked for; words that reach out of them aren't taken.
REACH = 64
#: Bytes of the longest candidate; longer keys of instances are digests.
LONGEST = 254
#: Digits of candidates for numbers.
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(rb"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(rb"[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = bytes(ord("x") if chr(x) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-" else ord(" ") for x in range(256))
_NOT_DIGITS = bytes(x for x in range(256) if chr(x) not in "0123456789")
# What candidates look like: a host without a dot, groups of hexadecimal digits, numbers with other marks than cards and phones have.
_HOST = re.compile(rb"[A-Za-z0-9]++(?:[.-][A-Za-z0-9]++)*+")
_HEX_GROUPS = re.compile(rb"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![0-9A-Za-z:])")
_DIGIT_GROUPS = re.compile(rb"[+(]?[0-9]++(?:(?:\)\x20?|\x20\(|[\x20./:-])\(?[0-9]++)*+")
_TRIM = b".,;!?\"'()[]{}<>"


def _digits(data: bytes) -> bytes:
    return data.translate(None, _NOT_DIGITS)


def luhn(digits: bytes) -> bool:
    """The check of card numbers: every second digit from the right counts twice, by its cross sum."""
    own = [x - 48 for x in digits[::-1]]
    return (sum(own[::2]) + sum(2 * x - 9 * (x > 4) for x in own[1::2])) % 10 == 0


def _emails(data: bytes) -> Iterator[tuple[int, int]]:
    at, floor = data.find(b"@"), 0
    classes = data.translate(_LOCAL) if at >= 0 else b""
    while at >= 0:
        start = max(classes.rfind(b" ", floor, at) + 1, floor)
        if start < at and (m := _DOMAIN.match(data, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = data.find(b"@", floor)


def _ips(data: bytes) -> Iterator[tuple[int, int]]:
    for chain in _CHAIN.finditer(data):
        if chain[0].count(b".") >= 3:
            parts = [m.span() for m in _NUMBER.finditer(data, *chain.span())]
            for k in range(0, len(parts) - 3, 4):
                own = [data[a:b].lstrip(b"0") for a, b in parts[k : k + 4]]
                if all(len(x) < 3 or (len(x) == 3 and x <= b"255") for x in own):
                    yield parts[k][0], parts[k + 3][1]


def _cards(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(data):
        if m.end() - m.start() >= CARD_DIGITS[0] and CARD_DIGITS[0] <= len(own := _digits(m[0])) <= CARD_DIGITS[1] and luhn(own):
            yield m.span()


def _phones(data: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(data):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) in bytes, by start, then kind.

    Within a kind, matches are leftmost and don't overlap; those that fail
    their check still take their place.
    """
    return sorted((a, b, k) for k, find in enumerate((_emails, _ips, _cards, _phones)) for a, b in find(data))


def _free(spans: list[tuple], taken: list[tuple]) -> list[tuple]:
    """The spans, sorted, that overlap neither an earlier one nor one of those taken (sorted)."""
    kept, i, last = [], 0, 0
    for span in sorted(spans):
        while i < len(taken) and taken[i][1] <= span[0]:
            i += 1
        if span[0] >= last and not (i < len(taken) and taken[i][0] < span[1]):
            kept.append(span)
            last = span[1]
    return kept


def candidates(data: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kinds) in bytes of what looks like an identifier outside of the spans taken; kinds is a bit mask of what the form allows."""
    words, numbers, at, classes = [], [], data.find(b"@"), data.translate(_LOCAL)
    while at >= 0:
        start = classes.rfind(b" ", 0, at) + 1
        if start < at and (m := _HOST.match(data, at + 1)):
            words.append((start, m.end(), 1))
        at = data.find(b"@", at + 1)
    if b":" in data:
        words += [(*m.span(), 2) for m in _HEX_GROUPS.finditer(data)]
    for m in _DIGIT_GROUPS.finditer(data):
        alone = not data[max(0, m.start() - 1) : m.start()].isalnum() and not data[m.end() : m.end() + 1].isalnum()
        if alone and PHONE_DIGITS[0] <= m.end() - m.start():
            n = len(_digits(m[0]))
            numbers.append((*m.span(), 4 * (CARD_DIGITS[0] <= n <= CARD_DIGITS[1]) + 8 * (PHONE_DIGITS[0] <= n <= PHONE_DIGITS[1])))
    first = _free([x for x in words if x[1] - x[0] <= LONGEST], taken)
    return sorted(first + _free([x for x in numbers if x[2] and x[1] - x[0] <= LONGEST], sorted(taken + first)))


def _word(word: bytes) -> str:
    """Lower-cased, digits as zeros, without marks around it unless it is nothing else."""
    return _NUMBER.sub(b"0", word.lower().strip(_TRIM) or word).decode("utf-8", "replace")


def patterns(data: bytes, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, _ standing for it: two words before, one before, one on either side, two after."""
    before, after = data[max(0, start - REACH) : start], data[end : end + REACH]
    left, right = before.split(), after.split()
    if left and start > REACH and not before[:1].isspace() and not data[start - REACH - 1 : start - REACH].isspace():
        left = left[1:]
    if right and end + REACH < len(data) and not after[-1:].isspace() and not data[end + REACH : end + REACH + 1].isspace():
        right = right[:-1]
    left, right = [_word(x) for x in left[-2:]], [_word(x) for x in right[:2]]
    found = [f"{left[-1]} _"] if left else []
    found += [f"{left[0]} {left[1]} _"] if len(left) == 2 else []
    found += [f"_ {right[0]} {right[1]}"] if len(right) == 2 else []
    return found + ([f"{left[-1]} _ {right[0]}"] if left and right else [])


def instance(data: bytes, kinds: int) -> str:
    """What mentions of one identifier have in common: the digits of numbers, else the lower-cased value."""
    own = _digits(data) if kinds & 12 else data.lower()
    return own.decode() if len(own) <= LONGEST else sha256(own).hexdigest()


SPAN = "start: long, end: long, kind: int"
FOUND = f"doc_id long, base array<struct<{SPAN}>>, others array<struct<start: long, end: long, instance: string, kinds: int>>, links array<struct<pattern: string, instance: string, known: int, kinds: int>>"


def mentions(data: bytes | None) -> tuple[list, list, list]:
    """(base, others, links) of a text as FOUND has them: spans in code points, and the distinct links of patterns and instances."""
    if not data:
        return [], [], []
    base = base_spans(data)
    others = candidates(data, base)
    spans = [(a, b, 1 << k, 1 << k) for a, b, k in base] + [(a, b, 0, kinds) for a, b, kinds in others]
    if not spans:
        return [], [], []
    points = {}
    if not data.isascii():
        last = chars = 0
        for at in sorted({x for a, b, *_ in spans for x in (a, b)}):
            chars += len(data[last:at].decode())
            points[at], last = chars, at
    place = lambda at: points.get(at, at)
    links = {(p, instance(data[a:b], kinds), known, kinds) for a, b, known, kinds in spans for p in patterns(data, a, b)}
    return (
        [{"start": place(a), "end": place(b), "kind": k} for a, b, k in base],
        [{"start": place(a), "end": place(b), "instance": instance(data[a:b], kinds), "kinds": kinds} for a, b, kinds in others],
        [dict(zip(("pattern", "instance", "known", "kinds"), x, strict=True)) for x in sorted(links)],
    )


def find_mentions(docs: DataFrame) -> DataFrame:
    """FOUND, a row per row of ``docs``."""
    span = [("start", pa.int64()), ("end", pa.int64())]
    kinds = [pa.list_(pa.struct(x)) for x in ([*span, ("kind", pa.int32())], [*span, ("instance", pa.string()), ("kinds", pa.int32())], [("pattern", pa.string()), ("instance", pa.string()), ("known", pa.int32()), ("kinds", pa.int32())])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [mentions(x) for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "base", "others", "links"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def _kinds(mask: Column) -> Column:
    """The numbers of the kinds in a bit mask."""
    return F.filter(F.array(*map(F.lit, range(len(KINDS)))), lambda k: F.getbit(mask, k) == 1)


def bootstrap(found: DataFrame, scratch: Scratch, support: int = SUPPORT, precision: float = PRECISION, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, known, score) of accepted patterns and (instance, kind, score) of known instances after some rounds.

    ``found`` is a kept table of find_mentions. Seeds have score 1. Without
    seeds, or without a pattern of enough of them, only seeds are known.
    """
    links = found.select(F.explode("links").alias("l")).select("l.*").groupBy("pattern", "instance").agg(F.bit_or("known").alias("known"), F.bit_or("kinds").alias("kinds"))
    links = scratch.keep(links, "links")
    sizes = scratch.keep(links.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    seeds = links.where("known > 0").select("instance", F.explode(_kinds(F.col("known"))).alias("kind")).distinct().withColumn("score", F.lit(1.0))
    known = seeds = scratch.keep(seeds, "seeds")
    for k in range(rounds):
        sums = links.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count("*").alias("known"))
        score = F.col("sum") / (F.col("n") + 1)
        accepted = sums.where(F.col("known") >= support).join(sizes, "pattern").select("pattern", "kind", "known", score.alias("score")).where(F.col("score") >= precision)
        accepted = scratch.keep(accepted, f"patterns-{k}")
        reached = links.join(accepted, "pattern").where(F.getbit(F.col("kinds"), F.col("kind")) == 1).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        known = scratch.keep(seeds.unionByName(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")), f"known-{k}")
        if k:
            scratch.drop(f"patterns-{k - 1}", f"known-{k - 1}")
    return accepted, known


def extract(docs: DataFrame, support: int = SUPPORT, precision: float = PRECISION, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, context), a row per row of ``docs`` (doc_id and text are read): arrays of struct<SPAN>, by start, then kind.

    ``base`` are the seed spans, ``context`` those that patterns discover; none
    of these overlaps a base span. kind is a place in KINDS, offsets are code
    points, ends exclusive. A candidate of several kinds takes the surest, then
    the first. Null and empty texts have no spans, repeated rows and null ids
    have a row each. What a text's context spans are hangs on the whole table;
    equal texts have equal spans.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.keep(find_mentions(docs).withColumn("row", F.monotonically_increasing_id()), "found")
    _, known = bootstrap(found, scratch, support, precision, rounds)
    each = found.select("row", F.explode("others").alias("o")).select("row", "o.*")
    best = F.min(F.struct((-F.col("score")).alias("order"), "kind"))["kind"]
    hits = each.join(known, "instance").where(F.getbit(F.col("kinds"), F.col("kind")) == 1).groupBy("row", "start", "end").agg(best.alias("kind"))
    spans = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("context"))
    none = F.array().cast(f"array<struct<{SPAN}>>")
    return found.select("row", "doc_id", "base").join(spans, "row", "left").select("doc_id", "base", F.coalesce("context", none).alias("context"))


def span_digest(spans: DataFrame) -> DataFrame:
    """extract()'s rows with counts and a digest of the base spans, and all spans as text, those by context with BY_CONTEXT before their kind."""
    name = lambda s, prefix: F.concat(F.lit(prefix), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1))
    put = lambda s, prefix, late: F.struct(s["start"].alias("start"), (s["kind"] + late).alias("order"), F.concat_ws(":", name(s, prefix), s["start"].cast("string"), s["end"].cast("string")).alias("said"))
    said = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda s: s["said"]), ",")
    base, context = F.transform("base", lambda s: put(s, "", 0)), F.transform("context", lambda s: put(s, BY_CONTEXT, len(KINDS)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select("doc_id", *map(count, range(len(KINDS))), F.sha2(said(base), 256).alias("base_sha256"), said(F.concat(base, context)).alias("spans"))
