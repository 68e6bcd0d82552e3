"""MinHash near-duplicate detection with fast similarity sketches.

Method: every distinct shingle set gets a fast similarity sketch (rounds of
hashed bin placement: in round i < t each element falls in a hashed bin, in
round t + j each falls in bin j, so every coordinate fills; values of early
rounds win). Bands of coordinates propose pairs, one bit of each coordinate
estimates their similarity, and full sets confirm them.

No bucket is expanded into all its pairs. Pairs go through two rounds:

1. each member of a bucket against its centre (a star), the member that the
   most others share buckets with;
2. buckets whose members are still in different components: small ones by all
   pairs of different components whose sketches come near the threshold. In
   large ones each member is told by its differences from the centre, x ^ c.
   Links are pairs with few elements in (x ^ c) ^ (y ^ c), so they share many
   differences, of which some are among the first few in a fixed order; only
   members that share one of those meet. This is exact.

A pair within one component needs no test, since only components are returned.
The bands are chosen so that a pair at the threshold is missed with
probability MISS at most; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import as_bytes, long_lists, mix, odd_weights, shingle_set, slices
from graphloom.operators.components import connected_components
from graphloom.storage import Scratch

#: Coordinates of a sketch.
COORDINATES = 512
#: Chance that no band holds a pair whose similarity equals the threshold.
MISS = 1e-7
DEVIATIONS = 5.2
#: Members of buckets of more are told by their differences from the centre, not paired.
DENSE = 64
#: Ids that a broadcast may hold (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a star that are compared with one copy of its centre.
STAR = 128

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def sketch(elements: np.ndarray, owner: np.ndarray, sets: int, t: int = COORDINATES) -> np.ndarray:
    """The sketches of ``sets`` non-empty sets as a (sets, t) matrix of uint64.

    elements[i] belongs to set owner[i]; owner ascends. A set leaves the rounds
    when its last bin is filled.
    """
    out = np.full(sets * t, _EMPTY, np.uint64)
    empty = np.full(sets, t, np.int64)
    elements, base = elements.copy(), owner.astype(np.int64)
    for i in range(2 * t):
        h = mix(elements + np.uint64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        at = base * t + bins
        fresh = at[out[at] == _EMPTY]
        np.minimum.at(out, at, np.uint64(i << 32) | (h & _LOW))
        if len(fresh):
            empty -= np.bincount(np.unique(fresh) // t, minlength=sets)
        going = empty[base] > 0
        if not going.all():
            elements, base = elements[going], base[going]
            if not len(elements):
                break
    return out.reshape(sets, t)


def bands_for(similarity: float, rows: int) -> int:
    """Bands of ``rows`` coordinates that miss a pair at the threshold with MISS at most."""
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**rows)))


def short_bands(similarity: float) -> tuple[int, int]:
    """(rows, bands): the longest disjoint bands of at most 8 that fit the sketch."""
    return max((r, bands_for(similarity, r)) for r in range(1, 9) if r * bands_for(similarity, r) <= COORDINATES or r == 1)


PROFILE = "doc_id long, row_key string, n_shingles long, digest binary, bands array<long>, bits array<long>"


def profile(rows: int, bands: int):
    """mapInArrow function: (doc_id, text, row_key) to PROFILE; nulls instead of a sketch for empty sets."""
    weights, labels = odd_weights(rows, 17), odd_weights(bands, 29)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(x) for x in as_bytes(part.column(1))]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                n = len(sets)
                bits = [None] * n
                keys = np.empty((len(full), bands), np.uint64)
                if len(full):
                    marks = sketch(np.concatenate([sets[k] for k in full]), np.repeat(np.arange(len(full)), sizes[full]), len(full))
                    split = marks[:, : rows * bands].reshape(len(full), bands, rows)
                    keys = mix((mix(split) * weights).sum(axis=2) + labels)
                    for k, packed in zip(full, one_bit(marks), strict=True):
                        bits[k] = packed
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(sizes), pa.array(digests, pa.binary()), long_lists(keys.ravel(), offsets), pa.array(bits, pa.list_(pa.int64()))],
                    names=["doc_id", "row_key", "n_shingles", "digest", "bands", "bits"],
                )

    return run


def one_bit(marks: np.ndarray) -> np.ndarray:
    """One hashed bit of each coordinate, 64 to a signed integer."""
    return np.packbits(mix(marks).astype(np.uint8) & 1, axis=1).view(np.int64)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (node, text) to (node, elements)."""
    for batch in batches:
        for part in slices(batch):
            found = [shingle_set(x).tobytes() for x in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "elements"])


def confirm(per: int, cent: int):
    """mapInArrow function over rows (a, salt, b, elements) sorted by a, salt, b: links a-b.

    The row whose b is null is the centre's; its set alone is held. Confirmed
    are pairs with cent * |intersection| >= per * |union|.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centres = None, []
        for batch in batches:
            a, b = [], []
            for x, salt, y, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = np.frombuffer(data, np.uint64)
                if y is None:
                    centres = [*centres, own] if at == (x, salt) else [own]
                    at = (x, salt)
                    continue
                for centre in centres if at == (x, salt) else []:
                    inter = len(np.intersect1d(centre, own, assume_unique=True))
                    if cent * inter >= per * (len(centre) + len(own) - inter):
                        a.append(x)
                        b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


PREFIXES = "key long, node long, label long, first boolean, second boolean"


def prefixes(own: np.ndarray, centre: np.ndarray, per: int, cent: int) -> tuple[bool, np.ndarray, int, int]:
    """(linked, differences, near, far) of a set and another one, both sorted.

    differences holds the elements of one of the two sets, those of ``own``
    first. Let t be the threshold, n and c the sizes, d the differences of x.
    An unlinked y has more than (n_y + c)(1 - t)/(1 + t) of them, and a link of
    x and y leaves at most (n + n_y)(1 - t)/(1 + t) that only one of them has,
    so they share more than (d - (n - c)(1 - t)/(1 + t)) / 2: one is among the
    first ``near`` of x, and of y, whichever of the two is unlinked. A link of
    an unlinked x with a linked y shares d - n (1 - t)/t at least, so one is
    among the first ``far`` of x; far is 0 where x is too far off for that.
    """
    added, removed = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
    n, c, d = len(own), len(centre), len(added) + len(removed)
    inter = n - len(added)
    linked = cent * inter >= per * (n + c - inter)
    share = (d * (cent + per) - (cent - per) * (n - c)) // (2 * (cent + per)) + 1
    near, far = max(0, d - share + 1), 0
    # y is at most n / t large, so it has (n / t + c)(1 - t)/(1 + t) differences at most if it is linked.
    if not linked and d * (cent + per) * per <= (cent - per) * (n * per + 2 * n * cent + c * per):
        far = d - max(1, -((n * (cent - per) - d * per) // per)) + 1
    return linked, np.concatenate([added, removed]), near, far


def differences(per: int, cent: int):
    """mapInArrow function over rows (a, salt, b, label, elements) sorted by a, salt, b: PREFIXES of the members b.

    The row whose b is null is the centre's. Two nodes of which one is unlinked
    with the centre can be linked only if a key of the one that is first is
    one of the other that is second.
    """
    names = [x.split()[0] for x in PREFIXES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre, main = None, None, None
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def add(keys: np.ndarray, node: int, label: int, first: bool, second: bool, out=out) -> None:
                for column, value in zip(out, (keys, np.full(len(keys), node), np.full(len(keys), label), np.full(len(keys), first), np.full(len(keys), second)), strict=True):
                    column.append(value)

            for a, salt, b, label, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = np.frombuffer(data, np.uint64)
                if b is None:
                    at, centre, main = (a, salt), own, label
                    continue
                if at != (a, salt):
                    raise ValueError("a member came before its centre")
                linked, found, near, far = prefixes(own, centre, per, cent)
                keys = mix(found[: max(near, far)] + np.array([a], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(1)
                if linked:
                    add(keys[:near], b, label, False, True)
                    continue
                add(keys[:near] | np.uint64(1), b, label, True, True)
                if label != main:
                    add(keys[:far], b, label, True, False)
            columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64) if len(columns[0]) else columns[0], pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:3]), *(pa.array(c.astype(bool)) for c in columns[3:])], names=names)

    return run


def may_link(per: int, cent: int, coordinates: int = COORDINATES) -> Column:
    """Whether the sizes n_a, n_b of two sets allow the threshold and their sketches bits_a, bits_b come near it.

    The bits of a pair at the threshold agree in (1 + J) / 2 of the places; the
    bound is DEVIATIONS standard deviations below, which MISS of them fall short of.
    """
    share = (1 + per / cent) / 2
    most = coordinates - math.floor(coordinates * (share - DEVIATIONS * math.sqrt(share * (1 - share) / coordinates)))
    differ = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(coordinates // 64)), F.lit(0))
    return (F.least("n_a", "n_b") * cent >= F.greatest("n_a", "n_b") * per) & (differ <= most)


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"), *more)


class _Rounds:
    """The tables that the rounds share."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, reps: DataFrame, scratch: Scratch, per: int, cent: int):
        self.texts, self.nodes, self.reps, self.scratch, self.per, self.cent = texts, nodes, reps, scratch, per, cent

    def close(self, pairs: DataFrame) -> DataFrame:
        """Pairs that may link."""
        near = pairs.join(_side(self.reps, "a"), "a").join(_side(self.reps, "b"), "b")
        return near.where(may_link(self.per, self.cent)).select("a", "b").distinct()

    def of(self, ids: DataFrame, name: str) -> DataFrame:
        """(node, text) of some nodes, a row each."""
        ids = self.scratch.keep(ids.select("node").distinct().join(self.nodes, "node").select("node", "row_key", "times"), f"ids-{name}")
        few = ids.count() <= BROADCAST_IDS
        found = lambda own: self.texts.join(F.broadcast(own) if few else own, "row_key").select("node", "text")
        again = ids.where("times > 1")
        if again.isEmpty():
            return found(ids)
        return found(ids.where("times = 1")).unionByName(found(again).groupBy("node").agg(F.first("text").alias("text")))

    def dealt(self, pairs: DataFrame, name: str, *more: str) -> DataFrame:
        """(a, salt, b, more, elements) of distinct pairs, sorted so: members b after a copy of their centre a, whose b is null.

        A star's members are salted, STAR of them to a copy of the centre.
        """
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        sets = self.scratch.keep(self.of(ends, name).mapInArrow(set_rows, "node long, elements binary"), f"sets-{name}")
        stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("salts"), *(F.first(f"centre_{c}").alias(c) for c in more))
        members = pairs.join(stars.select("a", "salts"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", *more)
        centres = stars.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), *more)
        rows = members.join(sets, F.col("b") == F.col("node")).drop("node").unionByName(centres.join(sets, F.col("a") == F.col("node")).drop("node"))
        return rows.select("a", "salt", "b", *more, "elements").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that full sets confirm, of pairs that may link."""
        pairs = self.scratch.keep(pairs.distinct(), f"close-{name}")
        found = self.scratch.keep(self.dealt(pairs, name).mapInArrow(confirm(self.per, self.cent), "a long, b long"), f"links-{name}")
        self.scratch.drop(f"sets-{name}", f"ids-{name}", f"close-{name}")
        return found

    def parted(self, rows: DataFrame) -> DataFrame:
        """Pairs that may link, of the members of large buckets: rows has centre, node and label."""
        labels = rows.groupBy("node").agg(F.first("label").alias("label"))
        pairs = rows.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "label").distinct()
        pairs = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("centre_label")), "a")
        pairs = self.scratch.keep(pairs, "regions")
        keys = self.scratch.keep(self.dealt(pairs, "regions", "label").mapInArrow(differences(self.per, self.cent), PREFIXES), "prefixes")
        found = self.scratch.keep(_pairs(_mixed(keys), self.reps, may_link(self.per, self.cent)), "parted")
        self.scratch.drop("regions", "prefixes", "sets-regions", "ids-regions")
        return found


def _buckets(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node) to the members of buckets with two nodes: key, node, members, centre.

    The centre is the member whose buckets hold the most members in all, of
    equals the smallest: near it are more others than near a member at random.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    rows = scratch.keep(keys.join(sizes, "key"), "buckets")
    scores = rows.groupBy("node").agg(F.sum("members").alias("score"))
    scored = rows.join(scores, "node")
    centres = scored.groupBy("key").agg(F.min_by("node", F.struct(-F.col("score"), "node")).alias("centre"))
    return scored.drop("score").join(centres, "key")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with the label of the largest one."""
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    several = counts.groupBy("key").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("largest"))
    return rows.join(several.where("labels > 1").drop("labels"), "key")


def _pairs(rows: DataFrame, sketches: DataFrame, near: Column) -> DataFrame:
    """(a, b) of nodes that share a key, have different labels and are ``near``, each from one of their common keys.

    rows has key, node, label, largest, and first and second: a pair needs a
    first and a second row of a key. Where rows are both, one of the two is not
    in the key's largest component, so a key that is one component but for a
    few costs those few times its size. The key that a pair comes from is the
    smallest in which it meets in this order. A node's keys are gathered first,
    so that its sketch is joined once and common keys can be told without an
    aggregation of pairs.
    """
    both = F.col("first") & F.col("second")
    rows = rows.withColumns({"both": both, "main": F.col("label") == F.col("largest"), "first": F.col("first") & (~F.col("second") | (F.col("label") != F.col("largest")))})
    places = rows.groupBy("node", "label").agg(F.collect_list(F.struct("key", "first", "second", "both", "main")).alias("places"))
    joined = places.join(sketches.select("node", "n_shingles", "bits"), "node")
    of = lambda flag: F.transform(F.filter("places", lambda p: p[flag]), lambda p: p["key"])
    placed = joined.select("node", "label", "n_shingles", "bits", of("first").alias("firsts"), of("second").alias("seconds"), F.inline("places"))
    left = _side(placed.where("first"), "a", "key", F.col("label").alias("label_a"), "firsts")
    right = _side(placed.where("second"), "b", "key", F.col("label").alias("label_b"), "seconds", "both", "main")
    fits = F.expr("label_a <> label_b and (main or not both or a < b)") & near & (F.array_min(F.array_intersect("firsts", "seconds")) == F.col("key"))
    return left.join(right, "key").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _row_key(doc_id: Column, text: Column) -> Column:
    """A digest of the id and the whole text: what tells rows apart."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))))


def _labelled_rows(docs: DataFrame, per: int, cent: int, scratch: Scratch) -> DataFrame:
    """(doc_id, row_key, n_shingles, label, component_id), a row per row; label tells components apart, null outside of all."""
    similarity = per / cent
    rows, bands = short_bands(similarity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    profiles = scratch.keep(texts.mapInArrow(profile(rows, bands), PROFILE), "profiles")

    keyed = profiles.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "row_key").agg(F.min("doc_id").alias("low"), F.count("*").alias("times"))
    first = keyed.groupBy("digest").agg(F.min(F.struct("low", "row_key", "times")).alias("first")).select("digest", "first.*")
    nodes = scratch.keep(first.withColumn("node", F.monotonically_increasing_id()), "nodes")
    of_reps = profiles.select("row_key", "n_shingles", "bands", "bits").join(nodes.select("row_key", "node", "times"), "row_key")
    once, again = of_reps.where("times = 1").drop("row_key", "times"), of_reps.where("times > 1").drop("row_key", "times")
    again = again.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")))
    reps = scratch.keep(once.unionByName(again), "reps")
    work = _Rounds(texts, nodes, reps, scratch, per, cent)

    short = scratch.keep(_buckets(reps.select("node", F.explode("bands").alias("key")), scratch), "short")
    stars = short.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = work.links(work.close(stars), "stars")
    labels = connected_components(links, scratch, "stars")

    mixed = scratch.keep(_mixed(_labelled(short, labels)), "mixed")
    small = mixed.where(f"members <= {DENSE}").select("key", "node", "label", "largest", F.lit(True).alias("first"), F.lit(True).alias("second"))
    pairs = _pairs(small, reps, may_link(per, cent))
    more = work.links(pairs.unionByName(work.parted(mixed.where(f"members > {DENSE}"))), "mixed")
    labels = connected_components(links.unionByName(more), scratch, "mixed")
    scratch.drop("buckets", "short", "mixed", "parted", "reps", "links-stars", "links-mixed")

    members = _labelled(nodes.select("digest", "node", "low"), labels)
    lowest = members.groupBy("label").agg(F.min("low").alias("component_id"))
    members = scratch.keep(members.join(lowest, "label").select("digest", "label", "component_id"), "members")
    return profiles.select("doc_id", "row_key", "n_shingles", "digest").join(members, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, per: int = 85, cent: int = 100, label: str = "minhash") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    docs needs doc_id and text; other columns are ignored. Documents are linked
    if cent * |intersection| >= per * |union| of their shingle sets (text.shingle_set).
    component_id is the smallest doc_id reachable over links; kept marks it.

    Null and empty texts and texts without words have n_shingles 0 and are
    linked with nothing. Equal texts are linked. Repeated rows give repeated
    results; rows that share a doc_id alone are judged each by its own text. A null doc_id takes part in no link except with equal sets: its
    component_id is theirs, or null, and kept is then true. An empty table
    gives an empty result.
    """
    found = _labelled_rows(docs, per, cent, Scratch(docs.sparkSession, label))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def dedup(docs: DataFrame, per: int = 80, cent: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, of its texts the one with the smallest digest.

    Documents without words are linked with nothing, so they stay, and rows
    with a null doc_id always stay. Rows that repeat both doc_id and text are
    one document, of which one stays. Rows that share a doc_id alone are judged
    each by its own text. Other columns, of any names, are kept as they are.

    The rows that go are joined, not those that stay: where they are few, the
    texts aren't shuffled.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows = scratch.keep(_labelled_rows(docs, per, cent, scratch).where("doc_id is not null").groupBy("row_key", "label").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times")), "rows")
    best = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "row_key")).alias("best")).select("best.row_key")
    gone = scratch.keep(rows.where("label is not null").select("row_key").join(best, "row_key", "left_anti"), "gone")
    again = scratch.keep(rows.where("times > 1").select("row_key").join(gone, "row_key", "left_anti"), "again")
    key = "row_key"
    while key in docs.columns:
        key += "_"
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    own = _row_key(F.col("doc_id"), F.col("text"))
    kept = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), own)).join(small(gone).withColumnRenamed("row_key", key), key, "left_anti")
    if again.isEmpty():
        return kept.drop(key)
    again = small(again).withColumnRenamed("row_key", key)
    return kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key])).drop(key)
