"""A stored inverted index: postings sorted by token, changed by segments.

A segment holds postings (token, id, tf, length), dealt out by ranges of token
and sorted within them, so that a prefix is a range of tokens that the
statistics of parquet files and row groups leave out or let in. Changed ids get
a new segment with their postings, and are gone from all earlier ones. A
manifest lists the segments, with the number of documents and of their tokens,
so that a search reads postings of its prefixes only.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.search import bm25_scores, term_counts
from graphloom.sources.sinks import _current, put_pointer

POSTINGS, GONE, DOCS = "token string, id long, tf long, length long", "id long", "id long, length long"


def after(prefix: str) -> str | None:
    """The least string above all that begin with the prefix, in the order of code points; None if there is none."""
    for k in reversed(range(len(prefix))):
        n = ord(prefix[k]) + 1
        if n < 0x110000:
            return prefix[:k] + chr(0xE000 if n == 0xD800 else n)
    return None


def begins(token: Column, prefix: str) -> Column:
    """Whether a token begins with the prefix, as a range that a scan can push down."""
    end = after(prefix)
    return (token >= prefix) & (token < end) if end else token >= prefix


class Index:
    """The index below a root; ``add`` and ``search`` see the newest manifest at the time that the object was made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.number, content = _current(spark, self.root)
        self.manifest = json.loads(content) if content else {"segments": [], "documents": 0, "tokens": 0}

    def _read(self, kind: str, schema: str) -> DataFrame:
        """Rows of a kind of all segments, with the number of the segment."""
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for k, name in enumerate(self.manifest["segments"]):
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{kind}").withColumn("segment", F.lit(k)))
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows whose id no later segment has replaced."""
        if len(self.manifest["segments"]) < 2:
            return rows.drop("segment")
        last = self._read("gone", GONE).groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(last, "id", "left").where("until is null or segment >= until").drop("segment", "until")

    def add(self, tokens: DataFrame, gone: DataFrame | None = None) -> None:
        """A segment with postings of tokens (id, token), a row per occurrence; ids in ``gone`` (id), and those of tokens, leave earlier segments."""
        name = uuid.uuid4().hex
        postings = term_counts(tokens, "id").select("token", "id", "tf", "length")
        postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.parquet(f"{self.root}/{name}/postings")
        written = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/{name}/postings")
        written.groupBy("id").agg(F.first("length").alias("length")).write.parquet(f"{self.root}/{name}/docs")
        docs = self.spark.read.schema(DOCS).parquet(f"{self.root}/{name}/docs")
        lost = docs.select("id")
        if gone is not None:
            lost = lost.unionByName(gone.select("id")).distinct()
        if not self.manifest["segments"]:
            lost = lost.limit(0)
        lost.write.parquet(f"{self.root}/{name}/gone")
        size = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        n, total = size(docs)
        n_lost, total_lost = size(self._alive(self._read("docs", DOCS)).join(self.spark.read.schema(GONE).parquet(f"{self.root}/{name}/gone"), "id", "left_semi")) if self.manifest["segments"] else (0, 0)
        manifest = {"segments": [*self.manifest["segments"], name], "documents": self.manifest["documents"] + n - n_lost, "tokens": self.manifest["tokens"] + total - total_lost}
        put_pointer(self.spark, self.root, self.number + 1, json.dumps(manifest))
        self.number, self.manifest = self.number + 1, manifest

    def postings(self, prefixes: list[str]) -> DataFrame:
        """(token, id, tf, length) of the living documents with a token of one of the prefixes."""
        wanted = F.lit(False)
        for p in prefixes:
            wanted = wanted | begins(F.col("token"), p)
        return self._alive(self._read("postings", POSTINGS).where(wanted))

    def search(self, prefixes: list[str]) -> DataFrame:
        """(id, score): what search.bm25 gives over the tokens of all living documents."""
        terms = F.array(*map(F.lit, prefixes)) if prefixes else F.array().cast("array<string>")
        hits = self.postings(prefixes).select("id", "tf", "length", F.explode(F.filter(terms, lambda t: F.col("token").startswith(t))).alias("term"))
        hits = hits.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
        documents = self.manifest["documents"]
        return bm25_scores(hits, "id", F.lit(documents), F.lit(self.manifest["tokens"] / documents if documents else 0.0))
