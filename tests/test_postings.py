"""The stored index against scores over all tokens, and what its scans read."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.sources.postings import Index, after


def scanned(df):
    """Rows that the scans of a query gave, after row groups were left out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0

    def visit(node):
        nonlocal total
        name = node.nodeName()
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        children = node.children()
        for x in inner + [children.apply(k) for k in range(children.size())]:
            visit(x)

    visit(plan)
    return total


def test_prefix_ranges():
    assert after("ab") == "ac" and after("a\U0010ffff") == "b" and after("\U0010ffff") is None and after("") is None and after("퟿") == ""


def test_scores_follow_added_and_replaced_documents(spark, tmp_path):
    rnd, root = random.Random(5), f"file://{tmp_path}/i"
    make = lambda: [rnd.choice(["red", "reddish", "blue", "bluer", "green", "ré", "widget"]) for _ in range(rnd.randrange(1, 6))]
    docs = {k: make() for k in range(60)}
    table = lambda own: spark.createDataFrame([(k, t) for k, ts in own.items() for t in ts], "id long, token string")
    same = lambda: {r.id: r.score for r in Index(spark, root).search(["red", "blue"]).collect()} == {r.id: pytest.approx(r.score, abs=2e-6) for r in search.bm25(table(docs), "id", ["red", "blue"]).collect()}
    Index(spark, root).add(table(docs))
    assert same()
    for turn in range(2):
        fresh = {k: make() for k in range(turn * 10, turn * 10 + 15)} | {100 + turn: make()}
        lost = [40 + turn, 99]
        for k in lost:
            docs.pop(k, None)
        docs |= fresh
        Index(spark, root).add(table(fresh), spark.createDataFrame([(k,) for k in lost], "id long"))
        assert same()
    index = Index(spark, root)
    assert index.manifest["documents"] == len(docs) and index.manifest["tokens"] == sum(map(len, docs.values()))
    assert index.search([]).count() == 0 and index.search(["nothing"]).count() == 0


def test_a_prefix_reads_few_row_groups(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        tokens = spark.range(20_000).select("id", F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("token"))
        Index(spark, root).add(tokens)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    found = Index(spark, root).postings(["t0123"])
    assert found.count() == 10
    assert scanned(found) < 20_000 / 4
    assert "GreaterThanOrEqual(token,t0123)" in found._jdf.queryExecution().toString()
