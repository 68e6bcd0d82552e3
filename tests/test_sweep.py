"""Sweeps against sequential ones, and contexts by hand."""

import random

import pytest

from graphloom.operators import community, manifest


def sequential(near, passes, strict):
    labels = {n: n for n in near}
    for _ in range(passes):
        moved = False
        for n in sorted(near):
            votes, places = {}, {}
            for other, weight, place in near[n]:
                votes[labels[other]] = votes.get(labels[other], 0) + weight
                places[labels[other]] = min(places.get(labels[other], place), place)
            top = max(votes.values())
            if strict:
                new = labels[n] if votes.get(labels[n], 0) >= top else min((x for x in votes if votes[x] == top), key=lambda x: places[x])
            else:
                new = min(x for x in votes if votes[x] == top)
            moved |= new != labels[n]
            labels[n] = new
        if not moved:
            break
    return labels


@pytest.mark.parametrize("strict", [False, True])
def test_sweeps_equal_sequential_ones(spark, scratch, strict):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rnd, edges = random.Random(11), {}
        while len(edges) < 26:
            a, b = rnd.randrange(20), rnd.randrange(20)
            if a != b:
                edges[min(a, b), max(a, b)] = (rnd.choice([1, 1, 2]), len(edges))
        near = {}
        for (a, b), (weight, place) in edges.items():
            near.setdefault(a, []).append((b, weight, place))
            near.setdefault(b, []).append((a, weight, place))
        df = spark.createDataFrame([(n, *x) for n, own in near.items() for x in own], "node long, other long, weight long, place long")
        got = {r.node: r.label for r in community.sweep(df, scratch, 3, strict).collect()}
        assert got == sequential(near, 3, strict)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_communities_are_named_by_folders_or_hubs(spark, scratch):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        paths = ["src/a/x.ts", "src/a/y.ts", "src/a/z.ts", "lib/p/hub.py", "doc/q/r.md", "alone.rs", "one/u/f.go", "two/v/g.go", "six/w/h.go"]
        nodes = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, place long")
        links = [(0, 1), (1, 2), (0, 2), (6, 7), (7, 8), (6, 8), (3, 4)]
        edges = spark.createDataFrame([(paths[a], paths[b], k) for k, (a, b) in enumerate(links)], "from_path string, to_path string, place long")
        ranks = spark.createDataFrame([("two/v/g.go", 0.9), ("one/u/f.go", 0.9)], "path string, rank_score double")
        got = {r.path: (r.name, r.top_hub) for r in community.detected(nodes, edges, ranks, scratch).collect()}
        assert got["src/a/x.ts"] == got["src/a/z.ts"] == ("src/a", "src/a/x.ts")
        assert got["alone.rs"] == ("alone.rs", "alone.rs")
        assert got["one/u/f.go"] == got["six/w/h.go"] == ("f Domain", "one/u/f.go")
        assert got["doc/q/r.md"] == ("lib/p", "lib/p/hub.py")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_context_budget_by_hand(spark):
    nodes = spark.createDataFrame([("a", 370, ["x", "yy"], []), ("b", 100, [], ["/r"]), ("c", 37, [], [])], "path string, size_bytes long, exports array<string>, routes array<string>")
    edges = spark.createDataFrame([("a", "b", "imports"), ("c", "b", "route")], "from_path string, to_path string, kind string")
    symbols = spark.createDataFrame([(1, "a", "x", 1, 9), (2, "b", "f", 1, 2), (3, "b", "f", 1, 1)], "id long, file_path string, name string, start_line int, end_line int")
    chosen = spark.createDataFrame([("k", "a", None), ("k", "a", "x"), ("k", "a", None), ("k", "b", "f"), ("k", "no", None), ("l", "c", "none"), ("m", "?", None)], "context string, path string, name string")
    got = {r.context: (r.file_tokens, r.manifest_tokens, r.percent) for r in manifest.context_budget(nodes, edges, symbols, chosen).collect()}
    a, b = 1 + 3 + 12 + 5 + 14 + 2 + 1, 1 + 3 + 10 + 2 + 1
    assert got == {"k": (round(450 / 3.7), round((a + b) / 3.7), round((round(450 / 3.7) + round((a + b) / 3.7)) / 160, 1)), "l": (0, 1, 0.0), "m": (0, 0, 0.0)}
