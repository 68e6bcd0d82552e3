"""Routes of tables, presets of many anchors, costs of tools, neighbours asked for, communities by number or name."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, manifest, telemetry
from graphloom.sources import extract


def test_route_tables_and_bare_decorators(spark):
    text = "@get('/a')\n@app.head('/b')\ndef both(): pass\napp.add_route(View.as_view(), '/c')\n  (r'/d/(\\d+)', UserHandler),\n  ('/e', lower),\n  ('f', Upper),\n# (r'/g', Gone)\n@app.route('/h')"
    got = extract.decorated_routes(spark.createDataFrame([("m.py", text)], "path string, content string")).collect()
    assert sorted((r.line, r.route, r.handler) for r in got) == [(1, "/a", "both"), (2, "/b", "both"), (4, "/c", "View"), (5, "/d/(\\d+)", "UserHandler"), (9, "/h", None)]


def test_presets_of_many_anchors(spark, scratch):
    nodes = spark.createDataFrame([(f"f{k:02}", 0, 0.1) for k in range(8)] + [("s1", 1, 0.0), ("s2", 0, 0.9), ("s3", 0, 0.0)], "path string, n_routes int, rank_score double")
    home = nodes.select("path", F.substring("path", 1, 1).alias("community"))
    edges = spark.createDataFrame([("f01", "f00", "imports"), ("f02", "f01", "imports"), ("s1", "f00", "route")], "from_path string, to_path string, kind string")
    anchors = spark.createDataFrame([("f00",), ("s3",), ("gone",), ("f00",)], "anchor string")
    got = {}
    for task in ("bug-fix", "refactor", "feature"):
        for r in graph.presets(task, anchors, nodes, edges, home, scratch).collect():
            got.setdefault((task, r.anchor), []).append(r.path)
    fs = [f"f{k:02}" for k in range(8)]
    assert {k: sorted(v) for k, v in got.items()} == {
        ("bug-fix", "f00"): ["f00", "f01"], ("bug-fix", "s3"): ["s3"], ("refactor", "f00"): fs, ("refactor", "s3"): ["s1", "s2", "s3"], ("feature", "f00"): fs[:5], ("feature", "s3"): ["s1", "s2"],
    }
    with pytest.raises(ValueError):
        graph.presets("none", anchors, nodes, edges, home, scratch)


def test_costs_of_tools(spark):
    calls = [(1, "callers", None, None), (2, "explore", 3, None), (3, "explore", None, None), (4, "node", None, None), (5, "write", None, "x" * 37), (6, "write", None, None), (7, "delete", None, None), (8, "other", None, None), (9, None, None, None), (10, "impact", None, None)]
    own = spark.createDataFrame(calls, "call int, tool string, n_asked int, content string")
    asked = spark.createDataFrame([(1, "a"), (4, "/a"), (10, "b"), (10, "b"), (8, "a")], "call int, path string")
    got = telemetry.tool_cost(own, asked, spark.createDataFrame([("a", 70)], "path string, tokens long")).collect()
    assert {r.call: r.raw_tokens for r in got} == {1: 3500, 2: 10500, 3: 3500, 4: 70, 5: 510, 6: 1500, 7: 500, 8: 1000, 9: 1000, 10: 3000}


def test_neighbours_asked_for(spark):
    symbols = spark.createDataFrame([(1, "src/a.ts", "load", "function"), (2, "src/b.ts", "load", "function"), (3, "src/c.ts", "run", "function")], "id long, file_path string, name string, kind string")
    edges = spark.createDataFrame([(3, 1, "calls"), (3, 1, "references"), (3, 2, "calls")], "from_id long, to_id long, kind string")
    links = spark.createDataFrame([("src/c.ts", "src/a.ts", "imports"), ("src/c.ts", "src/a.ts", "references"), ("x", "src/a.ts", "route")], "from_path string, to_path string, kind string")
    asked = spark.createDataFrame([(1, None, "load"), (2, "/src/b.ts", "load"), (3, "src/a.ts", None), (4, None, "none"), (5, "src/c.ts", None), (6, None, None)], "ask int, path string, name string")
    got = sorted((r.ask, r.file_path, r.name) for r in lookup.asked_neighbours(asked, symbols, edges, links).collect())
    assert got == [(1, "src/c.ts", "run"), (1, "src/c.ts", "run"), (2, "src/c.ts", "run"), (3, "src/c.ts", None)]
    assert sorted((r.ask, r.file_path) for r in lookup.asked_neighbours(asked, symbols, edges, links, inbound=False).collect()) == [(5, "src/a.ts")]


def test_communities_and_languages(spark):
    files = spark.createDataFrame([("a", "Auth", 2, 0.5, 1), ("b", "Old auth", 1, 0.4, 2), ("c", "Auth", 2, 0.3, 3), ("d", None, None, 0.2, 4)], "path string, community string, community_id int, rank_score double, rank_order int")
    got = lambda asked, rows=files: [r.path for r in manifest.select_files(rows, manifest.Options(community=asked)).collect()]
    assert got("2") == ["a", "c"] and got("auth") == ["b"] and got(" OLD ") == ["b"] and got("none") == [] and got("9") == []
    assert got("auth", files.drop("community_id")) == ["a", "c"] and got("2", files.drop("community_id")) == []
    rows = spark.createDataFrame([("a", "rust", 3), ("b", "go", 1), ("c", "go", 2), ("d", "rust", 5)], "path string, language string, n_symbols int")
    assert [tuple(r) for r in lookup.primary_language(rows).collect()] == [("go", 2, 11)]
    assert lookup.primary_language(rows.limit(0)).collect() == []
