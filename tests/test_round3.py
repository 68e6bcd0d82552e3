"""Tests of round 3: work that once grew faster than the input."""

import math
import random
from collections import Counter, defaultdict

import pytest

from graphloom.operators import graph, lookup
from graphloom.sources import declared, extract


@pytest.mark.parametrize("block", [2, 1024])
def test_summed_neighbourhoods_equal_loops(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    rnd = random.Random(3)
    rows = sorted({(rnd.randrange(14), rnd.randrange(14), rnd.choice("xy")) for _ in range(70)} | {(99, k, "x") for k in range(14)})
    rows = [(*r, 10 * k) for k, r in enumerate(rows)]
    near = defaultdict(set)
    for f, t, _, _ in rows:
        near[f] |= {f, t}
        near[t] |= {f, t}
    wanted = defaultdict(lambda: [0, 0])
    for anchor in range(0, 14, 2):
        for f, t, kind, mark in rows:
            if {f, t} <= near[anchor]:
                wanted[anchor, kind][0] += 1
                wanted[anchor, kind][1] += mark
    edges = spark.createDataFrame([*rows, (None, 3, "x", 1)], "from_path long, to_path long, kind string, mark long")
    asked = spark.createDataFrame([(k,) for k in range(0, 14, 2)], "anchor long")
    got = graph.neighbourhood_sums(edges, asked, scratch).collect()
    assert {(r.anchor, r.kind): [r.n_edges, r.total] for r in got} == dict(wanted) and len(got) == len(wanted)


def test_adamic_adar_deals_pairs_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 50)
    rows = spark.createDataFrame([(k, n) for n in range(5) for k in range(12)], "node long, neighbour long")
    found = graph.adamic_adar(rows)
    assert found.rdd.getNumPartitions() == 7  # five neighbours of 66 pairs each
    got = {(r.a, r.b): round(r.score, 9) for r in found.collect()}
    assert got == {(a, b): round(5 / math.log(12), 9) for a in range(12) for b in range(a + 1, 12)}


def test_edges_are_counted_by_numbers(spark, scratch):
    names = {1: ("f", "x", "k"), 2: ("f", "x", "k"), 3: ("g", None, "k"), 4: ("g", None, "k"), 5: (None, "y", "v")}
    symbols = spark.createDataFrame([(k, *v) for k, v in names.items()], "id long, file_path string, name string, kind string")
    links = [(1, 3, "c"), (2, 3, "c"), (1, 4, "c"), (3, 5, "c"), (4, 5, "d"), (9, 1, "c"), (2, 9, "c"), (None, 1, "c")]
    edges = spark.createDataFrame(links, "from_id long, to_id long, kind string")
    for inbound, (near, far) in ((True, (1, 0)), (False, (0, 1))):
        found = lookup.edge_counts(symbols, edges, scratch, inbound)
        wanted = Counter((e[near], *names[e[far]], e[2]) for e in links if e[far] in names)
        assert {tuple(r)[:5]: r.n for r in found.collect()} == dict(wanted)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [id" in plan and not any("file_path" in x for x in plan.splitlines() if "Aggregate" in x)
    written = {k: "#".join(x for x in v[:2] if x) for k, v in names.items()}
    got = lookup.symbol_edge_counts(symbols, edges, scratch).collect()
    assert {tuple(r)[:3]: r.n for r in got} == dict(Counter((written[f], written[t], k) for f, t, k in links if f in names and t in names))


def test_texts_are_cut_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    go = spark.createDataFrame([("m.go", "go", 'api := e.Group("/a")\napi.GET("/b", h)\n// @router /r [get]\nfunc F() {}\n"gorm"\ntype T struct {\n gorm.Model\n}\nvar q = make(chan int)')], "path string, language string, content string")
    routes, names = declared.go_routes(go), declared.declarations(go)
    assert "regexp_extract_all" not in plan(routes) + plan(names)
    assert sorted(map(tuple, routes.collect())) == [("m.go", "/a/b", "h", 2), ("m.go", "/r", "F", 3)]
    assert sorted((r.name, r.kind, r.line) for r in names.collect()) == [("T", "database_schema", 6), ("q", "state_store", 9)]
    python = extract.decorated_routes(spark.createDataFrame([("m.py", "@app.get('/x')\n@y\ndef f():\n(r'/t', H),\n@app.get('/z')")], "path string, content string"))
    assert "Union" not in plan(python)
    assert sorted((r.line, r.route, r.handler) for r in python.collect()) == [(1, "/x", "f"), (4, "/t", "H"), (5, "/z", None)]


@pytest.mark.parametrize("page", [1, 2, 256])
def test_nested_routes_are_met_inside_their_row(spark, monkeypatch, page):
    monkeypatch.setattr(declared, "PAGE", page)
    text = '}\nrouting {\n}\nrouting { if (x) {\n  get("/no")\n  route("/a") {\n    get("/1") { }\n  } else {\n    put("/2") { }\n  }\n  route("/b") {{\n    get("/3")\n  }}\n  get("/4")\n}}\nget("/5")'
    files = spark.createDataFrame([("a.kt", "}\n{\n" + text[2:]), ("b.kt", text), ("c.kt", "")], "path string, content string")
    found = declared.nested_routes(files)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "Window"))
    inside = [("/no", 5), ("/a/1", 7), ("/a/2", 9), ("/b/3", 12), ("/4", 14)]
    # A brace too many at the top leaves all blocks one level lower: the first one of a line is below depth 0.
    assert sorted(map(tuple, found.where("path = 'a.kt'").collect())) == sorted(("a.kt", r, n + 1) for r, n in inside)
    assert found.where("path = 'b.kt'").count() == 0


def test_handlers_of_routes_join_nothing(spark):
    routes = spark.createDataFrame([("a", "/1"), ("a", "/1"), ("a", "/2"), ("b", "/3"), ("c", None), (None, "/4"), ("d", "/5")], "path string, route string")
    exports = spark.createDataFrame([("a", "loader"), ("a", "action"), ("a", "loader"), ("a", "default"), ("b", "default"), ("b", "x"), ("c", None), (None, "loader"), ("gone", "action")], "path string, name string")
    found = declared.file_route_handlers(routes, exports, declared.MODULE_HANDLERS, "default")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    wanted = {("a", r, h) for r in ("/1", "/2") for h in ("loader", "action")} | {("b", "/3", "default"), ("c", None, None), (None, "/4", None), ("d", "/5", None)}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == wanted and len(got) == len(wanted)


def test_parts_are_dealt_out_to_more_tasks(spark, monkeypatch, tmp_path):
    from graphloom.plans import sources_and_edges as plans

    spark.range(100).selectExpr("id as p_partkey", "'x' as p_name", "1 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(plans, "TASK_PARTS", 10)
    files = plans._sources(spark, str(tmp_path), "<n>", dealt=True)
    assert files.rdd.getNumPartitions() == 10 and files.count() == 100
