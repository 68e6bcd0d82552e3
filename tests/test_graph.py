import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import community, graph, manifest, rank
from graphloom.operators.components import connected_components
from graphloom.operators.ordering import last_rows, with_position


def ranked(spark, scratch, nodes, edges, symbols=1):
    n = spark.createDataFrame([(p, s, r) if not isinstance(p, str) else (p, s, r) for p, s, r in [(x if isinstance(x, tuple) else (x, symbols, 0)) for x in nodes]], "path string, n_symbols int, n_routes int")
    e = spark.createDataFrame(edges or [("", "", "")], "from_path string, to_path string, kind string").where("from_path <> ''")
    return {r.path: r for r in rank.page_rank(n, e, scratch, iterations=8).collect()}


def test_hub_is_first(spark, scratch):
    got = ranked(spark, scratch, ["a", "b", "c", "db", "unused"], [(x, "db", "imports") for x in "abc"])
    assert got["db"].rank_order == 1 and got["db"].rank_score == 1.0
    assert sorted(r.rank_order for r in got.values()) == [1, 2, 3, 4, 5]
    assert 0 < got["unused"].rank_score < 1


def test_cycle_is_symmetric_and_route_edges_carry_nothing(spark, scratch):
    got = ranked(spark, scratch, ["a", "b", "c"], [("a", "b", "imports"), ("b", "c", "imports"), ("c", "a", "imports"), ("a", "c", "route")])
    assert len({r.rank_score for r in got.values()}) == 1


def test_barrel_passes_its_links_on(spark, scratch):
    nodes = ["a", "b", "c", ("index.ts", 0, 0), "Button", "Card"]
    edges = [(x, "index.ts", "imports") for x in "abc"] + [("index.ts", x, "imports") for x in ("Button", "Card")]
    got = ranked(spark, scratch, nodes, edges)
    assert got["Button"].rank_score == got["Card"].rank_score > got["index.ts"].rank_score
    assert got["Button"].rank_score > got["a"].rank_score


def test_barrels_that_import_each_other_end(spark, scratch):
    nodes = ["a", ("index.ts", 0, 0), ("ui/index.ts", 0, 0), "x", "y"]
    edges = [("a", "index.ts", "imports"), ("index.ts", "ui/index.ts", "imports"), ("ui/index.ts", "index.ts", "imports"), ("index.ts", "x", "imports"), ("ui/index.ts", "y", "imports")]
    got = ranked(spark, scratch, nodes, edges)
    assert all(math.isfinite(r.rank_score) for r in got.values())
    assert min(got["x"].rank_score, got["y"].rank_score) > max(got["index.ts"].rank_score, got["ui/index.ts"].rank_score)


def test_edge_kinds_and_priors(spark, scratch):
    got = ranked(spark, scratch, ["m", "strong", "weak"], [("m", "strong", "contains"), ("m", "weak", "references")])
    assert got["strong"].rank_score > got["weak"].rank_score
    got = ranked(spark, scratch, [("login", 1, 1), "plain", "utils.ts", "utils.test.ts"], [])
    assert got["login"].rank_order == 1 and got["utils.test.ts"].rank_order == 4


def test_closure_flags(spark, scratch):
    edges = spark.createDataFrame([("b", "a", "imports"), ("c", "b", "imports"), ("a", "c", "route")], "from_path string, to_path string, kind string")
    anchors = spark.createDataFrame([("a",)], "anchor string")
    nodes = lambda **k: sorted(r.node for r in graph.transitive_dependents(edges, anchors, scratch, **k).collect())
    assert nodes() == ["b", "c"]
    assert nodes(routes=True, keep_anchor=True) == ["a", "b", "c"]
    assert nodes(routes=True) == ["b", "c"]


def test_trace_prunes_sinks_and_cycles(spark):
    symbols = spark.createDataFrame([(1, "main", "m.rs"), (2, "run", "r.rs"), (3, "save", "d.rs"), (4, "println", "p.rs")], "id long, name string, file_path string")
    edges = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (3, 1, "call"), (2, 4, "call"), (1, 3, "extends")], "from_id long, to_id long, kind string")
    got = graph.trace(symbols, edges, spark.createDataFrame([(1,)], "anchor long"), depth=9).orderBy("hops").collect()
    assert [(r.hops, r.name) for r in got] == [(0, "main"), (1, "run"), (2, "save")]
    strict = graph.trace(symbols, edges, spark.createDataFrame([(1,)], "anchor long"), kinds=("invokes",)).collect()
    assert [r.hops for r in strict] == [0]


def test_shared_neighbour_of_degree_five(spark):
    rows = spark.createDataFrame([(n, "w") for n in "uvxyz"], "node string, neighbour string")
    score = graph.adamic_adar(rows).where("a = 'u' and b = 'v'").first().score
    assert score == pytest.approx(1 / math.log(5)) and round(score, 3) == 0.621


def test_components(spark, scratch):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 300)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    want = {k: 0 for k in range(1, 31)} | {k: 100 for k in range(101, 140)} | {300: 200}
    assert {k: v for k, v in got.items() if k != v} == want


def test_components_without_edges(spark, scratch):
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_communities_of_two_cliques(spark, scratch):
    edges = [(f"{g}/{a}", f"{g}/{b}", "imports") for g in ("auth", "engine") for a in range(20) for b in range(20) if a < b]
    files = [(f"{g}/{k}",) for g in ("auth", "engine") for k in range(20)]
    e = spark.createDataFrame(edges, "from_path string, to_path string, kind string")
    nodes = graph.build_nodes(spark.createDataFrame(files, "path string"), e)
    found = scratch.keep(community.communities(nodes, e, scratch), "found")
    got = {r.path: r.community for r in found.collect()}
    assert {p: c.split("/")[0] for p, c in got.items()} == {p: p.split("/")[0] for p in got}
    told = community.summaries(found, nodes.selectExpr("path", "1.0 as rank_score"), e).collect()
    assert sorted((r.name, r.file_count, r.cohesion) for r in told) == [("auth", 20, 1.0), ("engine", 20, 1.0)]


def test_small_graph_is_one_community(spark, scratch):
    files = spark.createDataFrame([("a", 0), ("b", 0)], "path string, in_degree long")
    got = community.communities(files, spark.createDataFrame([], "from_path string, to_path string, kind string"), scratch).collect()
    assert {r.community for r in got} == {"a"}


def test_positions_and_retention(spark, scratch):
    rows = spark.range(1000).selectExpr("id", "id * 7919 % 1000 as x")
    got = with_position(rows, [F.col("x").asc()], scratch).collect()
    assert all(r.position == r.x + 1 for r in got)
    assert sorted(r.id for r in last_rows(rows, "id", 3).collect()) == [997, 998, 999]


GOLDEN = [("db.rs", 1, ["open"], None, 3, []), ("login.ts", 2, [], "/login", 1, ["db.rs"]), ("theme.ts", 3, ["useTheme"], None, 0, []), ("config/a.ts", 4, [], None, 0, []), ("config/b.ts", 5, [], None, 0, [])]


def manifest_rows(spark):
    rows = [(p, o, 1.0 / o, e, r, d, on) for p, o, e, r, d, on in GOLDEN]
    return spark.createDataFrame(rows, "path string, rank_order int, rank_score double, exports array<string>, route string, in_degree int, depends_on array<string>")


def test_manifest_text(spark):
    text = manifest.render(manifest_rows(spark), manifest.Options(), "app")
    assert text.split("\n")[1:4] == ["- /db.rs (Exports: open) (In: 3)", "- /login.ts (Route: /login) (Depends on: /db.rs)", "- /theme.ts (Exports: useTheme)"]
    text = manifest.render(manifest_rows(spark), manifest.Options(), "app", budget=3)
    assert "- /config/ (2 lower-ranked files)" in text and "a.ts" not in text
    text = manifest.render(manifest_rows(spark), manifest.Options(top_k=2, sort_by="alphabetical"), "app")
    assert "Showing 2 of 5 files" in text
    text = manifest.render(manifest_rows(spark), manifest.Options(scope="config"), "app")
    assert "- [#4] /config/a.ts" in text


def test_manifest_errors(spark):
    for options, code in ((manifest.Options(scope="nowhere"), "empty_scope"), (manifest.Options(min_rank=2.0), "empty_rank_filter")):
        with pytest.raises(manifest.ManifestError) as e:
            manifest.checked(manifest_rows(spark), options)
        assert e.value.code == code
