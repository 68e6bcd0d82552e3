import pytest

from graphloom.operators import graph, resolve
from graphloom.sources import extract, sinks

SYMBOLS = [(1, "a.ts", "A", "class"), (2, "b.ts", "B", "class"), (3, "b.ts", "run", "function"), (4, "a.ts", "run", "function"), (5, "c.ts", "AuthContext", "variable"), (6, "a.ts", "view", "component")]


def tables(spark):
    symbols = spark.createDataFrame(SYMBOLS, "id long, file_path string, name string, kind string")
    imports = spark.createDataFrame([("a.ts", 1, "b.ts"), ("a.ts", 2, "c.ts")], "from_path string, ordinal int, to_path string")
    return symbols, imports


def test_inheritance(spark):
    symbols, imports = tables(spark)
    rows = spark.createDataFrame([("a.ts", "A", "B", False), ("a.ts", "A", "Gone", True)], "file_path string, class string, parent string, is_implements boolean")
    assert [tuple(r) for r in resolve.inheritance_edges(rows, symbols, imports).collect()] == [(1, 2, "extends")]


def test_route_handlers(spark):
    symbols, imports = tables(spark)
    rows = spark.createDataFrame([("a.ts", "/x", "ctl.run", 3), ("a.ts", "/x", "other", 9), ("a.ts", "/y", "B.make", 1), ("a.ts", "/z", None, 1)], "file_path string, route string, handler string, line int")
    assert {r.route: r.id for r in resolve.route_handlers(rows, symbols, imports).collect()} == {"/x": 4, "/y": 2, "/z": None}


def test_context_and_channels(spark):
    symbols, imports = tables(spark)
    refs = spark.createDataFrame([("a.ts", 6, "useContext", 1), ("a.ts", 6, "AuthContext", 2), ("b.ts", 3, "AuthContext", 1)], "file_path string, from_id long, name string, ordinal int")
    assert [(r.from_id, r.to_id) for r in resolve.context_edges(refs, symbols, imports).collect()] == [(6, 5)]
    files = spark.createDataFrame([("a.ts", "bus.emit('go', 1)\n x"), ("b.ts", 'bus.on("go", run)')], "path string, content string")
    found = extract.channels(files)
    assert sorted((r.path, r.fact, r.channel, r.callback) for r in found.collect()) == [("a.ts", "emit", "go", ""), ("b.ts", "on", "go", "run")]
    paired = resolve.channel_edges(spark.createDataFrame([("go", 1)], "channel string, id long"), spark.createDataFrame([("go", 3), ("no", 4)], "channel string, id long"))
    assert [(r.from_id, r.to_id, r.site) for r in paired.collect()] == [(1, 3, "EventEmitter: go")]


def test_presets(spark, scratch):
    nodes = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.1), ("c", 0, 0.9), ("d", 0, 0.1)], "path string, n_routes int, rank_score double")
    edges = spark.createDataFrame([("b", "a", "imports"), ("d", "b", "imports")], "from_path string, to_path string, kind string")
    home = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "path string, community int")
    got = lambda name: sorted(r.path for r in graph.preset(name, "a", nodes, edges, home, scratch).collect())
    assert got("bug-fix") == ["a", "b"] and got("refactor") == ["a", "b", "c", "d"] and got("feature") == ["b", "c"]
    with pytest.raises(ValueError):
        got("none")


def test_versions_flip(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        sinks.load_tables(spark, ["x"], root)
    for n in (1, 2):
        sinks.save_tables(spark, {"x": spark.range(n)}, root)
        assert sinks.load_tables(spark, ["x"], root)["x"].count() == n


def test_recent_projects(spark):
    rows = [("c:\\x\\", 1), ("C:/x", 5), ("/p/", 3), ("/q", 2)]
    got = sinks.recent_projects(spark.createDataFrame(rows, "path string, opened_at long"), 2)
    assert [(r.path, r.opened_at) for r in got.collect()] == [("C:/x", 5), ("/p", 3)]
