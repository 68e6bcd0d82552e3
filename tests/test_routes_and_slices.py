"""Routes of nested blocks and of files, slices by lines, the answer's budget, domain exports."""

from graphloom.operators import community, resolve, slicing
from graphloom.sources import declared


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_nested_routes_follow_blocks(spark):
    text = "\n".join([
        "fun m() {",
        "  routing {",
        '    // route("/no") {',
        '    route("/a") {',
        "      if (x) {",
        '        get("/1") { }',
        "      } else {",
        '        post("/2") { }',
        "      }",
        "    }",
        '    put("/3") { }',
        '    budget("/4") { }',
        "  }",
        '  get("/5") { }',
        "}",
    ])
    files = spark.createDataFrame([("a.kt", text), ("b.kt", 'get("/x") { }'), ("c.kt", None), ("d.kt", "")], "path string, content string")
    assert rows(declared.nested_routes(files), "path", "line", "route") == [("a.kt", 6, "/a/1"), ("a.kt", 8, "/a/2"), ("a.kt", 11, "/3")]


def test_nested_routes_of_an_empty_table(spark):
    assert declared.nested_routes(spark.createDataFrame([], "path string, content string")).count() == 0


def test_file_route_handlers(spark):
    routes = spark.createDataFrame([("r.ts", "/r"), ("p.tsx", "/p"), ("p.tsx", "/p")], "path string, route string")
    exports = spark.createDataFrame([("r.ts", "POST"), ("r.ts", "GET"), ("r.ts", "GET"), ("r.ts", "default"), ("p.tsx", "default"), ("p.tsx", None)], "path string, name string")
    assert rows(declared.file_route_handlers(routes, exports).fillna("-"), "path", "handler") == [("p.tsx", "-"), ("r.ts", "GET"), ("r.ts", "POST")]
    module = declared.file_route_handlers(routes, exports, declared.MODULE_HANDLERS, "default")
    assert rows(module, "path", "handler") == [("p.tsx", "default"), ("r.ts", "default")]


def test_symbol_slices_by_lines(spark):
    files = spark.createDataFrame([("a", "def f(\n  x):\n  return 1\n"), ("b", None), ("c", "")], "file_path string, content string")
    symbols = spark.createDataFrame([(1, "a", 1, 3), (2, "a", 3, 9), (3, "a", 7, 9), (4, "b", 1, 2), (5, "gone", 1, 2), (6, "a", 0, 1), (7, "c", 1, 1), (8, "a", 2, 20_000_000)], "id long, file_path string, start_line int, end_line int")
    got = {r.id: (r.signature, r.code) for r in slicing.symbol_slices(symbols, files).collect()}
    assert got == {
        1: ("def f(\n  x):", "   1: def f(\n   2:   x):\n   3:   return 1"),
        2: ("  return 1", "   1:   return 1"),
        3: ("", ""),
        4: ("", ""),
        6: ("def f(", "   1: def f("),
        7: ("", "   1: "),
        8: ("  x):", "   1:   x):\n   2:   return 1"),
    }
    assert slicing.symbol_slices(symbols, files, of_file=True).where("id = 8").first().code == "   2:   x):\n   3:   return 1"


def test_answers_within_a_budget(spark):
    slices = spark.createDataFrame([(1, "sig", "x" * 37), (2, "a", "y" * 370), (2, "b", "z")], "anchor int, signature string, code string")
    got = rows(slicing.within_budget(slices, "anchor", budget=50), "anchor", "shortened", "text")
    assert got == [(1, False, "x" * 37), (2, True, "a"), (2, True, "b")]
    assert not slicing.within_budget(slices, "anchor", budget=50, whole=True).where("shortened").count()


def test_key_exports_of_the_hub(spark):
    membership = spark.createDataFrame([("a/x", "a"), ("a/y", "a"), ("b/z", "b")], "path string, community string")
    ranks = spark.createDataFrame([("a/x", 0.1), ("a/y", 0.9), ("b/z", 0.5)], "path string, rank_score double")
    edges = spark.createDataFrame([("a/x", "a/y", "imports")], "from_path string, to_path string, kind string")
    names = spark.createDataFrame([("a/y", k, n) for k, n in enumerate(["p", "q", "p", "r", "s"])] + [("a/x", 0, "no")], "path string, ordinal int, name string")
    assert rows(community.summaries(membership, ranks, edges, names), "community", "top_hub", "key_exports") == [("a", "a/y", ["p", "q", "r"]), ("b", "b/z", [])]


def test_first_import_answers_and_the_own_file_first(spark):
    symbols = spark.createDataFrame([(1, "a", "f"), (2, "b", "g"), (3, "c", "g"), (4, "c", "f")], "id long, file_path string, name string")
    imports = spark.createDataFrame([("a", 2, "b"), ("a", 1, "c")], "from_path string, ordinal int, to_path string")
    routes = spark.createDataFrame([("a", "/f", "f", 1), ("a", "/g", "x.g", 2), ("a", "/g", "f", 3), ("a", "/none", None, 4)], "file_path string, route string, handler string, line int")
    assert rows(resolve.route_handlers(routes, symbols, imports).fillna(-1), "route", "id") == [("/f", 1), ("/g", 3), ("/none", -1)]
