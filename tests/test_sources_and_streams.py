import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import resolve, slicing, telemetry
from graphloom.sources import extract, scan
from graphloom.streaming import live


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in {"src/a.py": "import os\n", "node_modules/x.js": "x", ".env": "K=1", "logs/out.txt": "x", "big.ts": "a" * 1_000_001}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: r for r in scan.scan(spark, str(tmp_path), ["logs/", "# note"]).collect()}
    assert sorted(got) == ["big.ts", "src/a.py"]
    assert got["src/a.py"].content == "import os\n" and got["src/a.py"].language == "python"
    assert got["big.ts"].content is None and got["big.ts"].warning == "skipped_large_file"


def test_tree(spark):
    rows = scan.tree(spark.createDataFrame([("a/b/c.py",), ("a/d.py",)], "path string")).collect()
    assert sorted((r.path, r.depth, r.is_dir) for r in rows) == [("a", 0, True), ("a/b", 1, True), ("a/b/c.py", 2, False), ("a/d.py", 1, False)]


def test_saved_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"schema_version": 1, "nodes": [{"path": "a"}], "edges": [{"from_path": "a", "to_path": "b", "kind": "import"}], "external_dependencies": ["react"]}')
    got = scan.read_graph(spark, str(tmp_path / "g.json"))
    assert got["nodes"].first().path == "a" and got["external_dependencies"].first().name == "react"
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(ValueError):
        scan.read_graph(spark, str(tmp_path / "bad.json"))


def test_git_status(spark):
    rows = spark.createDataFrame([(" M a.py",), ("?? b.py",), ("R  old.py -> new.py",), (" D c.py",), ("A  d.py",)], "value string")
    assert {r.path: r.status for r in scan.git_status(rows).collect()} == {"a.py": "modified", "b.py": "untracked", "new.py": "modified", "c.py": "deleted", "d.py": "added"}


def test_aliases():
    got = scan.path_aliases('{ // note\n "compilerOptions": {"baseUrl": "./app", "paths": {"@/*": ["./src/*"], "x": ["lib//x"],}} }')
    assert got[0] == ("@/*", "app/src/*", 0) and got[-1][0] == "*"
    assert scan.path_aliases(None)[0] == ("@/*", "src/*", 0)


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("src/x.ts",), ("src/x/index.ts",), ("src/y/index.ts",), ("lib/z.py",)], "path string")
    rows = [("a.ts", 1, "javascript", "./x", "src/x", False, "imports"), ("a.ts", 2, "javascript", "@/y", None, True, "imports"), ("a.ts", 3, "javascript", "react/jsx", None, True, "imports"), ("a.ts", 4, "javascript", "./gone", "src/gone", False, "imports")]
    imports = spark.createDataFrame(rows, "from_path string, ordinal int, language string, raw string, resolved string, external boolean, kind string")
    aliases = spark.createDataFrame([("@/*", "src/*", 0)], "pattern string, target string, alias_order int")
    found = resolve.resolve_imports(imports, files, aliases)
    assert {r.ordinal: r.to_path for r in found.collect()} == {1: "src/x.ts", 2: "src/y/index.ts"}
    assert [r.package for r in resolve.external_packages(imports, found).collect()] == ["react"]
    assert [r.kind for r in resolve.unresolved(imports, found).collect()] == ["unresolved_import:./gone"]


def test_enclosing_prefers_the_narrowest(spark):
    spans = spark.createDataFrame([(1, "f", 1, 100), (2, "f", 10, 20), (3, "f", 12, 22)], "id long, file string, low int, high int")
    points = spark.createDataFrame([("f", 15), ("f", 50), ("g", 1), ("f", 15)], "file string, line int")
    got = sorted((r.file, r.line, r.id) for r in resolve.enclosing(points, spans, "file", "line", "low", "high", "id").fillna(-1).collect())
    assert got == [("f", 15, 2), ("f", 15, 2), ("f", 50, 1), ("g", 1, -1)]


def test_dispatch(spark):
    symbols = spark.createDataFrame([(1, "i.ts", "Shape", "interface"), (2, "i.ts", "area", "method"), (3, "c.ts", "Circle", "class"), (4, "c.ts", "area", "method"), (5, "m.ts", "main", "function")], "id long, file_path string, name string, kind string")
    edges = spark.createDataFrame([(5, 2, "calls"), (3, 1, "implements")], "from_id long, to_id long, kind string")
    assert [(r.from_id, r.to_id) for r in resolve.dispatch_edges(symbols, edges).collect()] == [(5, 4)]


def test_collapsed_endpoints_and_explore(spark):
    symbols = spark.createDataFrame([(1, "s.ts", "store", "function"), (2, "a.ts", "load", "variable"), (3, "b.ts", "run", "function"), (4, "s.ts", "x", "variable")], "id long, file_path string, name string, kind string")
    edges = spark.createDataFrame([(2, 1, "calls"), (3, 1, "calls"), (4, 1, "calls")], "from_id long, to_id long, kind string")
    got = slicing.explore(symbols, edges, spark.createDataFrame([(1,)], "anchor long")).collect()
    assert sorted(r.edge for r in got) == ["a.ts -references-> s.ts#store", "b.ts#run -calls-> s.ts#store"]


CODE = {
    "a.py": ("python", 'import os\nfrom .x import y\nclass A(B):\n    def m(self):\n        return y\ndef f():\n    pass\ns = "class Ghost: pass"\n'),
    "b.ts": ("javascript", 'import { x } from "./x";\n// class Ghost {}\nexport class Big extends Base {\n  go() { return "function no() {}"; }\n}\nexport function top() {\n  return 1;\n}\n'),
    "c.rs": ("rust", "use crate::a;\npub struct S {\n  x: u8,\n}\npub fn run() {\n}\n"),
    "d.vue": ("sfc", "<template><p/></template>\n<script>\nimport z from './z'\nfunction inner() {\n}\n</script>\n"),
    "e.py": ("python", "def (:\nimport late\n"),
    "f.txt": ("other", "class No {}"),
}


def test_code_facts(spark):
    files = spark.createDataFrame([(p, lang, t) for p, (lang, t) in CODE.items()] + [("n.py", "python", None)], "path string, language string, content string")
    got = {(r.path, r.fact, r.name, r.start_line, r.end_line) for r in extract.code_facts(files).collect()}
    assert {("a.py", "symbol", "A", 3, 5), ("a.py", "symbol", "m", 4, 5), ("a.py", "symbol", "f", 6, 7), ("a.py", "import", "os", 1, 1), ("a.py", "import", ".x", 2, 2), ("a.py", "reference", "y", 5, 5)} <= got
    assert {("b.ts", "symbol", "Big", 3, 5), ("b.ts", "symbol", "top", 6, 8), ("b.ts", "import", "./x", 1, 1)} <= got
    assert {("c.rs", "symbol", "S", 2, 4), ("c.rs", "symbol", "run", 5, 6), ("d.vue", "import", "./z", 3, 3), ("d.vue", "symbol", "inner", 4, 5)} <= got
    assert {("e.py", "warning", "parse_error", 1, 1), ("e.py", "import", "late", 2, 2)} <= got
    assert not [r for r in got if r[2] in ("Ghost", "No", "no")]


FACTS = {
    "javascript": ("import {a} from './x';\nexport const f = <T, U>(x: T) => go(x), k = 2;\nexport const { p, q: r, ...rest } = obj;\nexport default class Foo extends Base<T> implements A<B, C>, D {\n  run() { return `hi ${who(1)}`; } // ghost\n}\nexport { u, v as w } from './m';\n",
                   {("export", x) for x in ("f", "k", "p", "r", "rest", "default", "u", "w")}, {("extends", "Foo", "Base"), ("implements", "Foo", "A"), ("implements", "Foo", "D")}, {("go", 2), ("who", 5), ("obj", 3)}),
    "java": ("package com.x;\nclass S extends Base<T> implements Runnable, java.io.Closeable {\n  void f() { helper.call(); }\n}\n", {("export", "package:com.x"), ("export", "S")}, {("extends", "S", "Base"), ("implements", "S", "Runnable"), ("implements", "S", "Closeable")}, {("helper", 3), ("call", 3)}),
    "kotlin": ("class C(val x: Int = f(1)) : Base(x, g(2)), Face {\n fun m() { println(\"${calc(y)}\") }\n}\n", {("export", "C"), ("export", "m")}, {("extends", "C", "Base"), ("implements", "C", "Face")}, {("calc", 2), ("println", 2)}),
    "csharp": ("class C : Base<int, X>, IFace {\n void F() { Log(1); }\n}\n", {("export", "C")}, {("extends", "C", "Base"), ("implements", "C", "IFace")}, {("Log", 2)}),
    "swift": ("class C: Base, P {\n}\n", {("export", "C")}, {("extends", "C", "Base"), ("implements", "C", "P")}, {("Base", 1)}),
    "cpp": ("class C : public Base, private ns::Other<int> {\n};\n", {("export", "C")}, {("extends", "C", "Base"), ("extends", "C", "Other")}, {("ns", 1)}),
    "rust": ("pub fn f<'a>(x: &'a str) -> &'a str { call(x) }\nfn private() {}\nimpl<T> fmt::Display for S { }\nimpl S { }\n", {("export", "f")}, {("implements", "S", "Display")}, {("call", 1)}),
    "go": ("package main\nfunc Run() { helper() }\nfunc low() {}\n", {("export", "package:main"), ("export", "Run")}, set(), {("helper", 2)}),
    "php": ("<?php\nclass U extends Base implements A, \\N\\B {\n function f() { return helper($x); }\n}\n", {("export", "U"), ("export", "f")}, {("extends", "U", "Base"), ("implements", "U", "A"), ("implements", "U", "B")}, {("helper", 3)}),
    "python": ("class A(B):\n  def m(self):\n    return y\ndef f(): pass\ndef _g(): pass\n", {("export", "A"), ("export", "f")}, {("extends", "A", "B")}, {("y", 3)}),
}


def test_exports_parents_and_references(spark):
    files = spark.createDataFrame([(k, k, t) for k, (t, *_) in FACTS.items()], "path string, language string, content string")
    rows = extract.code_facts(files).collect()
    for k, (_, exports, parents, used) in FACTS.items():
        own = [r for r in rows if r.path == k]
        assert {(r.fact, r.name) for r in own if r.fact == "export"} == exports, k
        assert {(r.fact, r.name, r.detail) for r in own if r.fact in ("extends", "implements")} == parents, k
        assert used <= {(r.name, r.start_line) for r in own if r.fact == "reference"}, k
        assert not {"ghost", "return"} & {r.name for r in own if r.fact == "reference"}


def test_framework_routes(spark):
    file = lambda text: spark.createDataFrame([("f", text)], "path string, content string")
    routes = lambda df: sorted((r.route, r.handler, r.line) for r in df.collect())
    assert routes(extract.minimal_api_routes(file('app.MapGet("/a", Get);\n// app.MapPut("/no", X)\napp.MapPost("/b", async x => 1);'))) == [("/a", "Get", 1), ("/b", None, 3)]
    assert routes(extract.rust_routes(file('Router::new().route("/a", get(h::one)).route("/b", post(two))\n.at("no", get(x))'))) == [("/a", "h::one", 1), ("/b", "two", 1)]
    assert routes(extract.php_routes(file("#[Route('/a', name: 'x')]\n#[Other]\npublic function show() {}\n$app->get('/b', 'skip');\n$app->post('/c', make);\n#[Route('/no')]\n$x = 1;\n"))) == [("/a", "show", 1), ("/b", None, 4), ("/c", "make", 5)]
    java = '@Controller("/base")\npublic class A {\n  @Get("/x")\n\n  @Other\n  public Res index(int a) {}\n  @Get\n  int field;\n  void no() {}\n}\n'
    assert routes(extract.annotated_routes(file(java))) == [("/base/x", "index", 3)]
    assert routes(extract.annotated_routes(file('@Path("/r")\nclass B {\n @GET\n @Path("{id}")\n fun one(id: Int) {}\n @POST\n fun two() {}\n}\n'))) == [("/r", "two", 6), ("/r/{id}", "one", 3)]
    facts = spark.createDataFrame([("f", "symbol", "one", "function", 5, 5)], extract.ROW)
    added = extract.handler_symbols(extract.rust_routes(file('.route("/a", get(one))\n.route("/b", get(m::two))\n.route("/c", get(m::two))')), facts)
    assert sorted((r.name, r.start_line) for r in added.collect()) == [("one", 5), ("two", 2)]
    names = ["app/routes/posts.$id.tsx", "routes/_index.tsx", "src/routes/a/_auth.$.ts", "x/lib/routes/a.ts", "app/routes/style.css"]
    rows = spark.createDataFrame(list(enumerate(names)), "k int, path string").select("k", extract.remix_route(F.col("path")).alias("r")).orderBy("k").collect()
    assert [r.r for r in rows] == ["/posts/:id", "/", "/a/*", None, None]


def test_line_languages(spark):
    file = lambda text: spark.createDataFrame([("f", text)], "path string, content string")
    names = lambda df: sorted((r.fact, r.name) for r in df.collect())
    assert names(extract.sql_facts(file("CREATE TABLE IF NOT EXISTS users (id int);\n x int REFERENCES teams(id)"))) == [("export", "users"), ("import", "teams")]
    assert names(extract.prisma_facts(file("model User {\n  team Team @relation(fields: [a])\n}"))) == [("export", "User"), ("import", "Team")]
    assert names(extract.dockerfile_facts(file("FROM --platform=x node:20\nCOPY --from=b src/ /app"))) == [("external", "node:20"), ("import", "src/")]
    assert [r.route for r in extract.graphql_routes(file("type Query {\n  user(id: ID): User\n}\ntype User {\n  name: String\n}")).collect()] == ["Query.user"]
    assert [(r.method, r.route, r.handler) for r in extract.router_calls(file('app.get("/users", list)\nfoo.get("/no", x)')).collect()] == [("GET", "/users", "list")]
    assert [(r.route, r.handler) for r in extract.decorated_routes(file('@app.route("/a")\n@app.get("/b")\ndef show():\n  pass\n')).collect()] == [("/a", "show"), ("/b", "show")]


def test_routes_of_paths(spark):
    names = ["app/users/[id]/page.tsx", "src/app/(shop)/[...all]/route.ts", "app/_private/page.tsx", "pages/index.tsx", "pages/blog/[slug].tsx", "lib/x.ts"]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, path string").select("k", extract.route_of_path(F.col("path")).alias("r")).orderBy("k").collect()
    assert [r.r for r in rows] == ["/users/:id", "/:all*", None, "/", "/blog/:slug", None]


def test_html_and_markdown(spark):
    page = spark.createDataFrame([(1, '<a href="/x" id="top"><img src="http://e.com/i"></a>')], "k int, html string")
    assert sorted((r.fact, r.name) for r in extract.html_facts(page, "k", F.col("html")).collect()) == [("export", "id:top"), ("external", "http://e.com/i"), ("import", "/x")]
    doc = spark.createDataFrame([(1, "[a](b.md#s) [c](https://x) [d](#e)")], "k int, t string")
    assert [r.target for r in extract.markdown_links(doc, "k", F.col("t")).collect()] == ["b.md"]


def test_turns(spark):
    calls = spark.createDataFrame([("u", 1, 0), ("u", 2, 3000), ("u", 3, 6001), ("v", 4, 0)], "k string, id int, ms long")
    got = telemetry.with_turns(calls, "k", F.col("ms"), ["ms"]).orderBy("id").collect()
    assert [r.turn_id for r in got] == [1, 1, 2, 1]


def test_smoothing(spark):
    rows = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, None)], "k string, n int, v double")
    assert {r.k: r.ema for r in telemetry.smoothed(rows, "k", "n", "v").collect()} == {"a": 13.0, "b": None}


def test_smoothing_equals_a_fold_without_arrays(spark, capsys):
    runs = {"a": [1.0, 5.0, 2.5, 8.0, 0.5], "b": [3.0, None, 4.0, 6.0], "c": [1.0, None], "d": [7.0], "e": [float(k % 17) for k in range(3000)]}
    rows = spark.createDataFrame([(k, n, v) for k, values in runs.items() for n, v in enumerate(values)], "k string, n int, v double").repartition(3)
    want = {}
    for k, values in runs.items():
        done = None
        for x in values:
            done = x if done is None else None if x is None else 0.3 * x + 0.7 * done
        want[k] = done
    got = telemetry.smoothed(rows, "k", "n", "v")
    assert {r.k: r.ema for r in got.collect()} == {k: x if x is None else round(x, 6) for k, x in want.items()}
    got.explain()
    assert "collect_list" not in capsys.readouterr().out


def test_pending_and_debounce(spark):
    marks = spark.createDataFrame([("a", 0), ("a", 100), ("b", 0)], "path string, marked_at long")
    assert sorted(r.path for r in live.due(marks, 200).collect()) == ["b"]
    assert sorted(r.path for r in live.due(marks, 250).collect()) == ["a", "b"]
    assert live.debounce_ms(1) == 50 and live.debounce_ms(None) == 150


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [("f", base), ("f", base + dt.timedelta(minutes=20)), ("f", base + dt.timedelta(hours=2)), ("z", base + dt.timedelta(days=2))]
    data = spark.createDataFrame(rows, "path string, at timestamp")
    data.write.parquet(str(tmp_path / "in"))
    batch = {(r.path, r.first_at, r.n_marks) for r in live.bursts(data, "path", "at", "30 minutes").collect()}
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    live.run_to(live.bursts(stream, "path", "at", "30 minutes"), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    got = {(r.path, r.first_at, r.n_marks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r for r in batch if r[0] != "z"} and len(got) == 2


def test_incremental_equals_full(spark):
    before = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "file_path string, fact string")
    after = spark.createDataFrame([("a", "x2"), ("c", "z"), ("d", "new")], "file_path string, fact string")
    snap = lambda rows: spark.createDataFrame(rows, "path string, size_bytes long, mtime long")
    known, found = snap([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]), snap([("a", 2, 1), ("c", 1, 1), ("d", 1, 1)])
    changes = live.reconcile(known, found)
    assert {r.path: r.change for r in changes.collect()} == {"a": "changed", "b": "deleted", "d": "added"}
    assert live.needs_full_build(known, changes)
    edges = spark.createDataFrame([("c", "a")], "from_path string, to_path string")
    assert sorted(r.path for r in live.affected(changes, edges).collect()) == ["a", "b", "c", "d"]
    got = live.replaced(before, "file_path", changes, after)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, after.collect()))
