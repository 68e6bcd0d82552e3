from pyspark.sql import functions as F

from graphloom.functions import paths, text


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_secret_names(spark):
    names = [".env", ".env.local", ".env.example", "server.PEM", "id_rsa", "main.py", "credentials", "key.txt"]
    assert column(spark, names, paths.is_secret) == [True, True, False, True, True, False, True, False]


def test_languages(spark):
    names = ["a/b.tsx", "Cargo.toml", "Dockerfile.prod", "api.dockerfile", "x.H", "README.md", "noext", ".gitignore", "App.vue"]
    assert column(spark, names, paths.language) == ["javascript", "rust", "dockerfile", "dockerfile", "c", "markdown", "other", "other", "sfc"]


def test_index_filter(spark):
    names = ["src/a.py", "node_modules/x.js", "a/dist/b.js", "dist", "yarn.lock", "logo.png", "deep/.env"]
    assert column(spark, names, paths.is_indexed) == [True, False, False, True, False, False, False]


def test_tests_entry_points_and_hubs(spark):
    assert column(spark, ["src/a.test.ts", "tests/x.py", "src\\tests\\x.py", "src/latest.py"], paths.is_test) == [True, True, True, False]
    assert column(spark, ["src/main.rs", "src/bin/x.rs", "src/mainx.rs"], paths.is_entry_point) == [True, True, False]
    hub = lambda v: paths.is_dampened_hub(v, F.lit(4), F.lit(20))
    assert column(spark, ["a/utils.ts", "a/x.ts"], hub) == [True, True]
    assert column(spark, ["a/x.ts"], lambda v: paths.is_dampened_hub(v, F.lit(3), F.lit(20))) == [False]


def test_scopes(spark):
    for scope in ("src", "./src/", "src/**", "src/*"):
        assert column(spark, ["src", "src/a", "srcs/a"], lambda v, s=scope: paths.in_scope(v, s)) == [True, True, False]


def test_joined_paths(spark):
    joined = lambda v: paths.joined(F.lit("src/app"), v)
    assert column(spark, ["./x", "../y", "../../../z", "a/./b"], joined) == ["src/app/x", "src/y", None, "src/app/a/b"]


def test_candidates_of_rust_and_go(spark):
    rust = lambda v: paths.candidates(F.lit("rust"), v)
    assert column(spark, ["a/b", "b"], rust) == [["a/b", "a/b.rs", "a/b/mod.rs", "a.rs", "a/mod.rs"], ["b", "b.rs", "b/mod.rs"]]
    assert column(spark, ["a/b", "b"], lambda v: paths.candidates(F.lit("go"), v)) == [["a/b", "a/b.go", "a/b/b.go"], ["b", "b.go", "b/b.go"]]


def test_package_names(spark):
    assert column(spark, ["@s/p/x", "react/jsx", "@s"], lambda v: paths.package_name(F.lit("javascript"), v)) == ["@s/p", "react", "@s"]
    assert column(spark, ["os.path"], lambda v: paths.package_name(F.lit("python"), v)) == ["os"]


def test_rfc3339(spark):
    assert spark.range(1).select(paths.rfc3339(F.lit(1784332800))).first()[0] == "2026-07-18T00:00:00Z"


def test_identifier_tokens(spark):
    got = column(spark, ["useGraphStore", "HTTPServer", "router", "user_controller", "a_b", ""], text.identifier_tokens)
    assert got == [["useGraphStore", "use", "Graph", "Store"], ["HTTPServer", "HTTP", "Server"], ["router"], ["user_controller", "user", "controller"], ["a_b"], [""]]


def test_query_prefixes():
    assert text.query_prefixes("useGraphStore") == ["usegraphstore", "use", "graph", "store"]
    assert text.query_prefixes("auth service!") == ["auth", "service"]
    assert text.query_prefixes("a ?") == []


def test_signatures(spark):
    source = "pub fn init(\n  a: u8,\n) -> R {\n  body\n}"
    assert spark.range(1).select(text.signature(F.lit(source), F.lit(1), F.lit(5))).first()[0] == "pub fn init(\n  a: u8,\n) -> R"
    assert spark.range(1).select(text.signature(F.lit("a\nb\nc\nd\ne\nf\ng"), F.lit(1), F.lit(7))).first()[0] == "a\nb\nc\nd\ne\nf"
    assert spark.range(1).select(text.signature(F.lit("a"), F.lit(5), F.lit(7))).first()[0] == ""


def test_snippets_and_numbers(spark):
    assert spark.range(1).select(text.snippet(F.lit("a\nHit\nb\nc"), "hit")).first()[0] == "a\nHit\nb"
    assert spark.range(1).select(text.snippet(F.lit("a\nb\nc"), "none")).first()[0] == "a\nb"
    assert spark.range(1).select(text.numbered(F.lit("a\nb\n"), F.lit(2), F.lit(9))).first()[0] == "   2: b"


def test_methods(spark):
    assert column(spark, ["POST /x", "/users", "x [delete]", "/posts"], text.http_method) == ["POST", "GET", "DELETE", "POST"]
