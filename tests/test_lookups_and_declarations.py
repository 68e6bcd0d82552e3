import os
import threading

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lookup, manifest, resolve, telemetry
from graphloom.operators.ordering import first_by, running_totals
from graphloom.sources import declared, scan, sinks
from graphloom.streaming import live

SYMBOLS = [(1, "src/a.ts", "load", "function"), (2, "src/b.ts", "load", "function"), (3, "/src/c.ts", "Loader", "class"), (4, "lib/src/a.ts", "save", "function")]


def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "id long, file_path string, name string, kind string")


def test_lookups(spark):
    own = symbols(spark)
    asked = spark.createDataFrame([("load",), ("LOAD",), ("none",)], "asked string")
    assert sorted((r.asked, r.id) for r in lookup.by_name(own, asked).collect()) == [("load", 1)]
    assert sorted(r.id for r in lookup.by_name(own, asked, 3).collect()) == [1, 2]
    assert sorted((r.asked, r.id) for r in lookup.anchors(own, asked).collect()) == [("LOAD", 1), ("LOAD", 2), ("LOAD", 3), ("load", 1), ("load", 2)]
    paths = spark.createDataFrame([("/src/a.ts", "load"), ("src/c.ts", "Loader"), ("src/b.ts", "x")], "path string, name string")
    assert sorted(r.id for r in lookup.by_path(own, paths).collect()) == [1, 3]


def test_activity_targets(spark):
    calls = spark.createDataFrame([(1, "./src/a.ts#load", None), (2, "/home/src/b.ts", None), (3, None, "save"), (4, "", "")], "call int, path string, symbol string")
    nodes = spark.createDataFrame([("src/a.ts",), ("lib/src/a.ts",), ("src/b.ts",), ("xsrc/a.ts",)], "path string")
    got = {}
    for r in lookup.activity_targets(calls, nodes, symbols(spark)).collect():
        got.setdefault(r.call, set()).add(r.target)
    assert got[1] == {"src/a.ts", "src/a.ts#load", "lib/src/a.ts", "lib/src/a.ts#load", "src/b.ts", "src/b.ts#load"}
    assert got[2] == {"home/src/b.ts", "src/b.ts"} and got[3] == {"lib/src/a.ts", "lib/src/a.ts#save"} and 4 not in got


FILES = {
    "s.ts": ("javascript", "import { create } from 'zustand'\nexport const useStore = create<S>()(x)\n// const old = create()\nconst recreate = make(1)"),
    "m.ts": ("javascript", "import { pgTable } from 'drizzle-orm/pg-core'\nimport { Entity } from 'typeorm'\nexport const users = pgTable('users', {})\n@Entity()\n@Index(['x'])\nexport class Invoice {}\n@Entity()\nconst gap = 1\nclass NotOne {}"),
    "t.ts": ("javascript", "import { router } from '@trpc/server'\n  getUser: publicProcedure.query(() => 1),"),
    "w.py": ("python", "import celery\ncelery_app = Celery('x')\n@celery_app.task(bind=True)\nasync def send(self):\n    pass"),
    "p.py": ("python", "from sqlalchemy.orm import DeclarativeBase\nclass User(DeclarativeBase):\n    pass\nclass Other(object):\n    pass"),
    "c.rs": ("rust", "pub static PENDING: Mutex<u8> = x;\nlet (tx, mut rx) = mpsc::channel(32);\n// static OLD: u8 = 1;\nuse sqlx::FromRow;\n#[derive(Debug, FromRow)]\npub struct Row { }"),
    "g.go": ("go", 'import "gorm.io/gorm"\nvar events = make(chan Event)\ntype User struct {\n\tgorm.Model\n}\ntype Plain struct {\n\tX int\n}'),
    "J.java": ("java", "import jakarta.persistence.Entity;\n@Entity\npublic class Person {}"),
    "D.cs": ("csharp", "class Db : DbContext {\n  public DbSet<Order> Orders { get; set; }\n}"),
    "U.php": ("php", "use Illuminate\\Database\\Eloquent\\Model;\nclass Post extends Model {}"),
    "none.ts": ("javascript", None),
}


def test_declarations(spark):
    files = spark.createDataFrame([(p, lang, text) for p, (lang, text) in FILES.items()], "path string, language string, content string")
    got = sorted((r.path, r.kind, r.name, r.line) for r in declared.declarations(files).collect())
    assert got == sorted([
        ("s.ts", "state_store", "useStore", 2), ("m.ts", "database_schema", "users", 3), ("m.ts", "database_schema", "Invoice", 4), ("t.ts", "route", "getUser", 2),
        ("w.py", "state_store", "celery_app", 2), ("w.py", "state_store", "send", 3), ("p.py", "database_schema", "User", 2),
        ("c.rs", "state_store", "PENDING", 1), ("c.rs", "state_store", "tx", 2), ("c.rs", "state_store", "rx", 2), ("c.rs", "database_schema", "Row", 5),
        ("g.go", "state_store", "events", 2), ("g.go", "database_schema", "User", 3), ("J.java", "database_schema", "Person", 2), ("D.cs", "database_schema", "Order", 2), ("U.php", "database_schema", "Post", 2),
    ])
    own = spark.createDataFrame([("s.ts", "useStore", "variable", 2, 9), ("s.ts", "x", "function", 1, 1)], "path string, name string, kind string, start_line int, end_line int")
    after = {(r.path, r.name): (r.kind, r.start_line, r.end_line) for r in declared.apply_declarations(own, declared.declarations(files)).collect()}
    assert after["s.ts", "useStore"] == ("state_store", 2, 9) and after["s.ts", "x"][0] == "function" and after["w.py", "send"] == ("state_store", 3, 3)


def test_go_routes_and_missing_handlers(spark):
    text = 'e.GET("/a", home)\napi := e.Group("/v1")\napi.Post("/b", ctl.Save)\n// api.GET("/no", x)\n// @router /c [get]\n\nfunc (c *C) Show() {}\n// @router /gone [get]\nvar x = 1\nfunc F() {}'
    routes = declared.go_routes(spark.createDataFrame([("m.go", text)], "path string, content string"))
    assert sorted((r.route, r.handler, r.line) for r in routes.collect()) == [("/a", "home", 1), ("/c", "Show", 5), ("/v1/b", "ctl.Save", 3)]
    own = spark.createDataFrame([("m.go", "Show")], "path string, name string")
    assert sorted((r.name, r.start_line) for r in declared.missing_handlers(routes, own).collect()) == [("ctl.Save", 3), ("home", 1)]


def test_ignore_files_of_folders_and_unread_content(spark, tmp_path):
    for name, text in {".gitignore": "logs/\n*.tmp\n!keep.tmp", "logs/a.txt": "x", "a.tmp": "x", "keep.tmp": "k", "sub/.ignore": "/only.py", "sub/only.py": "x", "sub/deep/only.py": "y", "app/[id]/page.tsx": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("y" * 100)
    got = {r.path: r.content for r in scan.scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == [".gitignore", "app/[id]/page.tsx", "keep.tmp", "sub/.ignore", "sub/deep/only.py"]
    assert got["app/[id]/page.tsx"] == "z"


def test_readers_never_meet_a_gap(spark, tmp_path):
    root, found, stop = str(tmp_path / "store"), [], threading.Event()
    sinks.save_tables(spark, {"x": spark.range(1)}, f"file://{root}")

    def watch():
        while not stop.is_set():
            found.append(any(x.startswith("CURRENT-") for x in os.listdir(root)))

    thread = threading.Thread(target=watch)
    thread.start()
    for n in range(3):
        sinks.save_tables(spark, {"x": spark.range(n)}, f"file://{root}")
    stop.set()
    thread.join()
    assert all(found) and sinks.load_tables(spark, ["x"], f"file://{root}")["x"].count() == 2
    sinks.append_tables(spark, {"x": spark.range(3).withColumn("y", F.lit("a"))}, f"file://{root}")
    assert sinks.load_tables(spark, ["x"], f"file://{root}")["x"].where("y is null").count() == 2
    written = {x for x in os.listdir(root) if not x.startswith((".", "CURRENT"))}
    version = sinks.append_tables(spark, {"x": spark.range(4), "z": spark.range(1)}, f"file://{root}")
    assert {x for x in os.listdir(root) if not x.startswith((".", "CURRENT"))} - written == {version}
    both = sinks.load_tables(spark, ["x", "z"], f"file://{root}")
    assert (both["x"].count(), both["z"].count(), both["x"].columns) == (9, 1, ["id", "y"])
    assert sinks.migrated(spark.range(1), "id int, name string").first().asDict() == {"id": 0, "name": None}


def test_enclosing_equals_brute_force(spark):
    spans = [(k, k % 3, k * 7 % 90 - 20, k * 7 % 90 - 20 + k * k % 40) for k in range(200)] + [(900, 1, -1000, 1000), (901, None, 0, 5), (902, 2, 9, 8)]
    points = [(k, p) for k in (0, 1, 2, 5, None) for p in (-25, -1, 0, 7, 33, 99, None)]
    rows = resolve.enclosing(spark.createDataFrame(points, "found int, at int"), spark.createDataFrame(spans, "id long, k int, a int, b int").withColumnRenamed("k", "found"), "found", "at", "a", "b", "id").collect()
    want = {(k, p): min(((b - a, i) for i, g, a, b in spans if g == k is not None and p is not None and a <= p <= b), default=(0, None))[1] for k, p in points}
    assert len(rows) == len(points) and {(r.found, r["at"]): r.id for r in rows} == want


def test_running_totals_and_percentiles(spark, scratch):
    rows = spark.range(500).selectExpr("id * 37 % 500 as x", "id % 5 as n", "1 as _range", "2 as _own")
    got = running_totals(rows, ["x"], "n", scratch).orderBy("x").collect()
    total = 0
    for r in got:
        total += r.n
        assert r.upto == total and r._range == 1
    values = [("a", float(k % 7)) for k in range(40)] + [("b", 1.0), ("c", None), (None, 2.0)]
    found = {r.k: (r["mean"], r.at_place) for r in telemetry.percentile_rank(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    own = sorted(v for k, v in values if k == "a")
    assert found == {"a": (round(sum(own) / 40, 6), own[38]), "b": (1.0, 1.0)}
    clash = spark.createDataFrame([(1, 5, "x"), (1, 4, "y")], "k int, _n int, v string")
    assert first_by(clash, ["k"], [F.col("_n")]).first().asDict() == {"k": 1, "_n": 4, "v": "y"}


def test_costs_and_rates(spark):
    refs = spark.createDataFrame([(1, "/a"), (1, "a"), (1, "b"), (2, "gone"), (2, "lost")], "call int, path string")
    files = spark.createDataFrame([("a", 10), ("b", 5)], "path string, tokens long")
    assert {r.call: r.raw_tokens for r in telemetry.raw_cost(refs, files).collect()} == {1: 15, 2: 3000}
    runs = spark.createDataFrame([("r", 0, 0, 100, 0.0), ("r", 1, 10, 100, 1.0), ("r", 2, 30, 100, 2.0), ("d", 0, 5, 5, 0.0), ("n", 0, 1, 5, 0.0)], "run string, n int, done int, total int, seconds double")
    got = {r.run: (r.speed, r.eta_seconds) for r in telemetry.eta(runs, "run", "n", "done", "total", "seconds").collect()}
    assert got == {"r": (13.0, round(70 / 13, 6)), "d": (None, 0.0), "n": (None, None)}
    nodes = spark.createDataFrame([("a", 370, ["x", "y"], ["/r"]), ("bb", 37, [], [])], "path string, size_bytes long, exports array<string>, routes array<string>")
    edges = spark.createDataFrame([("a", "bb", "imports"), ("a", "bb", "references"), ("a", "bb", "route")], "from_path string, to_path string, kind string")
    assert {r.path: r.chars for r in manifest.manifest_chars(nodes, edges).collect()} == {"a": 5 + 12 + 4 + 10 + 2 + 14 + len("/bb, /bb"), "bb": 6}
    assert manifest.savings(nodes, edges, nodes.select("path").where("path = 'bb'")).first().asDict() == {"baseline_tokens": 110, "active_tokens": 26, "savings_percent": 76.4}
    ranked = spark.createDataFrame([("a", "go", 1.0, 1), ("b", "go", 0.5, 40), ("c", "rust", 0.9, 2)], "path string, language string, rank_score double, rank_order int")
    opened = spark.createDataFrame([("b",)], "path string")
    assert sorted(r.path for r in manifest.core_files(ranked, ["go"], 0.1, 30, opened).collect()) == ["a", "b"]


def test_staleness_pulses_and_sync(spark):
    marks = spark.createDataFrame([("a", 5), ("a", 9), ("b", 50)], "path string, marked_at long")
    got = {r.path: (r.elapsed_ms, r.inside) for r in live.staleness(marks, spark.createDataFrame([("a",)], "path string"), 20).collect()}
    assert got == {"a": (11, True), "b": (0, False)}
    calls = spark.createDataFrame([("x", 0), ("x", 900), ("y", 100), ("z", 5000)], "target string, ms long")
    assert [(r.target, r.until_ms) for r in live.active_targets(calls, 2500).collect()] == [("x", 2900)]
    own = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "h")], "file_path string, name string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("c", "b")], "from_path string, to_path string")
    after, links = live.synced(own, edges, spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "f2")], "file_path string, name string"), spark.createDataFrame([("a", "c")], "from_path string, to_path string"))
    assert sorted((r.file_path, r.name) for r in after.collect()) == [("a", "f2"), ("c", "h")]
    assert sorted((r.from_path, r.to_path) for r in links.collect()) == [("a", "c"), ("c", "a")]
