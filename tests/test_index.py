"""One call over a tree of source files."""

from graphloom.plans import index
from graphloom.sources import sinks


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_a_tree_becomes_tables(spark, tmp_path):
    put(
        tmp_path / "src",
        {
            "app/__init__.py": "from .core import run\n",
            "app/core.py": "import os\nfrom . import util\nfrom app.util import helper\n\ndef run():\n    return helper(1)\n",
            "app/util.py": "def helper(x):\n    return x\n",
            "web/main.ts": 'import { show } from "./view";\nimport react from "react";\nimport { gone } from "./gone";\nimport { far } from "@/shared/far";\nexport function main() { return show(far()); }\n',
            "web/view/index.ts": "export function show(x: any) { return x; }\n",
            "src/shared/far.ts": "export function far() { return 1; }\n",
            "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
            "node_modules/react/index.js": "module.exports = 1",
            "big.ts": "// x\n" * 250_000,
        },
    )
    out = f"file://{tmp_path}/out"
    index.index(spark, str(tmp_path / "src"), out)
    got = sinks.load_tables(spark, list(index.TABLES), out)
    pairs = {(r.from_path, r.to_path) for r in got["edges"].collect()}
    assert pairs == {("app/__init__.py", "app/core.py"), ("app/core.py", "app/__init__.py"), ("app/core.py", "app/util.py"), ("web/main.ts", "web/view/index.ts"), ("web/main.ts", "src/shared/far.ts")}
    names = {r.id: f"{r.file_path}#{r.name}" for r in got["symbols"].collect()}
    assert {"app/core.py#run", "app/util.py#helper", "web/main.ts#main", "web/view/index.ts#show"} <= set(names.values()) and sorted(names) == list(range(1, len(names) + 1))
    calls = {(names[r.from_id], names[r.to_id]) for r in got["symbol_edges"].collect()}
    assert {("app/core.py#run", "app/util.py#helper"), ("web/main.ts#main", "web/view/index.ts#show"), ("web/main.ts#main", "src/shared/far.ts#far")} <= calls
    assert {r.package for r in got["external_packages"].collect()} == {"os", "react"}
    assert {(r.path, r.kind) for r in got["warnings"].collect()} == {("big.ts", "skipped_large_file"), ("web/main.ts", "unresolved_import:./gone")}
    files = {r.path: r for r in got["files"].collect()}
    assert len(files) == 8 and sorted(r.rank_order for r in files.values()) == list(range(1, 9)) and files["app/util.py"].in_degree == 1


def test_an_empty_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    assert all(df.count() == 0 for df in index.build(spark, str(tmp_path / "src")).values())
