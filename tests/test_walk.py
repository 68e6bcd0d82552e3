import os

import pytest

from graphloom.sources import scan, walk


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_names_with_dots_and_underscores_are_scanned(spark, tmp_path):
    put(tmp_path, {"pkg/__init__.py": "from .a import b", "pkg/a.py": "b = 1", ".eslintrc.js": "x", ".github/_build.yml": "on: push", ".git/config": "x", ".env": "K=1", ".env.example": "K="})
    got = {r.path: r.content for r in scan.scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == [".env.example", ".eslintrc.js", ".github/_build.yml", "pkg/__init__.py", "pkg/a.py"]
    assert got["pkg/__init__.py"] == "from .a import b"
    assert sorted(r.path for r in scan.scan(spark, f"file://{tmp_path}", splits=1).collect()) == sorted(got)


def test_rules_go_down_the_tree(spark, tmp_path):
    put(
        tmp_path,
        {
            ".gitignore": "gone/\n*.log\n/top.txt\ndocs/*.md\n[ab].cfg\n",
            "gone/a.py": "", "x.log": "", "top.txt": "", "sub/top.txt": "", "docs/a.md": "", "docs/in/a.md": "", "a.cfg": "", "c.cfg": "",
            "sub/.gitignore": "!x.log\nown.py\n", "sub/x.log": "", "sub/own.py": "", "sub/deep/own.py": "", "sub/deep/x.log": "",
            "both/.ignore": "!y.log\n", "both/.gitignore": "y.log\n", "both/y.log": "",
            "kept/.gitignore": "!gone/\n", "kept/gone/a.py": "",
        },
    )
    want = [".gitignore", "both/.gitignore", "both/.ignore", "both/y.log", "c.cfg", "docs/in/a.md", "kept/.gitignore", "kept/gone/a.py", "sub/.gitignore", "sub/deep/x.log", "sub/top.txt", "sub/x.log"]
    for splits in (1, 3, 50):
        assert sorted(r.path for r in scan.scan(spark, str(tmp_path), splits=splits).collect()) == want
    given = [r.path for r in scan.scan(spark, str(tmp_path), ["sub/", "*.cfg"]).collect()]
    assert not any(x.startswith("sub/") or x.endswith(".cfg") for x in given)


def test_links_and_unreadable_folders_are_passed_over(tmp_path):
    put(tmp_path, {"a/x.py": "1"})
    os.symlink(tmp_path / "a", tmp_path / "b")
    os.symlink(tmp_path / "a" / "x.py", tmp_path / "y.py")
    files = walk.Files(str(tmp_path))
    assert [r[0] for part in walk.plan(files, ([], [])) for r in walk.walk(files, part)] == ["a/x.py"]
    assert files.entries("missing") == [] and files.read("missing") is None


class Wide:
    """A tree of 100,000 files in 1,000 folders of 10 groups; counts what is asked for."""

    def __init__(self):
        self.asked = 0

    def entries(self, folder):
        self.asked += 1
        level = folder.count("/") + 1 if folder else 0
        if level < 2:
            return [walk.Entry(f"d{k}", True) for k in range(10 if level == 0 else 100)]
        return [walk.Entry(f"_{k}.py", False, k, 7) for k in range(100)]

    def read(self, path):
        raise AssertionError(path)


@pytest.mark.parametrize("splits", [1, 8, 64, 500])
def test_planning_lists_few_folders(splits):
    tree = Wide()
    parts = walk.plan(tree, ([], []), splits)
    assert tree.asked <= max(1, splits) and len(parts) >= min(splits, 1000)
    found = [row for part in parts for row in walk.walk(tree, part)]
    assert len(found) == 100_000 and len({path for path, *_ in found}) == 100_000 and sum(size for _, size, _ in found) == 1000 * 4950


def test_a_chain_of_folders_doesn_t_hold_up_planning():
    class Chain(Wide):
        def entries(self, folder):
            self.asked += 1
            return [walk.Entry("x.py", False)] + ([walk.Entry("d", True)] if folder.count("/") < 200 else [])

    tree = Chain()
    parts = walk.plan(tree, ([], []), 64, 20)
    assert tree.asked == 20 and len([row for part in parts for row in walk.walk(tree, part)]) == 202
