"""A data source that walks trees of files: a partition per subtree, ignore rules carried down.

Names that begin with a dot or an underscore are listed as all others. The
driver lists folders from the root until there are enough of them to deal out,
never files below; each task walks its subtrees with the rules of the folders
above. Links aren't followed, and what can't be read is passed over. Roots are
local paths, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.paths import SKIP_DIRS

# Files whose lines say what a walk leaves out, the stronger one first.
IGNORE_FILES = (".ignore", ".gitignore")
SCHEMA = "path string, size_bytes long, mtime long"
#: Subtrees that planning aims at, and folders that it lists at most for that.
SPLITS, LISTED = 64, 1000

#: (pattern of a whole path, whether it takes paths in again, whether it is for directories only)
Rule = tuple[str, bool, bool]


def ignore_rules(text: str, directory: str = "") -> list[Rule]:
    """The rules of an ignore file's lines, in order."""
    out = []
    for line in text.splitlines():
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        again, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
        only, body = rule.endswith("/"), rule.strip("/")
        spoken = re.escape(body).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        spoken = re.sub(r"\\\[(!|\\\^)?((?:[^\]\\]|\\.)+?)\\\]", lambda m: f"[{'^' if m[1] else ''}{m[2].replace(chr(92) + '-', '-')}]", spoken)
        base = re.escape(directory + "/") if directory else ""
        out.append((f"^{base}{'' if rule.startswith('/') or '/' in body else '(?:.*/)?'}{spoken}$", again, only))
    return out


def left_out(path: str, is_dir: bool, rules: tuple[list[Rule], ...]) -> bool:
    """Whether the last rule that fits leaves the path out; rules of a stronger kind of file decide first."""
    for own in rules:
        for pattern, again, only in reversed(own):
            if (is_dir or not only) and re.search(pattern, path):
                return not again
    return False


@dataclass(frozen=True)
class Entry:
    """What a folder holds: a file or a folder by its name."""

    name: str
    is_dir: bool
    size: int = 0
    mtime: int = 0


class Files:
    """Lists and reads below a root."""

    def __init__(self, root: str):
        self.fs, base = arrow_fs.FileSystem.from_uri(root) if "://" in root else (arrow_fs.LocalFileSystem(), os.path.abspath(root))
        self.base = base.rstrip("/")
        self.local = isinstance(self.fs, arrow_fs.LocalFileSystem)

    def full(self, path: str) -> str:
        return f"{self.base}/{path}" if path else self.base

    def entries(self, folder: str) -> list[Entry]:
        """Files and folders directly in a folder, by name; none where it can't be read."""
        try:
            found = self.fs.get_file_info(arrow_fs.FileSelector(self.full(folder)))
        except OSError:
            return []
        kinds = arrow_fs.FileType
        known = [x for x in found if x.type in (kinds.File, kinds.Directory) and not (self.local and os.path.islink(x.path))]
        return sorted((Entry(x.base_name, x.type == kinds.Directory, x.size or 0, (x.mtime_ns or 0) // 10**9) for x in known), key=lambda e: e.name)

    def read(self, path: str) -> bytes | None:
        """A file's bytes; null where it can't be read."""
        try:
            with self.fs.open_input_stream(self.full(path)) as stream:
                return stream.read()
        except OSError:
            return None


@dataclass
class Subtree(InputPartition):
    """A folder to walk: whole, or only the files directly in it; rules are those of the folders above and its own."""

    folder: str
    rules: tuple[list[Rule], ...]
    whole: bool


def visit(files: Files, folder: str, rules: tuple[list[Rule], ...]) -> tuple[list[tuple[str, Entry]], list[Subtree]]:
    """The files of a folder that its rules keep, and its folders with the rules that hold in them."""
    kept, below = [], []
    entries = files.entries(folder)
    names = {e.name for e in entries if not e.is_dir}
    if names & set(IGNORE_FILES):
        found = [ignore_rules((files.read("/".join(x for x in (folder, n) if x)) or b"").decode("utf-8", "replace"), folder) if n in names else [] for n in IGNORE_FILES]
        rules = tuple(own + new for own, new in zip(rules, found, strict=True))
    for e in entries:
        path = f"{folder}/{e.name}" if folder else e.name
        if (e.is_dir and e.name in SKIP_DIRS) or left_out(path, e.is_dir, rules):
            continue
        if e.is_dir:
            below.append(Subtree(path, rules, True))
        else:
            kept.append((path, e))
    return kept, below


def plan(files: Files, rules: tuple[list[Rule], ...], splits: int = SPLITS, listed: int = LISTED) -> list[Subtree]:
    """Subtrees that together are the tree: folders are opened, those nearest to the root first, until there are ``splits``."""
    opened, waiting = [], deque([Subtree("", rules, True)])
    while waiting and len(waiting) < splits and len(opened) < listed:
        first = waiting.popleft()
        _, below = visit(files, first.folder, first.rules)
        opened.append(Subtree(first.folder, first.rules, False))
        waiting.extend(below)
    return opened + list(waiting)


def walk(files: Files, part: Subtree) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime) of the files of a subtree, a folder at a time."""
    open_ = [part]
    while open_:
        own = open_.pop()
        kept, below = visit(files, own.folder, own.rules)
        yield from ((path, e.size, e.mtime) for path, e in kept)
        if part.whole:
            open_.extend(reversed(below))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.splits = options["root"], int(options.get("splits", SPLITS))
        # Lines given with the call are weaker than all ignore files.
        self.rules = ([], ignore_rules(options.get("ignore", "")))

    def partitions(self) -> list[Subtree]:
        return plan(Files(self.root), self.rules, self.splits)

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "size_bytes", "mtime"])

        for row in walk(Files(self.root), partition):
            rows.append(row)
            if len(rows) >= 10_000:
                yield batch()
        yield batch()


class Tree(DataSource):
    """Format ``file_tree``: options root, ignore (lines of an ignore file at the root) and splits."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
