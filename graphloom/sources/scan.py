"""Sources: trees of files, saved graphs, captured version-control status, path aliases."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import MAX_SOURCE_BYTES, ancestors, depth, is_indexed, language
from graphloom.sources import walk

#: Files whose contents are handed on at once.
FILES_TOGETHER = 64

GRAPH_SCHEMA = """schema_version int, nodes array<struct<path: string, size_bytes: bigint, language: string, exports: array<string>, routes: array<string>, in_degree: int, out_degree: int,
 symbols: array<struct<name: string, kind: string, start_line: int, end_line: int>>, rank_score: double, rank_order: int>>, edges array<struct<from_path: string, to_path: string, kind: string>>,
 external_dependencies array<string>, warnings array<struct<path: string, kind: string>>, symbol_edges array<struct<from_symbol: string, to_symbol: string, kind: string, provenance: string, wiring_site: string>>"""


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, splits: int | None = None) -> DataFrame:
    """path, size_bytes, language, mtime, content, warning of the files below root that an index keeps.

    ``ignore`` has lines of an ignore file at the root; those that folders hold
    are stronger. Tasks list their subtrees, and paths are dealt out evenly
    before contents are read, so of what is left out nothing is read, and no
    list of files reaches the driver. A file above MAX_SOURCE_BYTES has a null
    content and a warning; so has one that can't be read, without a warning.
    """
    spark.dataSource.register(walk.Tree)
    parts = splits or max(walk.SPLITS, 4 * spark.sparkContext.defaultParallelism)
    listed = spark.read.format("file_tree").options(root=root, ignore="\n".join(ignore or []), splits=str(parts)).load()
    kept = listed.where(is_indexed(F.col("path"))).withColumns({"language": language(F.col("path")), "warning": F.when(F.col("size_bytes") > MAX_SOURCE_BYTES, "skipped_large_file")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = walk.Files(root)
        for batch in batches:
            for k in range(0, batch.num_rows, FILES_TOGETHER):
                part = batch.slice(k, FILES_TOGETHER)
                data = [None if warned else files.read(path) for path, warned in zip(part.column(0).to_pylist(), part.column(4).to_pylist(), strict=True)]
                texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in data], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), texts, part.column(4)], names=["path", "size_bytes", "language", "mtime", "content", "warning"])

    dealt = kept.select("path", "size_bytes", "language", "mtime", "warning").repartition("path")
    return dealt.mapInArrow(run, "path string, size_bytes long, language string, mtime long, content string, warning string")


def tree(files: DataFrame) -> DataFrame:
    """path, depth, is_dir, parent of all files and the directories above them; order by parent, is_dir desc, lower(path) to show it."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    every = dirs.unionByName(files.select("path", F.lit(False).alias("is_dir")).distinct())
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return every.select("path", depth(F.col("path")).alias("depth"), "is_dir", parent.alias("parent"))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges, symbol_edges, external_dependencies and warnings of a saved graph; raises ValueError if malformed."""
    saved = spark.read.schema(f"{GRAPH_SCHEMA}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True)
    if not saved.where("_corrupt_record is not null and nodes is null").isEmpty():
        raise ValueError("malformed graph")
    each = lambda c: saved.select(F.explode(c).alias("x"))
    return {c: each(c).select("x.*") for c in ("nodes", "edges", "symbol_edges", "warnings")} | {"external_dependencies": each("external_dependencies").select(F.col("x").alias("name"))}


def git_status(lines: DataFrame) -> DataFrame:
    """(path, status) from captured porcelain lines in column value; a rename takes the new path."""
    code, rest = F.substring("value", 1, 2), F.expr("substring(value, 4)")
    path = F.when(F.instr(rest, " -> ") > 0, F.substring_index(rest, " -> ", -1)).otherwise(rest)
    status = F.when(code.contains("M"), "modified").when(code.contains("A"), "added").when(code.contains("?"), "untracked").when(code.contains("D"), "deleted").otherwise("modified")
    return lines.where(F.length("value") > 3).select(F.regexp_replace(path, '^"|"$', "").alias("path"), status.alias("status"))


def strip_json_comments(text: str) -> str:
    """JSON without // and /* */ comments; strings are left alone."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def path_aliases(config: str | None) -> list[tuple[str, str, int]]:
    """(pattern, target, order) of a project configuration; without paths, the usual source prefixes."""
    options = json.loads(re.sub(r",\s*([}\]])", r"\1", strip_json_comments(config))).get("compilerOptions", {}) if config else {}
    base = options.get("baseUrl", ".").strip("/").removeprefix("./").removeprefix(".")
    rows = [(pattern, "/".join(x for x in (base, target.removeprefix("./")) if x)) for pattern, targets in (options.get("paths") or {}).items() for target in targets]
    if not rows:
        rows = [(prefix + "*", target) for prefix in ("@/", "~/") for target in ("src/*", "*")]
    if base:
        rows.append(("*", f"{base}/*"))
    return [(pattern, target, k) for k, (pattern, target) in enumerate(rows)]
