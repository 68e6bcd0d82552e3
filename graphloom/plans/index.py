"""One call from a tree of source files to saved tables: scan, extraction, resolution, graph, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import directory, joined
from graphloom.operators import graph, ordering, rank, resolve
from graphloom.sources import extract, scan, sinks
from graphloom.storage import Scratch

TABLES = ("files", "symbols", "edges", "symbol_edges", "external_packages", "warnings")
CONFIGURATION = ("tsconfig.json", "jsconfig.json")


def imports_of(facts: DataFrame) -> DataFrame:
    """(from_path, ordinal, language, raw, resolved, external, kind) of import facts (path, language, name, start_line).

    Relative specifiers are resolved against the folder of their file: those
    with ./ and ../, and in Python those with leading dots, each beyond the
    first a folder up. Python's dotted names are paths from the root. What isn't
    relative may be external.
    """
    base, raw = directory(F.col("path")), F.col("name")
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), dotted)
    python = F.when(dots > 0, joined(base, up)).otherwise(dotted)
    resolved = F.when(F.col("language") == "python", python).when(raw.rlike(r"^\.\.?(/|$)"), joined(base, raw))
    rows = facts.select(F.col("path").alias("from_path"), "language", raw.alias("raw"), resolved.alias("resolved"), "start_line", (~raw.startswith(".")).alias("external"), F.lit("imports").alias("kind"))
    return resolve.numbered_rows(rows, "from_path", ["start_line", "raw"]).drop("start_line")


def build(spark: SparkSession, root: str, ignore: list[str] | None = None, name: str = "index") -> dict[str, DataFrame]:
    """TABLES of the files below root, each kept in the shared folder.

    files: path, size_bytes, language, mtime, n_symbols, n_routes, in_degree,
    out_degree, rank_score, rank_order; symbols: id, file_path, name, kind,
    start_line, end_line, numbered by file and place; edges: from_path, to_path,
    kind; symbol_edges: from_id, to_id, kind, provenance, site. An empty tree
    has empty tables.
    """
    scratch = Scratch(spark, name)
    files = scratch.keep(scan.scan(spark, root, ignore), "scanned")
    facts = scratch.keep(extract.code_facts(files).join(files.select("path", "language"), "path"), "facts")
    symbols = facts.where("fact = 'symbol'").select(F.col("path").alias("file_path"), "name", F.col("detail").alias("kind"), "start_line", "end_line").distinct()
    symbols = scratch.keep(ordering.with_position(symbols, [F.col(c) for c in ("file_path", "start_line", "end_line", "name", "kind")], scratch, "id"), "symbols")
    imports = scratch.keep(imports_of(facts.where("fact = 'import'")), "imports")
    settings = files.where(F.col("path").isin(*CONFIGURATION)).orderBy(F.desc("path")).select("content").first()
    aliases = spark.createDataFrame(scan.path_aliases(settings.content if settings else None), "pattern string, target string, alias_order int")
    resolved = scratch.keep(resolve.resolve_imports(imports, files.select("path"), aliases).where("from_path <> to_path"), "resolved")
    edges = scratch.keep(graph.file_edges(resolved.select("from_path", "to_path", F.lit("imports").alias("kind"))), "edges")
    points = facts.where("fact = 'reference'").select(F.col("path").alias("file_path"), "name", F.col("start_line").alias("ordinal"))
    held = resolve.enclosing(points, symbols.withColumnRenamed("id", "from_id"), "file_path", "ordinal", "start_line", "end_line", "from_id").where("from_id is not null")
    symbol_edges = scratch.keep(resolve.reference_edges(held, symbols.select("id", "file_path", "name", "kind"), resolved), "symbol_edges")
    counts = symbols.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n_symbols"))
    nodes = files.select("path", "size_bytes", "language", "mtime").join(counts, "path", "left").fillna(0, ["n_symbols"]).withColumn("n_routes", F.lit(0))
    nodes = scratch.keep(graph.build_nodes(nodes, edges), "nodes")
    ranks = rank.page_rank(nodes, edges, Scratch(spark, f"{name}-ranks")).select("path", "rank_score", "rank_order")
    told = files.where("warning is not null").select("path", F.col("warning").alias("kind")).unionByName(facts.where("fact = 'warning'").select("path", F.col("name").alias("kind")))
    return {
        "files": scratch.keep(nodes.join(ranks, "path"), "files"),
        "symbols": symbols,
        "edges": edges,
        "symbol_edges": symbol_edges,
        "external_packages": scratch.keep(resolve.external_packages(imports, resolved), "external_packages"),
        "warnings": scratch.keep(told.unionByName(resolve.unresolved(imports, resolved)).distinct(), "warnings"),
    }


def index(spark: SparkSession, root: str, out: str, ignore: list[str] | None = None) -> str:
    """Builds the tables of a tree and saves them as a new version below ``out``; the version."""
    return sinks.save_tables(spark, build(spark, root, ignore), out)
