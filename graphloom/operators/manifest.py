"""Ranked manifests: filtered, ordered and rendered file maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import depth, directory, in_scope

#: Lines that a rendered manifest has at most before it sums directories up, and dependents from which they are told.
LINE_BUDGET, REPORTED = 500, 2
SORTS = {"rank": "rank", "alpha": "alphabetical", "alphabetical": "alphabetical", "path": "alphabetical", "depth": "depth"}


class ManifestError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Options:
    """scope, community and min_rank filter; top_k keeps the best by rank; sort_by orders what is kept."""

    scope: str | None = None
    community: str | None = None
    min_rank: float | None = None
    top_k: int | None = None
    sort_by: str = "rank"

    def order(self) -> list[Column]:
        return {"rank": [F.col("rank_order")], "alphabetical": [F.col("path")], "depth": [depth(F.col("path")), F.col("path")]}[SORTS.get(self.sort_by.strip().lower(), "rank")]


def in_community(files: DataFrame, asked: str) -> DataFrame:
    """Files (path, community, maybe community_id) of one community: the one with the asked number, if digits are asked and the files have numbers.

    Otherwise it is the first one, by number or else by name, whose name contains what is asked, in any case.
    """
    numbered = "community_id" in files.columns
    if numbered and asked.strip().isdigit():
        return files.where(F.col("community_id") == int(asked))
    met = files.where(F.contains(F.lower("community"), F.lit(asked.strip().lower())))
    rank = F.struct("community_id", "community") if numbered else F.struct("community")
    first = met.agg(F.min(rank).alias("first")).select("first.*")
    return files.join(F.broadcast(first), first.columns, "left_semi")


def select_files(files: DataFrame, options: Options) -> DataFrame:
    """The files of a manifest, in order. files has path, rank_score and rank_order, and community (maybe community_id) if that filters."""
    kept = files
    if options.community is not None:
        kept = in_community(files, options.community)
    if options.scope:
        kept = kept.where(in_scope(F.col("path"), options.scope))
    if options.min_rank is not None:
        kept = kept.where(F.col("rank_score") >= options.min_rank)
    if options.top_k is not None:
        kept = kept.orderBy("rank_order").limit(options.top_k)
    return kept.orderBy(*options.order())


def checked(files: DataFrame, options: Options) -> DataFrame:
    """select_files, or the error that says which filter left nothing."""
    if options.scope and files.where(in_scope(F.col("path"), options.scope)).isEmpty():
        raise ManifestError("empty_scope")
    if options.community is not None and in_community(files, options.community).isEmpty():
        raise ManifestError("unknown_domain")
    found = select_files(files, options)
    if options.min_rank is not None and found.isEmpty():
        raise ManifestError("empty_rank_filter")
    return found


def line(position: Column) -> Column:
    """The line of a file at a position; needs path, rank_order, exports, route, in_degree and depends_on."""
    head = F.when((F.col("rank_order") == 0) | (F.col("rank_order") == position), F.concat(F.lit("- /"), "path")).otherwise(F.concat(F.lit("- [#"), F.col("rank_order").cast("string"), F.lit("] /"), "path"))
    part = lambda when, *what: F.when(when, F.concat(*what)).otherwise("")
    return F.concat(
        head,
        part(F.size("exports") > 0, F.lit(" (Exports: "), F.array_join("exports", ", "), F.lit(")")),
        part(F.col("route").isNotNull(), F.lit(" (Route: "), F.coalesce("route", F.lit("")), F.lit(")")),
        part(F.col("in_degree") >= REPORTED, F.lit(" (In: "), F.col("in_degree").cast("string"), F.lit(")")),
        part(F.size("depends_on") > 0, F.lit(" (Depends on: "), F.array_join(F.transform("depends_on", lambda d: F.concat(F.lit("/"), d)), ", "), F.lit(")")),
    )


def collapsed(files: DataFrame, budget: int = LINE_BUDGET) -> DataFrame:
    """(dir, n_files): directories of files whose rank is beyond the budget."""
    beyond = files.where(F.col("rank_order") > budget)
    return beyond.groupBy(directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n_files"))


def render(files: DataFrame, options: Options, root: str, warnings: DataFrame | None = None, budget: int = LINE_BUDGET) -> str:
    """The manifest as text: at most ``budget`` file lines, as many lines for directories of the rest, and as many warnings, each with a line for what is beyond."""
    # The headings and the words of this text's lines.
    rows = checked(files, options)
    total = files.where(in_scope(F.col("path"), options.scope)).count() if options.scope else files.count()
    shown = rows.count()
    out = [f"## Project Architecture Map (Active Root: {root})"]
    if shown < total:
        out.append(f"Showing {shown} of {total} files, highest-ranked first.")
    rest: list = []
    more = lambda rows, what: [f"- and more {what}"] if len(rows) > budget else []
    if shown > budget:
        best = rows.orderBy("rank_order").limit(budget).select("path", F.lit(True).alias("kept"))
        marked = rows.join(F.broadcast(best), "path", "left")
        rest = marked.where("kept is null").groupBy(directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n")).orderBy("dir").limit(budget + 1).collect()
        rows = marked.where("kept").drop("kept").orderBy(*options.order())
    for position, row in enumerate(rows.withColumn("_line", F.struct(line(F.lit(-1)).alias("far"), line(F.col("rank_order")).alias("near"))).collect(), 1):
        out.append(row["_line"].near if row.rank_order in (0, position) else row["_line"].far)
    out += [*(f"- /{r.dir}/ ({r.n} lower-ranked files)" for r in rest[:budget]), *more(rest, "directories")]
    if warnings is not None and (known := warnings.orderBy("path", "kind").limit(budget + 1).collect()):
        out += ["", "## Warnings (known gaps in this map)", *(f"- /{w.path}: {w.kind}" for w in known[:budget]), *more(known, "warnings")]
    return "\n".join(out) + "\n"


#: Characters of a token in the cost model, and tokens of a context window.
CHARS_PER_TOKEN, CONTEXT_TOKENS, BYTES_PER_LINE = 3.7, 16_000, 40


def manifest_chars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, chars) that each file takes in a manifest: nodes has path, exports and routes; edges may repeat a target."""
    listed = lambda c, extra: F.when(F.size(c) > 0, F.length(F.array_join(c, ", ")) + extra).otherwise(0)
    deps = edges.where("kind <> 'route'").groupBy(F.col("from_path").alias("path")).agg((F.sum(F.length("to_path") + 3) - 2 + 14).alias("deps"))
    own = F.length("path") + 4 + listed("exports", 12) + listed("routes", 10)
    return nodes.join(deps, "path", "left").select("path", (own + F.coalesce("deps", F.lit(0))).cast("long").alias("chars"))


def savings(nodes: DataFrame, edges: DataFrame, read: DataFrame) -> DataFrame:
    """One row: baseline_tokens of all files (size_bytes), active_tokens of the manifest and the files read (path), savings_percent."""
    total = nodes.agg(F.round(F.sum("size_bytes") / CHARS_PER_TOKEN).cast("long").alias("baseline_tokens"))
    text = manifest_chars(nodes, edges).agg(F.round(F.sum("chars") / CHARS_PER_TOKEN).cast("long").alias("m"))
    opened = nodes.join(read.select("path").distinct(), "path", "left_semi").agg(F.round(F.coalesce(F.sum("size_bytes"), F.lit(0)) / CHARS_PER_TOKEN).cast("long").alias("r"))
    both = total.crossJoin(F.broadcast(text)).crossJoin(F.broadcast(opened)).withColumn("active_tokens", F.coalesce("m", F.lit(0)) + F.col("r"))
    share = F.when(F.col("baseline_tokens") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("active_tokens") / F.col("baseline_tokens")) * 100))).otherwise(0.0)
    return both.select(F.coalesce("baseline_tokens", F.lit(0)).alias("baseline_tokens"), "active_tokens", F.round(share, 1).alias("savings_percent"))


def context_budget(nodes: DataFrame, edges: DataFrame, symbols: DataFrame, chosen: DataFrame) -> DataFrame:
    """(context, file_tokens, manifest_tokens, total_tokens, percent): what each context takes of CONTEXT_TOKENS.

    ``chosen`` has (context, path, name): whole files, where name is null, and
    symbols. A file counts by its size; a symbol, unless its file is whole in
    the context, by its lines at BYTES_PER_LINE each, at most the file's size,
    and the first by id of equal names. The manifest lists these files and what
    they depend on or is dependent on them. Unknown files and symbols count
    nothing, and what is chosen twice counts once. nodes has path, size_bytes,
    exports and routes, symbols id, file_path, name, start_line and end_line.
    """
    picked = chosen.select("context", "path", "name").distinct()
    whole = picked.where("name is null").select("context", "path")
    sizes = nodes.select("path", "size_bytes")
    of_files = whole.join(sizes, "path").select("context", F.col("size_bytes").alias("bytes"))
    first = symbols.groupBy(F.col("file_path").alias("path"), "name").agg(F.min_by(F.col("end_line") - F.col("start_line") + 1, "id").alias("lines"))
    parts = picked.where("name is not null").join(whole, ["context", "path"], "left_anti").join(first, ["path", "name"]).join(sizes, "path")
    of_symbols = parts.select("context", F.least(F.col("size_bytes"), F.col("lines") * BYTES_PER_LINE).alias("bytes"))
    tokens = lambda total: F.round(total / CHARS_PER_TOKEN).cast("long")
    files = of_files.unionByName(of_symbols).groupBy("context").agg(tokens(F.sum("bytes")).alias("f"))
    own = picked.select("context", "path").distinct()
    links = edges.where("kind <> 'route'").select("from_path", "to_path").distinct()
    near = links.unionByName(links.select(F.col("to_path").alias("from_path"), F.col("from_path").alias("to_path"))).withColumnRenamed("from_path", "path")
    listed = own.unionByName(own.join(near, "path").select("context", F.col("to_path").alias("path"))).distinct()
    manifest = listed.join(manifest_chars(nodes, edges), "path").groupBy("context").agg(tokens(F.sum("chars")).alias("m"))
    both = picked.select("context").distinct().join(files, "context", "left").join(manifest, "context", "left").fillna(0, ["f", "m"])
    total = F.col("f") + F.col("m")
    return both.select("context", F.col("f").alias("file_tokens"), F.col("m").alias("manifest_tokens"), total.alias("total_tokens"), F.round(F.least(total / CONTEXT_TOKENS * 100, F.lit(100.0)), 1).alias("percent"))


def core_files(files: DataFrame, languages: list[str] | None = None, min_rank: float = 0.0, best: int = 30, opened: DataFrame | None = None) -> DataFrame:
    """Files (path, language, rank_score, rank_order) of some languages and a least rank: the best by order, and opened ones (path)."""
    kept = files.where(F.col("rank_score") >= min_rank)
    kept = kept.where(F.col("language").isin(*languages)) if languages else kept
    if opened is None:
        return kept.where(F.col("rank_order") <= best)
    marked = kept.join(opened.select("path").distinct().withColumn("opened", F.lit(True)), "path", "left")
    return marked.where((F.col("rank_order") <= best) | F.col("opened")).drop("opened")
