"""Endpoints, call graphs and source slices of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import lines, signature, token_estimate

# Fixed value: kinds that hold a call's result rather than take part in calls.
NOISE = ("variable", "file", "constant", "field", "property")


def is_noise(kind: Column) -> Column:
    return kind.isin(*NOISE)


def collapse(raw: DataFrame) -> DataFrame:
    """(anchor, endpoint, kind) from (anchor, anchor_file, file_path, name, kind).

    Named symbols stay, once each; a file with nothing but noise becomes one
    endpoint of kind references, unless it is the anchor's own.
    """
    loud = raw.where(~is_noise(F.col("kind")) & (F.col("name") != F.col("file_path")))
    named = loud.select("anchor", "file_path", F.concat_ws("#", "file_path", "name").alias("endpoint")).distinct()
    quiet = raw.where("file_path <> anchor_file").select("anchor", "file_path").distinct().join(named.select("anchor", "file_path").distinct(), ["anchor", "file_path"], "left_anti")
    return named.select("anchor", "endpoint", F.lit("calls").alias("kind")).unionByName(quiet.select("anchor", F.col("file_path").alias("endpoint"), F.lit("references").alias("kind")))


def arrow(source: Column, kind: Column, target: Column) -> Column:
    """An edge as one string."""
    return F.concat(source, F.lit(" -"), kind, F.lit("-> "), target)


def explore(symbols: DataFrame, edges: DataFrame, requested: DataFrame, compact: bool = True) -> DataFrame:
    """(anchor, edge): the collapsed callers and callees of all requested symbol ids at once."""
    asked = symbols.join(requested.select(F.col("anchor").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("anchor"), F.col("file_path").alias("anchor_file"), F.concat_ws("#", "file_path", "name").alias("self"))
    far = symbols.select(F.col("id").alias("other"), "file_path", "name", F.col("kind"))
    ins = edges.select(F.col("to_id").alias("anchor"), F.col("from_id").alias("other")).join(asked, "anchor").join(far, "other")
    outs = edges.select(F.col("from_id").alias("anchor"), F.col("to_id").alias("other")).join(asked, "anchor").join(far, "other")
    names = asked.select("anchor", "self")
    inbound = collapse(ins).join(names, "anchor")
    outbound = collapse(outs).join(names, "anchor")
    if compact:
        rows = inbound.select("anchor", arrow(F.col("endpoint"), F.col("kind"), F.col("self")).alias("edge")).unionByName(outbound.select("anchor", arrow(F.col("self"), F.col("kind"), F.col("endpoint")).alias("edge")))
    else:
        rows = inbound.select("anchor", F.col("endpoint").alias("from_symbol"), F.col("self").alias("to_symbol"), "kind").unionByName(outbound.select("anchor", F.col("self").alias("from_symbol"), F.col("endpoint").alias("to_symbol"), "kind"))
    return rows.distinct()


def symbol_slices(symbols: DataFrame, files: DataFrame, most: int = 6, of_file: bool = False) -> DataFrame:
    """(id, signature, code) of symbols (id, file_path, start_line, end_line) from files (file_path, content); code lines are numbered from the symbol's first, or as in the file.

    A file is split once, and a symbol gathers its own lines only: an end after
    the file's is cut to it before lines are asked for. Symbols whose file is
    missing are left out; without lines, both texts are empty.
    """
    split = files.select("file_path", lines(F.col("content")).alias("own"))
    sizes = split.groupBy("file_path").agg(F.max(F.size("own")).alias("n"))
    own = symbols.join(sizes, "file_path").select("id", "file_path", F.greatest("start_line", F.lit(1)).alias("low"), F.least("end_line", "n").alias("high"))
    rows = split.select("file_path", F.posexplode("own").alias("at", "text")).select("file_path", (F.col("at") + 1).alias("k"), "text")
    asked = own.where("low <= high").select("id", "file_path", "low", F.explode(F.sequence("low", "high")).alias("k"))
    number = F.col("k") if of_file else F.col("k") - F.col("low") + 1
    numbered_line = F.concat(F.lpad(number.cast("string"), 4, " "), F.lit(": "), "text")
    met = asked.join(rows, ["file_path", "k"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "text", numbered_line.alias("shown")))).alias("s"))
    head = F.slice("s.text", 1, most)
    code = F.coalesce(F.array_join("s.shown", "\n"), F.lit(""))
    out = own.select("id").join(met, "id", "left")
    return out.select("id", F.coalesce(signature(F.array_join(head, "\n"), F.lit(1), F.size(head), most), F.lit("")).alias("signature"), code.alias("code"))


#: Tokens of sources above which an answer holds signatures only.
AUTO_BUDGET = 2500


def within_budget(slices: DataFrame, key: str, budget: int = AUTO_BUDGET, whole: bool = False) -> DataFrame:
    """``slices`` (key, signature, code) with ``text``: the code, or, where a key's codes take over ``budget`` tokens, the signature.

    ``shortened`` tells which; ``whole`` keeps the code in any case.
    """
    total = slices.groupBy(key).agg(F.sum(token_estimate(F.col("code"))).alias("tokens"))
    long_ = F.lit(False) if whole else F.col("tokens") > budget
    return slices.join(total, key).withColumn("shortened", long_).withColumn("text", F.when(F.col("shortened"), F.col("signature")).otherwise(F.col("code"))).drop("tokens")
