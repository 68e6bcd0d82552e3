"""Personalised PageRank over file graphs, with entry-point priors and barrel contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import is_barrel, is_entry_point, is_test
from graphloom.operators.ordering import with_position
from graphloom.storage import Scratch

# Fixed values of the ranking.
DAMPING, MAX_ITERATIONS, CONVERGENCE = 0.85, 128, 1e-10
ENTRY_BOOST, BARREL_PRIOR, TEST_PRIOR = 3.0, 0.25, 0.25
EDGE_WEIGHTS = {"contains": 1.5, "imports": 1.0, "require": 1.0, "references": 0.5}
BARREL_DEPTH = 4
#: Iterations between writes that cut the lineage, and tests of convergence.
BLOCK = 8


def edge_weight(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in EDGE_WEIGHTS.items():
        out = F.when(kind == name, weight).otherwise(out)
    return out


def weighted(edges: DataFrame) -> DataFrame:
    """(from_path, to_path, kind, weight) of edges between files that count."""
    return edges.where("from_path <> to_path").select("from_path", "to_path", "kind", edge_weight(F.col("kind")).alias("weight")).where("weight > 0")


def flagged(nodes: DataFrame, raw: DataFrame) -> DataFrame:
    """(path, barrel, prior) of nodes (path, n_symbols, n_routes): entry points and routes weigh more, barrels and tests less."""
    degree = raw.groupBy(F.col("from_path").alias("path")).agg(F.count("*").alias("out_degree"))
    out = nodes.join(degree, "path", "left").fillna(0, ["out_degree"])
    out = out.withColumn("barrel", is_barrel(F.col("path"), F.col("n_symbols"), F.col("out_degree")))
    prior = F.when((F.col("n_routes") > 0) | is_entry_point(F.col("path")), ENTRY_BOOST).otherwise(1.0)
    prior = prior * F.when(F.col("barrel"), BARREL_PRIOR).otherwise(1.0) * F.when(is_test(F.col("path")), TEST_PRIOR).otherwise(1.0)
    return out.select("path", "barrel", prior.alias("prior"))


def links(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(weighted links source, target, weight), (nodes with prior); a link to a barrel goes on to what it exports.

    nodes has path, n_symbols and n_routes. A barrel's link is followed up to
    BARREL_DEPTH barrels deep, never twice through one, and its weight is
    shared equally by the distinct files reached.
    """
    nodes = scratch.keep(nodes.select("path", "n_symbols", "n_routes"), "nodes")
    known = nodes.select("path")
    raw = weighted(edges).join(known.withColumnRenamed("path", "from_path"), "from_path", "left_semi").join(known.withColumnRenamed("path", "to_path"), "to_path", "left_semi")
    raw = scratch.keep(raw, "raw")
    told = scratch.keep(flagged(nodes, raw), "priors")
    barrels = told.where("barrel").select(F.col("path").alias("at"))
    whole = raw.withColumn("at", F.col("to_path")).withColumn("n", F.lit(1))
    if not barrels.isEmpty():
        whole = _through(raw, barrels, scratch)
    spread = whole.groupBy(F.col("from_path").alias("source"), F.col("at").alias("target")).agg(F.sum(F.col("weight") / F.col("n")).alias("weight"))
    return spread, told.select("path", "prior")


def _through(raw: DataFrame, barrels: DataFrame, scratch: Scratch) -> DataFrame:
    """Each raw link with the files it reaches behind barrels (at) and their number (n)."""
    edge = ["from_path", "to_path", "kind"]
    via = scratch.keep(raw.select(F.col("from_path").alias("at"), F.col("to_path").alias("next")).join(barrels, "at", "left_semi").distinct(), "via")
    marked = barrels.withColumn("b", F.lit(True))
    open_ = raw.select(*edge, "weight", F.col("to_path").alias("at"), F.array("from_path").alias("trail"))
    ends = []
    for level in range(BARREL_DEPTH + 1):
        through = open_.join(marked, "at", "left")
        last = F.col("b").isNull() | F.lit(level == BARREL_DEPTH)
        ends.append(scratch.keep(through.where(last).select(*edge, "weight", "at"), f"ends-{level}"))
        if level < BARREL_DEPTH:
            moved = through.where(~last).join(via, "at").where(~F.array_contains("trail", F.col("next")))
            open_ = scratch.keep(moved.select(*edge, "weight", F.col("next").alias("at"), F.concat("trail", F.array("at")).alias("trail")), f"open-{level}")
            if open_.isEmpty():
                break
    reached = ends[0]
    for part in ends[1:]:
        reached = reached.unionByName(part)
    reached = reached.distinct()
    lost = raw.join(reached.select(*edge), edge, "left_anti").select(*edge, "weight", F.col("to_path").alias("at"))
    reached = reached.unionByName(lost)
    return reached.join(reached.groupBy(*edge).agg(F.count("*").alias("n")), edge)


def normalised(spread: DataFrame) -> DataFrame:
    """(source, target, share): each source's shares sum to 1."""
    total = spread.groupBy("source").agg(F.sum("weight").alias("total"))
    return spread.join(total, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share"))


def step(scores: DataFrame, shares: DataFrame) -> DataFrame:
    """One power iteration over (path, prior, loose, score); the mass of nodes without links (loose) goes to the prior."""
    mass = scores.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("score"))), F.lit(0.0)).alias("mass"))
    flow = scores.join(shares, scores["path"] == shares["source"]).groupBy(F.col("target").alias("path")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
    joined = scores.drop("score").join(flow, "path", "left").crossJoin(F.broadcast(mass))
    restart = (1 - DAMPING + DAMPING * F.col("mass")) * F.col("prior")
    return joined.select("path", "prior", "loose", (restart + DAMPING * F.coalesce("flow", F.lit(0.0))).alias("score"))


def page_rank(nodes: DataFrame, edges: DataFrame, scratch: Scratch, iterations: int = MAX_ITERATIONS, until: float = CONVERGENCE) -> DataFrame:
    """(path, score, rank_score, rank_order): scores over the greatest, to six decimals, and their order.

    Iteration stops when the summed change of a step falls below ``until``,
    which is tested every BLOCK steps, where the lineage is cut too.
    """
    spread, prior = links(nodes, edges, scratch)
    shares = scratch.keep(normalised(spread), "shares")
    total = prior.agg(F.sum("prior").alias("total"))
    linked = shares.select(F.col("source").alias("path"), F.lit(False).alias("loose")).distinct()
    share = F.col("prior") / F.col("total")
    first = prior.crossJoin(F.broadcast(total)).join(linked, "path", "left").select("path", share.alias("prior"), F.coalesce("loose", F.lit(True)).alias("loose"), share.alias("score"))
    last, turn = "scores-0", 0
    scores = scratch.keep(first, last)
    while turn < iterations:
        for _ in range(min(BLOCK, iterations - turn) - 1):
            scores, turn = step(scores, shares), turn + 1
        before, spent = scratch.keep(scores, f"before-{turn}"), [f"before-{turn}", last]
        last = f"scores-{turn + 1}"
        scores, turn = scratch.keep(step(before, shares), last), turn + 1
        done = turn >= iterations
        if not done:
            both = scores.join(before.select("path", F.col("score").alias("before")), "path")
            done = (both.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < until
        scratch.drop(*spent)
        if done:
            break
    scores = scores.select("path", "score")
    top = scores.agg(F.max("score").alias("top"))
    scaled = scores.crossJoin(F.broadcast(top)).withColumn("rank_score", F.round(F.col("score") / F.col("top"), 6)).drop("top")
    return with_position(scaled, [F.col("rank_score").desc(), F.col("path").asc()], scratch, "rank_order")
