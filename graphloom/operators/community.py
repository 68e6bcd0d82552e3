"""Communities by weighted label propagation, with names, hubs and cohesion.

Labels move in synchronous rounds, each one join and one aggregation: a node
takes the label with the most weight among its neighbours and itself, ties to
the smallest. ``sweep`` gives what a sequential sweep, node by node, would, in
steps of nodes that no earlier neighbour holds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import basename, directory, is_dampened_hub
from graphloom.storage import Scratch

ROUNDS, HUB_WEIGHT, SMALL, KEY_EXPORTS = 10, 0.1, 30, 3


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, other, weight) in both directions; edges at hubs weigh HUB_WEIGHT. nodes has path and in_degree."""
    size = nodes.agg(F.count("*").alias("_n"))
    flagged = nodes.crossJoin(F.broadcast(size)).select("path", is_dampened_hub(F.col("path"), F.col("in_degree"), F.col("_n")).alias("hub"))
    a = flagged.select(F.col("path").alias("from_path"), F.col("hub").alias("hub_a"))
    b = flagged.select(F.col("path").alias("to_path"), F.col("hub").alias("hub_b"))
    weighed = edges.where("from_path <> to_path").join(a, "from_path").join(b, "to_path").withColumn("weight", F.when(F.col("hub_a") | F.col("hub_b"), HUB_WEIGHT).otherwise(1.0))
    one = weighed.select(F.col("from_path").alias("node"), F.col("to_path").alias("other"), "weight")
    two = weighed.select(F.col("to_path").alias("node"), F.col("from_path").alias("other"), "weight")
    return one.unionByName(two).groupBy("node", "other").agg(F.sum("weight").alias("weight"))


def label_round(labels: DataFrame, near: DataFrame) -> DataFrame:
    """One synchronous round: (node, label) after each node weighs its neighbours' labels, its own with 0.5 added."""
    votes = near.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", "weight")
    votes = votes.unionByName(labels.select("node", "label", F.lit(0.5).alias("weight")))
    sums = votes.groupBy("node", "label").agg(F.round(F.sum("weight"), 6).alias("weight"))
    best = sums.groupBy("node").agg(F.max("weight").alias("best"))
    return sums.join(best, "node").where("weight = best").groupBy("node").agg(F.min("label").alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, scratch: Scratch, rounds: int = ROUNDS, small: int = SMALL) -> DataFrame:
    """(path, community): the smallest path of each community as its label; one community below ``small`` files."""
    labels = nodes.select(F.col("path").alias("node"), F.col("path").alias("label"))
    if nodes.limit(small).count() < small:
        low = nodes.agg(F.min("path").alias("community"))
        return nodes.select("path").crossJoin(F.broadcast(low))
    near = scratch.keep(neighbours(nodes, edges), "near")
    for turn in range(rounds):
        after = scratch.keep(label_round(labels, near), f"labels-{turn}")
        moved = after.join(labels.withColumnRenamed("label", "before"), "node").where("label <> before")
        still = turn + 1 < rounds and moved.isEmpty()
        labels = after
        if turn:
            scratch.drop(f"labels-{turn - 1}")
        if still:
            break
    found = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(found, "label").select(F.col("node").alias("path"), "community")


def sweep_levels(near: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """(node) by the step of a sweep in the order of node in which it may move: after all its earlier neighbours have.

    A level is one more than the highest among a node's earlier neighbours, so
    no two neighbours share one, and there are as many as the longest rising
    path has nodes. No side of a join is broadcast, as nodes in order take
    little room in files, whatever their number.
    """
    earlier = scratch.keep(near.where("other < node").select("node", "other").distinct(), "earlier")
    left = scratch.keep(near.select("node").distinct(), "left")
    levels: list[DataFrame] = []
    while not left.isEmpty():
        k = len(levels)
        blocked = earlier.join(left.select(F.col("node").alias("other")).hint("merge"), "other", "left_semi").select("node").distinct()
        levels.append(scratch.keep(left.join(blocked.hint("merge"), "node", "left_anti"), f"level-{k}"))
        left = scratch.keep(left.join(levels[-1].hint("merge"), "node", "left_anti"), f"left-{k}")
        if k:
            scratch.drop(f"left-{k - 1}")
    return levels


def sweep(near: DataFrame, scratch: Scratch, passes: int = ROUNDS, strict: bool = False) -> DataFrame:
    """(node, label) after passes over all nodes in the order of node, each seeing what those before it have become.

    near has node, other and weight, in both directions. A node takes the label
    of most weight among its neighbours; of equal ones the smallest, or, with
    ``strict``, it stays unless another weighs more than its own, and of equal
    others takes that of its first neighbour by place, a further column of
    near. Labels are nodes at first. It ends after a pass in which none moved.

    Nodes of a level move at once, as no two of them are neighbours, so the
    result is that of a sequential sweep, in as many steps a pass as there are
    levels.
    """
    levels = sweep_levels(near, scratch)
    rows = near if strict else near.withColumn("place", F.lit(0))
    own = [scratch.keep(rows.join(level.hint("merge"), "node", "left_semi").select("node", "other", "weight", "place"), f"near-{k}") for k, level in enumerate(levels)]
    labels = [level.select("node", F.col("node").alias("label")) for level in levels]
    for turn in range(passes):
        moved = False
        for k, links in enumerate(own):
            every = labels[0]
            for part in labels[1:]:
                every = every.unionByName(part)
            votes = links.join(every.withColumnRenamed("node", "other").hint("merge"), "other").groupBy("node", "label").agg(F.round(F.sum("weight"), 6).alias("weight"), F.min("place").alias("place"))
            best = votes.groupBy("node").agg(F.max(F.struct("weight", (-F.col("place")).alias("place"))).alias("top"), F.min_by("label", F.struct(-F.col("weight"), "place" if strict else "label")).alias("new"))
            held = labels[k].join(best.hint("merge"), "node", "left")
            if strict:
                mine = votes.select("node", "label", F.col("weight").alias("mine"))
                held = held.join(mine.hint("merge"), ["node", "label"], "left")
                held = held.withColumn("new", F.when(F.col("top.weight") > F.coalesce("mine", F.lit(0)), F.col("new")).otherwise(F.col("label")))
            after = scratch.keep(held.select("node", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")), f"labels-{turn}-{k}")
            moved = moved or not after.where("moved").isEmpty()
            labels[k] = after.drop("moved")
            if turn:
                scratch.drop(f"labels-{turn - 1}-{k}")
        if not moved:
            break
    out = labels[0]
    for part in labels[1:]:
        out = out.unionByName(part)
    return out


# Folders of a path that name a community, and the share of its files that they must hold.
NAME_FOLDERS, NAME_SHARE = 2, 0.45


def detected(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, scratch: Scratch, passes: int = 8) -> DataFrame:
    """(path, community, name, top_hub) by a strict sweep over nodes (path, place) in the order of place, edges (from_path, to_path, place) without weights.

    The community is the path of the node whose label it has. It is named by
    the first two segments of most of its paths, the first of these by order,
    if they hold NAME_SHARE of them, else by its hub: the file of highest rank
    (path, rank_score), the first of equals.
    """
    spot = nodes.select("path", F.col("place").alias("spot"))
    a, c = spot.toDF("from_path", "node"), spot.toDF("to_path", "other")
    links = edges.where("from_path <> to_path").join(a, "from_path").join(c, "to_path").select("node", "other", "place")
    both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"), "place")).groupBy("node", "other").agg(F.min("place").alias("place")).withColumn("weight", F.lit(1))
    found = sweep(scratch.keep(both, "both"), scratch, passes, strict=True)
    member = spot.join(found.select(F.col("node").alias("spot"), "label"), "spot", "left").withColumn("label", F.coalesce("label", "spot"))
    member = member.join(spot.select(F.col("spot").alias("label"), F.col("path").alias("community")), "label")
    hubs = member.join(ranks.select("path", "rank_score"), "path", "left").groupBy("community").agg(F.min_by("path", F.struct(-F.coalesce("rank_score", F.lit(0.0)), "spot")).alias("top_hub"), F.count("*").alias("n"))
    folder = F.array_join(F.slice(F.split("path", "/"), 1, NAME_FOLDERS), "/")
    dirs = member.where(F.instr("path", "/") > 0).groupBy("community", folder.alias("dir")).agg(F.count("*").alias("held"), F.min("spot").alias("first"))
    common = dirs.groupBy("community").agg(F.max_by(F.struct("dir", "held"), F.struct("held", -F.col("first"))).alias("d"))
    base = F.substring_index("top_hub", "/", -1)
    name = F.when(F.col("n") == 1, base).when(F.col("d.held") >= F.col("n") * NAME_SHARE, F.col("d.dir")).otherwise(F.concat(F.coalesce(F.nullif(F.substring_index(base, ".", 1), F.lit("")), F.col("top_hub")), F.lit(" Domain")))
    named = hubs.join(common, "community", "left").select("community", name.alias("name"), "top_hub")
    return member.join(named, "community").select("path", "community", "name", "top_hub")


def summaries(membership: DataFrame, ranks: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(community, name, file_count, top_hub, cohesion), a row per community; with names (path, ordinal, name), the hub's first three as key_exports.

    The hub has the highest rank, of equals the first path. Cohesion is the
    share of possible pairs that are linked; 1 for a single file. The name is
    the most frequent directory, if it holds half of the files, else the hub's.
    """
    own = membership.join(ranks.select("path", "rank_score"), "path")
    first = Window.partitionBy("community").orderBy(F.col("rank_score").desc(), "path")
    hubs = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("community", F.col("path").alias("top_hub"))
    sizes = membership.groupBy("community").agg(F.count("*").alias("file_count"))
    a = membership.select(F.col("path").alias("from_path"), F.col("community"))
    b = membership.select(F.col("path").alias("to_path"), F.col("community").alias("other"))
    inside = edges.join(a, "from_path").join(b, "to_path").where("community = other and from_path <> to_path")
    inside = inside.select("community", F.least("from_path", "to_path").alias("a"), F.greatest("from_path", "to_path").alias("b")).distinct().groupBy("community").agg(F.count("*").alias("pairs"))
    dirs = membership.groupBy("community", directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n"))
    common = dirs.withColumn("_n", F.row_number().over(Window.partitionBy("community").orderBy(F.col("n").desc(), F.col("dir").desc()))).where("_n = 1").select("community", "dir", "n")
    joined = sizes.join(hubs, "community").join(inside, "community", "left").join(common, "community").fillna(0, ["pairs"])
    possible = F.col("file_count") * (F.col("file_count") - 1) / 2
    stem = F.regexp_replace(basename(F.col("top_hub")), r"\.[^.]*$", "")
    spoken = F.replace(F.regexp_replace("dir", "^src/", ""), F.lit("/"), F.lit(" / "))
    name = F.when(F.col("file_count") == 1, basename(F.col("top_hub"))).when(F.col("n") >= F.greatest(F.floor(F.col("file_count") / 2), F.lit(1)), spoken).otherwise(F.concat(stem, F.lit(" Domain")))
    cohesion = F.when(F.col("file_count") <= 1, 1.0).otherwise(F.least(F.col("pairs") / possible, F.lit(1.0)))
    out = joined.select("community", name.alias("name"), "file_count", "top_hub", F.round(cohesion, 6).alias("cohesion"))
    if names is None:
        return out
    first = names.join(hubs.select(F.col("top_hub").alias("path")), "path", "left_semi").groupBy("path", "name").agg(F.min("ordinal").alias("ordinal"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "name"))).where(F.col("_n") <= KEY_EXPORTS)
    told = first.groupBy(F.col("path").alias("top_hub")).agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("s")).select("top_hub", F.col("s.name").alias("key_exports"))
    return out.join(told, "top_hub", "left").withColumn("key_exports", F.coalesce("key_exports", F.array().cast("array<string>")))
