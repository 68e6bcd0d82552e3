"""Keys that hold most rows, spread over tasks, and results held against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, lookup, ordering, pairs, scans, search, telemetry


@pytest.fixture()
def parted(spark):
    """Keeps small ranges apart, as large ones are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_key_meets_in_blocks(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([("cold", -1), (None, -2), ("left", -3)], "k string, a long"))
    right = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("b")).unionByName(spark.createDataFrame([("cold", 7), (None, 8), ("right", 9)], "k string, b long"))
    got = pairs.meet(left, right, ["k"], block=64).groupBy().agg(F.count("*"), F.sum("a"), F.sum("b"), F.count_distinct("a", "b")).first()
    assert tuple(got) == (500_001, 500 * 499_500 - 1, 1000 * 124_750 + 7, 500_001)
    assert pairs.meet(left, right.limit(0), ["k"]).count() == 0
    clash = pairs.meet(left.withColumn("_i", F.lit(1)), right.withColumn("_n_left", F.lit(2)), ["k"], block=64)
    assert clash.columns == ["k", "a", "_i", "b", "_n_left"] and clash.count() == 500_001


def test_a_hot_channel_fills_many_small_keys(spark):
    """100,000 members of a key: how many of them meet at one place of the join."""
    left = spark.range(100_000).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    sizes = left.groupBy(F.pmod(F.xxhash64("k", "a"), F.lit(98))).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[1] == 98 and sizes[0] < 1300


def test_triangles_and_neighbourhoods_equal_plain_loops(spark):
    rnd = random.Random(4)
    edges = {(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", rnd.choice(["imports", "calls", "route"])) for _ in range(60)} | {("hub", f"n{k}", "imports") for k in range(12)} | {("n1", "n1", "calls"), ("far", "away", "route")}
    nodes = sorted({x for e in edges for x in e[:2]})
    df = spark.createDataFrame(sorted(edges), "from_path string, to_path string, kind string")
    linked = {frozenset(e[:2]) for e in edges if e[0] != e[1]}
    want = {frozenset((a, b, c)) for a in nodes for b in nodes for c in nodes if len({a, b, c}) == 3 and {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= linked}
    got = [frozenset(r) for r in pairs.triangles(df.select(F.col("from_path").alias("a"), F.col("to_path").alias("b"))).collect()]
    assert len(got) == len(want) and set(got) == want
    asked = [n for n in nodes if n != "n3"]
    anchors = spark.createDataFrame([(n,) for n in [*asked, "none"]], "anchor string")

    def around(anchor, most=None):
        near = sorted({b if a == anchor else a for a, b, kind in edges if kind != "route" and anchor in (a, b) and a != b})
        return {anchor, *near[: None if most is None else most - 1]}

    plain = lambda most, limit: [(n, *e) for n in asked for e in sorted(e for e in edges if e[0] in around(n, most) and e[1] in around(n, most))[:limit]]
    assert sorted(map(tuple, graph.neighbourhood(df, anchors).collect())) == sorted(plain(None, None))
    assert sorted(map(tuple, graph.neighbourhood(df, anchors, nodes=4, most=3).collect())) == sorted(plain(4, 3))


def test_traces_stop_where_an_anchor_has_its_rows(spark):
    rnd = random.Random(6)
    edges = sorted({(rnd.randrange(30), rnd.randrange(30)) for _ in range(150)})
    symbols = spark.createDataFrame([(k, f"f{k % 7}", "a") for k in range(30)], "id long, name string, file_path string")
    df = spark.createDataFrame([(a, b, "calls") for a, b in edges], "from_id long, to_id long, kind string")
    got = graph.trace(symbols, df, spark.range(30).select(F.col("id").alias("anchor")), depth=4, limit=20)
    want = []
    for anchor in range(30):
        chains, own = [[anchor]], []
        for hops in range(5):
            own += sorted((hops, " > ".join(f"f{k % 7}" for k in c), c[-1], c) for c in chains)
            chains = [[*c, b] for c in chains for a, b in edges if a == c[-1] and b not in c]
        want += [(anchor, k, hops, path) for hops, path, k, _ in own[:20]]
    assert sorted((r.anchor, r.id, r.hops, r.path) for r in got.collect()) == sorted(want)
    assert graph.trace(symbols, df, spark.createDataFrame([(1,)], "anchor long"), limit=0).count() == 0
    assert graph.trace(symbols, df, spark.createDataFrame([(1,)], "anchor long"), depth=1, limit=None).count() == 1 + len({b for a, b in edges if a == 1 and b != 1})


@pytest.mark.parametrize("users", [1, 3])
def test_one_user_s_calls_fill_many_tasks(spark, scratch, parted, users):
    rnd = random.Random(9)
    rows, clock = [], 0
    for k in range(3000):
        clock += rnd.choice([0, 5, 100, 3000, 3001, 9000])
        rows.append((k, rnd.randrange(users) or None, clock, rnd.randrange(5000), rnd.randrange(300), "x"))
    df = spark.createDataFrame(rows, "id long, user long, ms long, raw_tokens long, output_tokens long, _part string").repartition(8)
    got = telemetry.with_totals(telemetry.with_turns(df, "user", F.col("ms"), ["ms", "id"]), "user", ["ms", "id"])
    assert got.columns[:6] == df.columns
    state, want = {}, {}
    for k, user, ms, _, out, _ in rows:
        last, turn, in_turn, in_all = state.get(user, (None, 1, 0, 0))
        if last is not None and ms - last > telemetry.GAP_MS:
            turn, in_turn = turn + 1, 0
        state[user] = (ms, turn, in_turn + out, in_all + out)
        want[k] = (turn, in_turn + out, in_all + out)
    assert {r.id: (r.turn_id, r.turn_total_output, r.session_total_output) for r in got.collect()} == want
    dealt, part = scans.dealt_by_range(df, [F.col("user"), F.col("ms"), F.col("id")], scratch, "d")
    assert dealt.groupBy(part).count().count() > 1 and part == "_part_"


def test_smoothed_values_of_one_key(spark, parted):
    rnd = random.Random(2)
    rows = [("a", k, None if k == 50 else rnd.random()) for k in range(2000)]
    ema = None
    for _, _, v in rows:
        ema = v if ema is None or v is None else 0.3 * v + 0.7 * ema
    got = telemetry.smoothed(spark.createDataFrame(rows, "k string, n long, v double").repartition(5), "k", "n", "v", decimals=9).first()
    assert got.ema == pytest.approx(ema, abs=1e-8)


def test_helper_columns_leave_own_ones_alone(spark, scratch, parted):
    df = spark.createDataFrame([(k, k, 1, 2, 3) for k in range(5)], "id long, ms long, _top int, _range int, _n int")
    assert ordering.last_rows(df, "id", 2).columns == df.columns and ordering.last_rows(df, "id", 2).count() == 2
    placed = ordering.with_position(df, [F.desc("id")], scratch)
    assert placed.columns == [*df.columns, "position"] and {r.id: r.position for r in placed.collect()} == {k: 5 - k for k in range(5)}
    assert telemetry.recent(df, "_top", [F.desc("id")], 2).columns == df.columns


def test_names_that_hold_others(spark):
    names = ["loadFile", "LOAD", "reload_all", "x", "Xy", "", "ab", "aXb", None]
    asked = ["load", "LO", "x", "", "filet", "a", None]
    df = spark.createDataFrame([(k, n, "f", "function") for k, n in enumerate(names)], "id long, name string, file_path string, kind string")
    got = sorted((r.asked, r.id) for r in search.holding(df, spark.createDataFrame([(a,) for a in asked], "asked string")).collect())
    assert got == sorted((a, k) for a in asked if a for k, n in enumerate(names) if n and a.lower() in n.lower())
    assert sorted((r.asked, r.id) for r in lookup.by_name(df.unionByName(df.withColumn("id", F.col("id") + 100)), spark.createDataFrame([("x",), ("no",)], "asked string"), 2).collect()) == [("x", 3), ("x", 103)]


@pytest.mark.parametrize("distance", [1, 2])
def test_spellings_equal_all_pairs(spark, distance):
    rnd = random.Random(distance)
    words = {"", "a", "é", "aaaa", "aaaaaaaa"} | {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 14))) for _ in range(250)}
    names, asked = sorted(words), sorted(words)[::4] + ["bbbbbbbbbbbb", "zzz"]
    one = lambda rows, c: spark.createDataFrame([(w,) for w in [*rows, None, rows[0]]], f"{c} string")
    got = sorted(map(tuple, search.spelt_alike(one(names, "name"), one(asked, "asked"), distance).collect()))
    assert got == sorted((a, n, d) for a in asked for n in names if (d := levenshtein(a, n)) <= distance)
