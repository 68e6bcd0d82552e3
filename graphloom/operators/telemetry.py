"""Token telemetry: turns by gaps, running totals, bounded logs, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import token_estimate
from graphloom.operators.ordering import running_totals, spare
from graphloom.operators.scans import numbered_gaps, running_sums
from graphloom.storage import Scratch

#: Milliseconds of silence after which a new turn begins; tokens of output that warn; smoothing of rates.
GAP_MS, WARN_TOKENS, ALPHA = 3000, 4000, 0.3


def with_turns(calls: DataFrame, key: str, ms: Column, order: list[str], gap_ms: int = GAP_MS) -> DataFrame:
    """``calls`` with turn_id: 1 for a key's first call, one more after each gap longer than gap_ms. A key's calls may fill many tasks."""
    return numbered_gaps(calls, key, order, ms, gap_ms, Scratch(calls.sparkSession, "turns"), "turn_id")


def with_totals(calls: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Calls with saved_tokens, compression_ratio, turn and session totals and large: needs raw_tokens, output_tokens, turn_id.

    Turns follow one another in the order, so totals of both come from the same
    ranges of (key, turn, order).
    """
    saved = F.greatest(F.col("raw_tokens") - F.col("output_tokens"), F.lit(0))
    both = (F.col("output_tokens") > 0) & (F.col("raw_tokens") > 0)
    ratio = F.when(both, F.greatest(F.col("raw_tokens") / F.col("output_tokens"), F.lit(1.0))).otherwise(1.0)
    own = calls.withColumns({"saved_tokens": saved.cast("long"), "compression_ratio": F.round(ratio, 6), "large": F.col("output_tokens") > WARN_TOKENS})
    out = F.col("output_tokens")
    sums = {"turn_total_output": ([key, "turn_id"], out), "session_total_output": ([key], out)}
    return running_sums(own, sums, [F.col(key), F.col("turn_id"), *map(F.col, order)], Scratch(calls.sparkSession, "totals"))


def overall(calls: DataFrame, key: str) -> DataFrame:
    """(key, saved, output, ratio): (saved + output) / output of each session, 1 without output."""
    sums = calls.groupBy(key).agg(F.sum("saved_tokens").alias("saved"), F.sum("output_tokens").alias("output"))
    return sums.withColumn("ratio", F.when(F.col("output") > 0, F.round((F.col("saved") + F.col("output")) / F.col("output"), 6)).otherwise(1.0))


def tag(row: dict) -> str:
    """The line that tells a caller what a call cost."""
    ratio = f"{row['compression_ratio']:.1f}x"
    # Fixed value: the wording of the line.
    return f"[Telemetry: Tool '{row['tool']}' | Out: {row['output_tokens']} tokens | Saved: {row['saved_tokens']} tokens ({ratio}) | Turn #{row['turn_id']}: {row['turn_total_output']} tokens | Session: {row['session_total_output']} tokens]"


def recent(calls: DataFrame, key: str, order: list[Column], keep: int = 100) -> DataFrame:
    """The last ``keep`` rows of each key."""
    n = spare("_n", calls)
    return calls.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) <= keep).drop(n)


def smoothed(samples: DataFrame, key: str, order: str, value: str, alpha: float = ALPHA, decimals: int = 6) -> DataFrame:
    """(key, ema): values folded in order, each new one with weight alpha; the first stands alone.

    A null gives null and the next value stands alone again. Each value's weight
    follows from its distance to the end, which ranges of (key, order) count, so
    a key's values may fill many tasks.
    """
    rows = samples.select(F.col(key), F.col(order).alias("at"), F.col(value).cast("double").alias("v"))
    sums = {"d": ([key], F.lit(1)), "nulls": ([key], F.col("v").isNull().cast("int"))}
    placed = running_sums(rows, sums, [F.col(key), F.col("at").desc(), F.col("v").desc()], Scratch(samples.sparkSession, "smoothed"))
    own = F.when(F.col("nulls") == 0, F.col("v"))
    share = F.pow(F.lit(1 - alpha), F.col("d") - 1)
    first = F.max_by(own * share, F.when(own.isNotNull(), F.col("d")))
    return placed.groupBy(key).agg(F.round(F.sum(own * share) * alpha + first * (1 - alpha), decimals).alias("ema"))


def percentile_rank(samples: DataFrame, key: str, value: str, share: float = 0.95) -> DataFrame:
    """(key, mean, at_place): the mean and the value at place floor(share * n) of the sorted values, from 0.

    Nulls don't count. Equal values are counted together and running counts come
    from ranges of (key, value), so no task holds a key's values.
    """
    counts = samples.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v")).groupBy("k", "v").agg(F.count("*").alias("n"))
    placed = running_totals(counts, ["k", "v"], "n", Scratch(samples.sparkSession, "percentile"))
    keys = placed.groupBy("k").agg(F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.col("upto") - F.col("n")).alias("start"))
    aim = F.col("start") + F.least(F.floor(F.col("total") * share), F.col("total") - 1) + 1
    hit = (F.col("upto") >= aim) & (F.col("upto") - F.col("n") < aim)
    return placed.join(keys, "k").where(hit).select(F.col("k").alias(key), F.round("mean", 6).alias("mean"), F.col("v").alias("at_place"))


def eta(samples: DataFrame, key: str, order: str, done: str, total: str, seconds: str, alpha: float = ALPHA) -> DataFrame:
    """(key, speed, eta_seconds): smoothed items a second between a run's samples, and the seconds left; 0 when complete, null while unknown."""
    by_key = Window.partitionBy(key).orderBy(order)
    steps = samples.withColumn("_speed", (F.col(done) - F.lag(done).over(by_key)) / F.nullif(F.col(seconds) - F.lag(seconds).over(by_key), F.lit(0)))
    speed = smoothed(steps.where("_speed is not null"), key, order, "_speed", alpha).withColumnRenamed("ema", "speed")
    last = samples.groupBy(key).agg(F.max_by(F.col(total) - F.col(done), order).alias("left"))
    rest = F.when(F.col("left") <= 0, 0.0).when(F.col("speed") > 0, F.round(F.col("left") / F.col("speed"), 6))
    return last.join(speed, key, "left").select(key, "speed", rest.alias("eta_seconds"))


# Tokens that a tool's answer would have cost without a map, and those of a file that can't be read.
RAW_PER_FILE = 1500


def raw_cost(referenced: DataFrame, contents: DataFrame) -> DataFrame:
    """(call, raw_tokens): tokens of the distinct files that each call refers to (call, path), of files (path, tokens).

    Leading slashes don't count. A call whose files have no tokens costs RAW_PER_FILE for each reference, at least one.
    """
    clean = referenced.withColumn("path", F.regexp_replace("path", r"^[/\\]+", ""))
    asked = clean.groupBy("call").agg(F.count("*").alias("asked"))
    sums = clean.distinct().join(contents.select("path", "tokens"), "path").groupBy("call").agg(F.sum("tokens").alias("tokens"))
    cost = F.when(F.coalesce("tokens", F.lit(0)) == 0, F.greatest("asked", F.lit(1)) * RAW_PER_FILE).otherwise(F.col("tokens"))
    return asked.join(sums, "call", "left").select("call", cost.alias("raw_tokens"))


# Tokens that an answer of a tool costs without a map: whatever it names, where it names no files, and of any other tool.
TOOL_TOKENS = {"callers": 3500, "callees": 3500, "delete": 500}
UNNAMED_TOKENS = {"explore": 3500, "search": 3500, "impact": 4000, "node": 1500, "edit": 2000, "batch_edit": 2500, "edit_symbol": 1500, "write": 1500}
OTHER_TOKENS, WRITTEN_TOKENS = 1000, 500


def _told(tool: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.lit(v).cast("long") for v in values.values()))), tool)


def tool_cost(calls: DataFrame, referenced: DataFrame, contents: DataFrame) -> DataFrame:
    """(call, raw_tokens) of all calls (call, tool, n_asked, content): what each would have cost without a map.

    Tools of TOOL_TOKENS cost the same always. Those of UNNAMED_TOKENS cost
    their files (see ``raw_cost``), or else that value, explore for each of the
    n_asked names (null: one). A write costs its content and WRITTEN_TOKENS.
    Other tools, and a null tool, cost OTHER_TOKENS.
    """
    own = calls.join(raw_cost(referenced, contents).withColumnRenamed("raw_tokens", "of_files"), "call", "left")
    unnamed = _told(F.col("tool"), UNNAMED_TOKENS)
    times = F.when(F.col("tool") == "explore", F.coalesce("n_asked", F.lit(1))).otherwise(1)
    written = F.when((F.col("tool") == "write") & F.col("content").isNotNull(), token_estimate(F.col("content")) + WRITTEN_TOKENS)
    of_files = F.when(unnamed.isNotNull() & (F.col("tool") != "write"), F.col("of_files"))
    cost = F.coalesce(_told(F.col("tool"), TOOL_TOKENS), written, of_files, unnamed * times, F.lit(OTHER_TOKENS))
    return own.select("call", cost.cast("long").alias("raw_tokens"))
