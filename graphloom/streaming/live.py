"""Streaming: debounced changes, telemetry sessions, and incremental tables equal to full builds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources.buckets import Bucketed

#: Milliseconds of quiet after which a changed file is due, and its bounds.
DEBOUNCE_MS, SHORTEST_MS, LONGEST_MS = 150, 50, 60_000
#: Share of changed files above which a full build is cheaper.
FULL_SHARE = 0.25


def debounce_ms(asked: int | None) -> int:
    return max(SHORTEST_MS, min(DEBOUNCE_MS if asked is None else asked, LONGEST_MS))


def bursts(marks: DataFrame, key: str, at: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """(key, first_at, due_at, n_marks): a row per burst of marks of a key, due after a quiet gap.

    Re-marking restarts the wait. Works on batches and, with a watermark on the
    timestamp column ``at``, on streams in append mode.
    """
    marked = marks.withWatermark(at, late) if marks.isStreaming else marks
    window = F.session_window(at, quiet)
    grouped = marked.groupBy(key, window.alias("w")).agg(F.count("*").alias("n_marks"))
    return grouped.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("due_at"), "n_marks")


def pending(marks: DataFrame) -> DataFrame:
    """(path, marked_at): the latest mark of each path, from an append-only log of marks."""
    return marks.groupBy("path").agg(F.max("marked_at").alias("marked_at"))


def due(marks: DataFrame, now_ms: int, wait_ms: int | None = None) -> DataFrame:
    """Pending paths whose wait is over at now_ms."""
    return pending(marks).where(F.lit(now_ms) - F.col("marked_at") >= debounce_ms(wait_ms))


def run_to(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Processes what is available now, in append mode, to parquet."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def reconcile(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): added, changed or deleted files between two snapshots (path, size_bytes, mtime)."""
    a = known.select("path", F.col("size_bytes").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("was"))
    b = found.select("path", "size_bytes", "mtime", F.lit(True).alias("now"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when((F.col("old_size") != F.col("size_bytes")) | (F.col("old_mtime") != F.col("mtime")), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def needs_full_build(known: DataFrame, changes: DataFrame) -> bool:
    return changes.count() > FULL_SHARE * max(known.count(), 1)


def affected(changes: DataFrame, file_edges: DataFrame) -> DataFrame:
    """(path): changed files and the files that depend on them, whose facts must be built anew."""
    direct = changes.select("path")
    return direct.union(file_edges.join(direct, file_edges["to_path"] == direct["path"], "left_semi").select("from_path")).distinct()


def replaced(table: DataFrame, key: str, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """``table`` without the rows of changed paths, and with the fresh rows of those that still exist."""
    gone = changed.select(F.col("path").alias(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(fresh.join(gone, key, "left_semi"))


def apply_changes(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of changes to ``write``, which must be idempotent per batch id."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_changes(
    tables: Bucketed, changes: DataFrame, batch: int, symbols_of: Callable[[DataFrame], DataFrame], edges_of: Callable[[DataFrame, DataFrame], DataFrame], asking: Callable[[DataFrame], DataFrame] | None = None
) -> bool:
    """Merges a batch of changed files (path) into tables ``symbols`` (file_path, ...) and ``edges`` (from_path, to_path, ...).

    Files that depend on a changed one are looked for before its rows go, and
    their edges are resolved again with its own, as a name may now be found
    elsewhere or nowhere. ``symbols_of`` gives the symbols that paths now have,
    none for a deleted file; ``edges_of`` the edges of paths, resolved against
    all symbols as they will be. ``asking`` gives the files (path) that ask for
    a fresh symbol's name, which a changed file may take over from another;
    without it, only dependents are resolved again. A batch that was merged
    before changes nothing.
    """
    if tables.batch is not None and batch <= tables.batch:
        return False
    changed = changes.select("path").distinct()
    redone = affected(changed, tables.read("edges"))
    fresh = symbols_of(changed)
    if asking:
        redone = redone.unionByName(asking(fresh).select("path")).distinct()
    after = replaced(tables.read("symbols"), "file_path", changed, fresh)
    return tables.merge({"symbols": (changed, fresh), "edges": (redone, edges_of(redone, after))}, batch)


def telemetry_tail(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New telemetry rows as they are appended to a folder; ratio falls back to 18.5 where output is 0 but tokens were saved."""
    rows = spark.readStream.schema(schema).parquet(folder)
    ratio = F.when(F.col("output_tokens") > 0, F.col("raw_tokens") / F.col("output_tokens")).when(F.col("raw_tokens") > 0, 18.5).otherwise(1.0)
    return rows.withColumn("ratio", ratio)


def staleness(pending_marks: DataFrame, referenced: DataFrame, now_ms: int) -> DataFrame:
    """(path, elapsed_ms, inside): files that wait for an update, and whether an answer refers to them (path)."""
    inside = referenced.select("path").distinct().withColumn("inside", F.lit(True))
    waited = F.greatest(F.lit(now_ms) - F.col("marked_at"), F.lit(0)).alias("elapsed_ms")
    return pending(pending_marks).join(inside, "path", "left").select("path", waited, F.coalesce("inside", F.lit(False)).alias("inside"))


#: Milliseconds for which the targets of a call stay active.
PULSE_MS = 2000


def active_targets(calls: DataFrame, now_ms: int) -> DataFrame:
    """(target, until_ms): targets of calls (target, ms) that are active at a time; a later call keeps one active longer."""
    return calls.where(F.col("ms") <= now_ms).groupBy("target").agg((F.max("ms") + PULSE_MS).alias("until_ms")).where(F.col("until_ms") > now_ms)


def synced(symbols: DataFrame, edges: DataFrame, changed: DataFrame, fresh_symbols: DataFrame, fresh_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (file_path, ...) and file edges (from_path, to_path, ...) after changed files (path) are read anew.

    Rows of changed files go and fresh ones come, if their file still exists;
    edges of other files to a file without symbols left go too.
    """
    gone = changed.select("path").distinct()
    own = replaced(symbols, "file_path", gone, fresh_symbols)
    kept = replaced(edges, "from_path", gone, fresh_edges)
    lost = gone.join(own.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti").withColumnRenamed("path", "to_path")
    return own, kept.join(lost, "to_path", "left_anti").select(*edges.columns)
