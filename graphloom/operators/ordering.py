"""Global positions and first-wins choices without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import Scratch


def with_position(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "position") -> DataFrame:
    """``df`` with its 1-based position in the order, in a column of that name.

    Rows are dealt out by ranges of the order; each range counts its own rows
    and adds the counts of the ranges before it. Order columns must tell rows
    apart for positions to be reproducible.
    """
    part, n, before, within = (spare(x, df) for x in ("_range", "_n", "_before", "_within"))
    own = scratch.keep(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), f"{name}-ranges")
    counts = own.groupBy(part).agg(F.count("*").alias(n))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    placed = own.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(offsets), part)
    return placed.withColumn(name, (F.col(before) + F.col(within)).cast("long")).drop(part, within, before)


def spare(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order (first-wins; descending order for last-wins). Tasks keep one row a key before rows are dealt out."""
    n = spare("_n", df)
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def running_totals(df: DataFrame, order: list[str], amount: str, scratch: Scratch, name: str = "upto") -> DataFrame:
    """``df`` with the sum of an amount over all rows up to its own in the order, in a column of that name.

    As with_position: ranges of the order sum up their own rows and add the sums
    of the ranges before.
    """
    part, own, past = (spare(x, df) for x in ("_range", "_own", "_past"))
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), f"{name}-sums")
    sums = dealt.groupBy(part).agg(F.sum(amount).alias(own))
    before = sums.select(part, F.coalesce(F.sum(own).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(past))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.withColumn(own, F.sum(amount).over(inside)).join(F.broadcast(before), part).withColumn(name, F.col(past) + F.col(own)).drop(part, own, past)


def last_rows(df: DataFrame, column: str, keep: int) -> DataFrame:
    """Rows whose id is above max - keep: the rolling retention of a log."""
    most = spare("_top", df)
    top = df.agg(F.max(column).alias(most))
    return df.crossJoin(F.broadcast(top)).where(F.col(column) > F.col(most) - keep).drop(most)
