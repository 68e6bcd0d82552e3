"""Running sums within keys whose rows may fill many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ordering import spare
from graphloom.storage import Scratch


def _carried(dealt: DataFrame, part: str, keys: list[str], segments: DataFrame, columns: list[str]) -> DataFrame:
    """``dealt`` with the columns of its key's segment, null where the key is in one part only.

    ``segments`` has a row per part and key that reaches over several parts; as
    parts are ranges, these are two a part at most, so they are sent to all tasks.
    """
    on = [part, *keys]
    small = segments.select(*(F.col(c).alias(f"s_{k}") for k, c in enumerate(on)), *columns)
    same = F.lit(True)
    for k, c in enumerate(on):
        same = same & F.col(c).eqNullSafe(F.col(f"s_{k}"))
    return dealt.join(F.broadcast(small), same, "left").drop(*(f"s_{k}" for k in range(len(on))))


def dealt_by_range(df: DataFrame, by: list[Column], scratch: Scratch, name: str) -> tuple[DataFrame, str]:
    """``df``, kept, dealt out by ranges of an order, and the name of the column that numbers the ranges."""
    part = spare("_part", df)
    return scratch.keep(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), name), part


def running_sums(df: DataFrame, sums: dict[str, tuple[list[str], Column]], by: list[Column], scratch: Scratch, name: str = "running") -> DataFrame:
    """``df`` with columns that sum up an amount over the rows of a key up to each row.

    ``sums`` gives (key columns, amount) for each new column; ``by`` is an order
    in which the rows of each of these keys stand together. Ranges of the order
    sum up on their own; sums of a key's earlier ranges are added, so a key of
    any size is shared by tasks. Rows that the order doesn't tell apart are in
    one range, in an arbitrary order.
    """
    dealt, part = dealt_by_range(df, by, scratch, name)
    amount, before, many = (spare(x, df) for x in ("_amount", "_before", "_many"))
    out = dealt
    for column, (keys, value) in sums.items():
        own = dealt.select(part, *keys, value.alias(amount)).groupBy(part, *keys).agg(F.sum(amount).alias(amount))
        of_key = Window.partitionBy(*keys)
        earlier = of_key.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        segments = own.withColumns({before: F.sum(amount).over(earlier), many: F.count("*").over(of_key)}).where(F.col(many) > 1)
        inside = Window.partitionBy(part, *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = _carried(out.withColumn(column, F.sum(value).over(inside)), part, keys, segments, [before])
        out = out.withColumn(column, F.col(column) + F.coalesce(before, F.lit(0))).drop(before)
    return out.drop(part)


def numbered_gaps(df: DataFrame, key: str, order: list[str], at: Column, gap: int, scratch: Scratch, column: str) -> DataFrame:
    """``df`` with a number that is 1 at a key's first row and grows by one after each gap in ``at`` that is longer than ``gap``.

    Each range counts its own gaps; a range's first row of a key is held against
    the last one of that key before.
    """
    when, new = spare("_at", df), spare("_new", df)
    dealt, part = dealt_by_range(df.withColumn(when, at), [F.col(key), *map(F.col, order)], scratch, column)
    inside = Window.partitionBy(part, key).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn(new, F.when(F.col(when) - F.lag(when).over(inside) > gap, 1).otherwise(0)).withColumn(column, F.sum(new).over(running))
    place = F.struct(*order)
    own = dealt.groupBy(part, key).agg(F.min_by(when, place).alias("first"), F.max_by(when, place).alias("last"), F.sum(new).alias("gaps"), F.count("*").alias("rows"))
    by_part = Window.partitionBy(key).orderBy(part)
    opened = F.when(F.col("first") - F.lag("last").over(by_part) > gap, 1).otherwise(0)
    own = own.withColumn("opened", opened).withColumn("parts", F.count("*").over(Window.partitionBy(key)))
    offset = spare("_offset", dealt)
    segments = own.where("parts > 1").withColumn(offset, F.coalesce(F.sum(F.col("gaps") + F.col("opened")).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("opened"))
    out = _carried(dealt, part, [key], segments, [offset])
    return out.withColumn(column, (1 + F.col(column) + F.coalesce(offset, F.lit(0))).cast("long")).drop(part, when, new, offset)
