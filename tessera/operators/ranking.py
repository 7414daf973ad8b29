"""Ranks over whole tables without a task that sees the whole table: ranges of the order, their counts, and places inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sample_bounds(df: DataFrame, keys: list[str], parts: int, sample: int) -> list:
    """At most parts - 1 rows of keys that cut the order into ranges of like size, from the `sample` distinct keys of least hash."""
    few = df.select(*keys).distinct().orderBy(F.xxhash64(*keys), *keys).limit(sample)
    rows = few.select(F.struct(*keys).alias("k")).orderBy("k").collect()
    step = max(1, -(-len(rows) // parts))
    return [r["k"] for r in rows[step::step]]


def _at_least(df: DataFrame, keys: list[str], bound) -> Column:
    held = F.struct(*[F.lit(bound[k]).cast(df.schema[k].dataType).alias(k) for k in keys])
    return F.struct(*keys) >= held


def total_rank(df: DataFrame, keys: list[str], name: str = "rank", weight: str | None = None, parts: int | None = None, sample: int = 20_000) -> DataFrame:
    """Add each row's place (from 1) in the order of keys, ascending, nulls first. Equal keys get places in any order.

    With `weight`, a row stands for so many: its place is that of the first of them. The driver holds `sample` keys and a count a range, whatever
    the table's size; a range is sorted by one task. df is read several times and must give the same rows each time.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _sample_bounds(df, keys, parts, sample)
    within = F.array(*[_at_least(df, keys, b) for b in bounds]) if bounds else None
    ranged = df.withColumn("__range", F.size(F.filter(within, lambda b: b)) if bounds else F.lit(0))
    held = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("__range").agg(held.alias("n")).collect(), key=lambda r: r["__range"]):
        offsets.append((r["__range"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "__range int, __before long")
    order = Window.partitionBy("__range").orderBy(*keys)
    place = F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1 if weight else F.row_number().over(order)
    return ranged.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__range", "__place", "__before")
