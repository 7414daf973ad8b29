"""Grouped cross-validation as tables: folds, roles, nested roles, coverage, task plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_table(rows: DataFrame, year: str, block: str, families: Sequence[str] = ("temporal", "spatial", "joint")) -> DataFrame:
    """(family, fold, held_year, held_block): a fold a year, a block, or a year and block that occur together."""
    out = None
    for f in families:
        y = F.col(year).cast("long") if f != "spatial" else F.lit(None).cast("long")
        b = F.col(block).cast("string") if f != "temporal" else F.lit(None).cast("string")
        part = rows.select(F.lit(f).alias("family"), y.alias("held_year"), b.alias("held_block")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.withColumn("fold", F.concat_ws("/", "family", F.col("held_year").cast("string"), "held_block"))


def _roles(rows: DataFrame, year: str, block: str, near: Column) -> DataFrame:
    in_year, in_block = F.coalesce(F.col(year) == F.col("held_year"), F.lit(False)), F.coalesce(F.col(block).cast("string") == F.col("held_block"), F.lit(False))
    joint = F.col("family") == "joint"
    test = F.when(F.col("family") == "temporal", in_year).when(F.col("family") == "spatial", in_block).otherwise(in_year & in_block)
    return rows.withColumn("role", F.when(test, "test").when(joint & (in_year | in_block | near), "purged").otherwise("train"))


def fold_roles(rows: DataFrame, folds: DataFrame, year: str, block: str, buffer: DataFrame | None = None, unit: str | None = None) -> DataFrame:
    """Every row with every fold and its role. Folds that hold a year or a block out have test and train rows alone; a joint fold tests what is in both, trains
    on what is in neither nor within the buffer of its block, and purges the rest.

    buffer: (held_block, unit); a joint fold without one is an error. The result is rows x folds: give it the distinct units by year and
    block (a role hangs on nothing else) where there are many rows.
    """
    j = rows.crossJoin(folds)
    if buffer is None:
        return _roles(j, year, block, F.when(F.col("family") == "joint", F.raise_error(F.lit("a joint fold needs a buffer")).cast("boolean")).otherwise(F.lit(False)))
    j = j.join(buffer.select("held_block", unit).distinct().withColumn("__near", F.lit(True)), ["held_block", unit], "left")
    return _roles(j, year, block, F.coalesce("__near", F.lit(False))).drop("__near")


def tested_rows(rows: DataFrame, folds: DataFrame, year: str, block: str) -> DataFrame:
    """Every row with the folds that test it: (the row, family, fold, held_year, held_block). Equi-joins, so there is a row a family and not a row a fold; folds go to all tasks."""
    b = F.col(block).cast("string")
    of = lambda family, on: rows.join(F.broadcast(folds.where(F.col("family") == family)), on)
    same_year, same_block = F.col(year) == F.col("held_year"), b == F.col("held_block")
    return of("temporal", same_year).unionByName(of("spatial", same_block)).unionByName(of("joint", same_year & same_block))


def inner_roles(roles: DataFrame, fold: str, year: str) -> DataFrame:
    """Each outer training row with each other training year held out: (inner_year, inner_role)."""
    train = roles.where("role = 'train'")
    years = train.select(fold, F.col(year).alias("inner_year")).distinct()
    return train.join(years, fold).withColumn("inner_role", F.when(F.col(year) == F.col("inner_year"), "validation").otherwise("train"))


def fold_definitions(rows: DataFrame, folds: DataFrame, keys: Sequence[str], year: str, block: str, day: str, unit: str, buffer: DataFrame) -> DataFrame:
    """Twelve counts a fold: rows, dates, units and blocks of its train, test and purged part.

    A role hangs on a row's year, block and unit alone. So folds meet units by year and dates by year and block, and not rows: a date has
    a row of each role that one of its units has, and only the buffer parts units of one block.
    """
    near = buffer.select("held_block", unit).distinct()
    n = F.count(F.lit(1))
    by_unit = fold_roles(rows.groupBy(year, block, unit).agg(n.alias("__n")), folds, year, block, near, unit)
    by_unit = by_unit.groupBy(*keys, "role", block, unit).agg(F.sum("__n").alias("__n"))
    sizes = by_unit.groupBy(*keys, "role").agg(F.sum("__n").alias("rows"), F.countDistinct(unit).alias("units"), F.countDistinct(block).alias("blocks"))
    dates = _roles(rows.groupBy(year, block, day).agg(n.alias("__all")).crossJoin(folds), year, block, F.lit(False))
    close = rows.join(near, unit).groupBy(year, block, day, "held_block").agg(n.alias("__near"))
    dates = dates.join(close, [year, block, day, "held_block"], "left").fillna(0, ["__near"])
    split = F.array_compact(F.array(F.when(F.col("__near") > 0, "purged"), F.when(F.col("__all") > F.col("__near"), "train")))
    parts = F.when((F.col("role") == "train") & (F.col("family") == "joint"), split).otherwise(F.array("role"))
    dates = dates.select(*keys, day, F.explode(parts).alias("role")).distinct().groupBy(*keys, "role").agg(n.alias("dates"))
    names = ("rows", "dates", "units", "blocks")
    both = sizes.unionByName(dates, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col(c))), F.lit(0)).alias(f"{r}_{c}") for r in ("train", "test", "purged") for c in names])


def coverage_violations(rows: DataFrame, folds: DataFrame, row_keys: Sequence[str], year: str, block: str) -> DataFrame:
    """(family, row keys, times): rows that are not tested exactly once in a family."""
    tested = tested_rows(rows, folds, year, block).groupBy("family", *row_keys).agg(F.count(F.lit(1)).alias("__times"))
    due = rows.select(*row_keys).distinct().crossJoin(folds.select("family").distinct())
    return due.join(tested, ["family", *row_keys], "left").select("family", *row_keys, F.coalesce("__times", F.lit(0)).alias("times")).where("times <> 1")


def task_plan(folds: DataFrame, candidates: DataFrame, years: DataFrame) -> DataFrame:
    """Every fold with every candidate and inner year, under an id that follows from them."""
    plan = folds.crossJoin(candidates).crossJoin(years)
    return plan.withColumn("task_id", F.sha2(F.concat_ws("|", *plan.columns), 256))
