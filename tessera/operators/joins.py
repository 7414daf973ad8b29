"""Panel joins with stated cardinality: key universes, lag windows, registered assembly, paired models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_universe(dates: DataFrame, units: DataFrame) -> DataFrame:
    """Every date with every unit. Both sides are dimensions; the product is the panel's own size."""
    return dates.crossJoin(units)


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): keys that only one table has; empty means exact coverage."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, [*keys], "left_anti").withColumn("side", F.lit("left")).union(b.join(a, [*keys], "left_anti").withColumn("side", F.lit("right")))


def assemble(rows: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join each predictor table on its keys; row counts never change, absent keys show as `missing_<i>`, null values stay legal.

    Every table must be unique in its keys (see quality.duplicate_keys) and may not bring a column that is there already.
    """
    for i, (table, keys) in enumerate(tables):
        clash = (set(table.columns) - set(keys)) & set(rows.columns)
        if clash:
            raise ValueError(f"columns are there already: {sorted(clash)}")
        rows = rows.join(table.withColumn(f"__here_{i}", F.lit(True)), [*keys], "left").withColumn(f"missing_{i}", F.col(f"__here_{i}").isNull()).drop(f"__here_{i}")
    return rows


def lag_membership(targets: DataFrame, acquisitions: DataFrame, target: str, acquired: str, low: int, high: int) -> DataFrame:
    """(target, acquired, other columns, lag): acquisitions between low and high days before each target.

    A range join as an equi-join: both sides are cut into bins as wide as the window, and a target looks into the bins its window touches,
    so the work is that of the matches and not of the product.
    """
    width = high - low + 1
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    t = targets.withColumn("__bin", F.explode(F.sequence(F.floor((number(target) - high) / width), F.floor((number(target) - low) / width))))
    a = acquisitions.withColumn("__bin", F.floor(number(acquired) / width))
    lag = F.datediff(F.col(target), F.col(acquired))
    return t.join(a, "__bin").where(lag.between(low, high)).withColumn("lag", lag).drop("__bin")


def lag_requirements(keys: DataFrame, day: str, low: int, high: int) -> DataFrame:
    """(source_day): the distinct days that the windows of all keys need."""
    return keys.select(day).distinct().select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag"), day).select(F.date_sub(F.col(day), F.col("lag")).alias("source_day")).distinct()


def membership_violations(membership: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one of the stored and the recomputed membership has, with their side."""
    a, b = membership.select(*columns), expected.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).union(b.exceptAll(a).withColumn("side", F.lit("expected")))


def paired_models(predictions: DataFrame, keys: Sequence[str], model: str, truth: str, pred: str, baseline: str, target: str) -> DataFrame:
    """One row a key with both models' predictions, by one aggregate rather than a self-join; `unpaired` and `unequal_truth` flag what may not be."""
    at = lambda name, c: F.max(F.when(F.col(model) == name, F.col(c)))
    rows = predictions.where(F.col(model).isin(baseline, target)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), at(baseline, truth).alias("truth"), at(target, truth).alias("__t"), at(baseline, pred).alias("baseline_pred"), at(target, pred).alias("target_pred"))
    return rows.withColumns({"unpaired": F.col("__n") != 2, "unequal_truth": ~F.col("truth").eqNullSafe(F.col("__t"))}).drop("__n", "__t")


def fixed_support(primary: DataFrame, strict: DataFrame, keys: Sequence[str], invariant: Sequence[str], count: str, available: str) -> DataFrame:
    """One row of violation counts of a stricter run: keys only one has, invariants that moved, counts that rose, availability that appeared."""
    pick = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in (*invariant, count, available)], F.lit(True).alias(f"{tag}_here"))
    j = pick(primary, "p").join(pick(strict, "s"), [*keys], "full_outer")
    both = F.col("p_here").isNotNull() & F.col("s_here").isNotNull()
    moved = F.lit(False)
    for c in invariant:
        moved = moved | ~F.col(f"p_{c}").eqNullSafe(F.col(f"s_{c}"))
    return j.agg(F.count_if(~both).alias("unmatched_keys"), F.count_if(both & moved).alias("moved"), F.count_if(both & (F.col(f"s_{count}") > F.col(f"p_{count}"))).alias("risen"), F.count_if(both & F.col(f"s_{available}") & ~F.col(f"p_{available}")).alias("appeared"))


def shared_groups(train: DataFrame, test: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Groups on both sides of a split; empty if they are disjoint."""
    return train.select(*groups).distinct().join(test.select(*groups).distinct(), [*groups], "left_semi")


def contribution_violations(targets: DataFrame, contributions: DataFrame, keys: Sequence[str], expected: str, part: str) -> DataFrame:
    """(keys, expected, found): targets whose contributions do not add up; a target without any has 0."""
    sums = contributions.groupBy(*keys).agg(F.sum(part).alias("found"))
    return targets.select(*keys, expected).join(sums, [*keys], "left").withColumn("found", F.coalesce("found", F.lit(0))).where(~F.col(expected).eqNullSafe(F.col("found")))


def reporting_rows(targets: DataFrame, predictions: DataFrame, dates: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Targets and predictions by full outer join with presence flags, and the date's summary on the left."""
    t, p = targets.withColumn("has_target", F.lit(True)), predictions.withColumn("has_prediction", F.lit(True))
    j = t.join(p, [*keys], "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_target", "has_prediction")})
    return j.join(dates, day, "left")


def flag(df: DataFrame, name: str, test: Column) -> DataFrame:
    return df.withColumn(name, F.coalesce(test, F.lit(False)))
