"""Contracts of whole tables: each gives its violations as rows (rule, at, n), so a caller can fail closed on any (quality.require_empty).

`at` names the key, group or column in question, parts joined by `|`, a null as `null`; `n` counts rows, or is 1. An empty result is a kept contract.
Every rule of a contract runs, so one call shows all that is wrong. Columns are compared before anything reads them; with a column missing,
only that is told.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import finite, is_canonical
from tessera.operators import quality



def named(rows: DataFrame, rule: str, keys: Sequence[str], n: Column | None = None) -> DataFrame:
    at = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]) if keys else F.lit("")
    return rows.select(F.lit(rule).alias("rule"), at.alias("at"), (n if n is not None else F.lit(1)).cast("long").alias("n"))


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def column_faults(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame | None:
    """Columns that are missing, and with `exact` those that should not be there; None if all is well."""
    faults = [("missing_column", c) for c in columns if c not in df.columns] + ([("surplus_column", c) for c in df.columns if c not in columns] if exact else [])
    return df.sparkSession.createDataFrame([(r, c, 1) for r, c in faults], "rule string, at string, n long") if faults else None


def civil_midnight(day: str) -> Column:
    """There, and at midnight. A date is."""
    return F.coalesce(F.col(day).cast("timestamp") == F.date_trunc("day", F.col(day).cast("timestamp")), F.lit(False))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    d = quality.duplicate_keys(df, keys)
    return named(d, "duplicate_key", keys, F.col("n"))


def by_rule(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    broken = quality.broken_rules(df, keys, rules)
    at = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return broken.select("rule", at.alias("at"), F.lit(1).cast("long").alias("n"))


def count_faults(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """Named aggregates that are not what is expected: (count:<name>, found, found)."""
    one = df.agg(*[c.alias(k) for k, (c, _) in expected.items()])
    bad = F.filter(F.array(*[F.when(F.col(k) != want, F.struct(F.lit(f"count:{k}").alias("rule"), F.col(k).cast("string").alias("at"), F.col(k).cast("long").alias("n"))) for k, (_, want) in expected.items()]), lambda x: x.isNotNull())
    return one.select(F.explode(bad).alias("x")).select("x.*")


def prediction_faults(df: DataFrame, unit: str, block: str, day: str, truth: str, pred: str, first_locked_year: int | None) -> DataFrame:
    """H23. Unit and block in canonical text, days at midnight, one row a unit and day, no locked year, one block a unit, finite numbers, not empty."""
    if (bad := column_faults(df, [unit, block, day, truth, pred])) is not None:
        return bad
    number = lambda c: finite(F.col(c).cast("double")) if df.schema[c].dataType.typeName() not in ("boolean", "string") else F.lit(False)
    rules = {"unit_text": is_canonical(F.col(unit)), "block_text": is_canonical(F.col(block)), "day": civil_midnight(day), "truth_not_finite": number(truth), "pred_not_finite": number(pred)}
    if first_locked_year is not None:
        rules["locked"] = F.coalesce(F.year(day) < first_locked_year, F.lit(True))
    empty = df.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return all_of([by_rule(df, [unit, day], rules), duplicates(df, [unit, day]), named(quality.varying(df, unit, [block]), "several_blocks", [unit], F.col("variants")), named(empty, "empty", [])])


def canonical_predictions(df: DataFrame, unit: str, block: str, day: str, truth: str, pred: str, first_locked_year: int | None) -> DataFrame:
    """The prediction columns alone, typed; raises ContractError where prediction_faults finds any. No row is dropped."""
    quality.require_empty(prediction_faults(df, unit, block, day, truth, pred, first_locked_year), "predictions")
    return df.select(unit, block, F.to_date(day).alias(day), F.col(truth).cast("double").alias(truth), F.col(pred).cast("double").alias(pred))


def row_group_faults(df: DataFrame, unit: str, day: str, block: str, years: Sequence[int]) -> DataFrame:
    """H30. The three key columns and no others, days at midnight, one row a unit and day, and exactly the declared years."""
    if (bad := column_faults(df, [unit, day, block], exact=True)) is not None:
        return bad
    found = df.select(F.year(day).alias("yr")).distinct()
    declared = df.sparkSession.createDataFrame([(y,) for y in years], "yr int")
    return all_of([by_rule(df, [unit, day], {"day": civil_midnight(day), "unit_text": is_canonical(F.col(unit)), "block_text": is_canonical(F.col(block))}), duplicates(df, [unit, day]), named(found.join(declared, "yr", "left_anti"), "surplus_year", ["yr"]), named(declared.join(found, "yr", "left_anti"), "missing_year", ["yr"])])


def training_key_faults(df: DataFrame, unit: str, day: str, first_locked_year: int) -> DataFrame:
    """H31. Canonical units, days at midnight, unique, none of a locked year."""
    if (bad := column_faults(df, [unit, day])) is not None:
        return bad
    return all_of([by_rule(df, [unit, day], {"unit_text": is_canonical(F.col(unit)), "day": civil_midnight(day), "locked": F.coalesce(F.year(day) < first_locked_year, F.lit(True))}), duplicates(df, [unit, day])])


def oof_faults(df: DataFrame, identity: Sequence[str], block: str, day: str, truth: str, pred: str, families: Sequence[str], models: Sequence[str], expected: dict[str, int], first_locked_year: int) -> DataFrame:
    """H19. Columns, no nulls, no locked year, finite numbers, unique identity (family, model, unit, day), every family and model with all rows, one block a
    key, and the expected numbers of rows, dates and blocks of distinct keys."""
    columns = [*identity, block, truth, pred]
    if (bad := column_faults(df, columns, exact=True)) is not None:
        return bad
    family, model, unit, _ = identity
    rules = {**{f"null:{c}": F.col(c).isNotNull() for c in columns}, "locked": F.coalesce(F.year(day) < first_locked_year, F.lit(True)), "truth_not_finite": F.col(truth).isNull() | finite(F.col(truth)), "pred_not_finite": F.col(pred).isNull() | finite(F.col(pred))}
    due = df.sparkSession.createDataFrame([(f, m) for f in families for m in models], f"`{family}` string, `{model}` string")
    sizes = df.groupBy(family, model).agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(unit, day, block).distinct()
    pair = [family, model]
    return all_of([
        by_rule(df, identity, rules), duplicates(df, identity), named(due.join(sizes, pair, "left_anti"), "missing_pair", pair), named(sizes.join(due, pair, "left_anti"), "surplus_pair", pair),
        named(sizes.where(F.col("n") != expected["rows"]), "pair_rows", pair, F.col("n")), named(quality.duplicate_keys(keys, [unit, day]), "several_blocks", [unit, day], F.col("n")),
        count_faults(keys, {"rows": (F.count(F.lit(1)), expected["rows"]), "dates": (F.countDistinct(day), expected["dates"]), "blocks": (F.countDistinct(block), expected["blocks"])}),
    ])


def readiness_faults(features: DataFrame, universe: DataFrame, keys: Sequence[str], families: dict[str, Sequence[str]], complete: Sequence[str]) -> DataFrame:
    """H12. Exactly the universe's keys, once each; exactly the registered columns, all numeric; in each family's row all or none; in complete families
    none missing; no number that is not finite; and no column without any value."""
    columns = [c for cs in families.values() for c in cs]
    if (bad := column_faults(features, [*keys, *columns], exact=True)) is not None:
        return bad
    types = [("not_numeric", c) for c in columns if features.schema[c].dataType.typeName() in ("string", "boolean", "date", "timestamp", "binary")]
    if types:
        return features.sparkSession.createDataFrame([(r, c, 1) for r, c in types], "rule string, at string, n long")
    difference = [named(universe.join(features, [*keys], "left_anti").select(*keys).distinct(), "missing_key", keys), named(features.join(universe, [*keys], "left_anti").select(*keys).distinct(), "surplus_key", keys)]
    rules: dict[str, Column] = {}
    for family, cs in families.items():
        missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cs])
        rules[f"partly_missing:{family}"] = missing.isin(0, len(cs)) if family not in complete else F.lit(True)
        if family in complete:
            rules[f"incomplete:{family}"] = missing == 0
    rules |= {f"not_finite:{c}": F.col(c).isNull() | finite(F.col(c).cast("double")) for c in columns}
    filled = features.agg(*[F.count(c).alias(c) for c in columns])
    void = filled.select(F.explode(F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in columns]), lambda x: x.isNotNull())).alias("c"))
    return all_of([*difference, duplicates(features, keys), by_rule(features, keys, rules), named(void, "no_value", ["c"])])


def acquisition_faults(table: DataFrame, inventory: DataFrame, units: DataFrame, unit: str, acquisition: str, identity: Sequence[str], items: str, denominator: str) -> DataFrame:
    """H14. Every unit with every acquisition, once; each acquisition's identity columns and its list of items, ordered and joined by `|`, as the inventory's;
    one denominator a unit.

    inventory: (acquisition, identity, item), one row an item.
    """
    grid = units.select(unit).distinct().crossJoin(inventory.select(acquisition).distinct())
    pair = [unit, acquisition]
    due = inventory.groupBy(acquisition).agg(F.array_join(F.array_sort(F.collect_set("item")), "|").alias("__items"), *[F.first(c).alias(f"__{c}") for c in identity])
    j = table.select(*pair, items, *identity).join(due, acquisition)
    rules = {"items": F.col(items).eqNullSafe(F.col("__items")), **{f"identity:{c}": F.col(c).eqNullSafe(F.col(f"__{c}")) for c in identity}}
    return all_of([named(grid.join(table, pair, "left_anti"), "missing_cell", pair), named(table.join(grid, pair, "left_anti").select(*pair).distinct(), "surplus_cell", pair), duplicates(table, pair), by_rule(j, pair, rules), named(quality.varying(table, unit, [denominator]), "denominator", [unit], F.col("variants"))])


def lineage_faults(lineage: DataFrame, membership: DataFrame, units: DataFrame, features: DataFrame, unit: str, day: str, acquisition: str, value: str, feature: str, counted: str, least: int, tolerance: float = 1e-9) -> DataFrame:
    """H15. Lineage rows are what membership says (day, acquisition), with all units on each; features are the medians over a unit's and day's acquisitions, null
    with fewer than `least` values, and their counts are right.

    lineage: (unit, day, acquisition, value); features: (unit, day, feature, counted).
    """
    link = [day, acquisition]
    held = lineage.select(*link).distinct()
    n = units.select(unit).distinct().agg(F.count(F.lit(1)).alias("__n"))
    sets = lineage.groupBy(*link).agg(F.countDistinct(unit).alias("have")).crossJoin(F.broadcast(n)).where("have <> __n")  # one row
    again = lineage.groupBy(unit, day).agg(F.count(value).alias("__n"), F.median(value).alias("__m"))
    j = features.select(unit, day, feature, counted).join(again, [unit, day], "full_outer")
    want = F.when(F.coalesce("__n", F.lit(0)) >= least, F.col("__m"))
    same = F.coalesce(F.abs(F.col(feature) - want) <= tolerance, F.col(feature).isNull() & want.isNull())
    rules = {"feature": same, "count": F.coalesce(counted, F.lit(0)) == F.coalesce("__n", F.lit(0))}
    return all_of([named(membership.join(held, link, "left_anti").select(*link).distinct(), "missing_membership", link), named(held.join(membership, link, "left_anti"), "surplus_membership", link), named(sets, "unit_set", link, F.col("have")), duplicates(lineage, [unit, *link]), by_rule(j, [unit, day], rules)])


def target_faults(targets: DataFrame, summary: DataFrame, unit: str, day: str, least_share: float, tolerance: float = 1e-12) -> DataFrame:
    """H17. targets: (unit, day, eligible, valid, share, flag, reason, target). Share, flag, reason and the presence of a target follow from the counts; summary: (day,
    units, passed, mean) is recomputed from the targets."""
    share = F.when(F.col("eligible") > 0, F.col("valid") / F.col("eligible"))
    flag = F.coalesce(share >= least_share, F.lit(False))
    reason = F.when(F.col("eligible") == 0, "no_eligible").when(F.col("valid") == 0, "no_valid").when(~flag, "low_share").otherwise("ok")
    near = lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    rules = {"counts": (F.col("valid") <= F.col("eligible")) & (F.col("valid") >= 0), "share": near(F.col("share"), share), "flag": F.col("flag").eqNullSafe(flag), "reason": F.col("reason").eqNullSafe(reason), "target": F.col("target").isNotNull() == flag}
    again = targets.groupBy(day).agg(F.count(F.lit(1)).alias("units"), F.count_if("flag").alias("passed"), F.avg("target").alias("mean"))
    differ = quality.mismatched_values(summary, again, [day], ["units", "passed", "mean"], 1e-9)
    return all_of([by_rule(targets, [unit, day], rules), duplicates(targets, [unit, day]), named(differ, "summary", [day, "column"])])


def label_faults(rows: DataFrame, gates: DataFrame, unit: str, day: str, value: str, label: str, share: float) -> DataFrame:
    """H22. Labels on gated days alone and on all of their rows, and exactly the top ceil(share x rows) of the day, ties to the smaller unit.

    gates: (day, gated).
    """
    w = Window.partitionBy(day)
    j = rows.join(gates.select(day, "gated"), day, "left").withColumn("gated", F.coalesce("gated", F.lit(False)))
    place = F.row_number().over(w.orderBy(F.desc_nulls_last(value), unit))
    top = place <= F.ceil(F.lit(share) * F.count(F.lit(1)).over(w))
    j = j.withColumn("__top", top)
    rules = {"label_without_gate": F.col("gated") | F.col(label).isNull(), "label_missing": ~F.col("gated") | F.col(label).isNotNull(), "not_top": ~F.col("gated") | F.col(label).isNull() | (F.col(label) == F.col("__top"))}
    return by_rule(j, [unit, day], rules)


def checkpoint_faults(rows: DataFrame, summary: DataFrame, contributions: DataFrame, unit: str, day: str, tolerance: float = 1e-9) -> DataFrame:
    """D43. rows: (unit, day, cells, valid); summary: (day, units, valid); contributions: (unit, day, scene, valid).

    Keys twice, a unit's denominators (cells) that vary over days, days whose stored roll-up is not that of the rows, and rows that are not the sum of their scenes.
    """
    rolled = rows.groupBy(day).agg(F.count(F.lit(1)).alias("units"), F.sum("valid").alias("valid"))
    summed = contributions.groupBy(unit, day).agg(F.sum("valid").alias("valid"))
    roll = quality.mismatched_values(summary, rolled, [day], ["units", "valid"], tolerance)
    parts = quality.mismatched_values(rows.select(unit, day, "valid"), summed, [unit, day], ["valid"], tolerance)
    return all_of([duplicates(rows, [unit, day]), named(quality.varying(rows, unit, ["cells"]), "denominator", [unit], F.col("variants")), named(roll, "roll_up", [day, "column"]), named(parts, "contributions", [unit, day])])
