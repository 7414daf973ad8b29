"""Chains that end in published tables: weather features on a key universe, and out-of-fold predictions from their fragments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics, windows, zonal
from tessera.sources import readers


def weather_features(cells: DataFrame, weights: DataFrame, targets: DataFrame, unit: str, cell: str, day: str, variable: str, value: str, variables: Sequence[str], days: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """(unit, day, <v>_mean_<n>d, days_<n>, complete_<n>): trailing means of each variable at every target, from values of cells.

    cells: (cell, day, variable, value), one row each. weights: (unit, cell, weight), built from the same pixels or frozen in an earlier year;
    nothing is renormalised, so a unit's day is null where any of its cells lacks a variable. A window ends the day before its target and is
    null unless all its days are there. Every target has a row; days_<n> is the count of days with all variables.
    """
    wide = readers.widen(cells, [cell, day], variable, value, variables)
    daily = zonal.weighted_mean(wide, weights, cell, unit, day, [*variables])
    whole = F.lit(True)
    for v in variables:
        whole = whole & F.col(v).isNotNull()
    daily = daily.select(unit, day, *variables, F.when(whole, 1).alias("__whole"), F.lit(False).alias("__key"))
    keys = targets.select(unit, day, *[F.lit(None).cast(daily.schema[v].dataType).alias(v) for v in variables], F.lit(None).cast("int").alias("__whole"), F.lit(True).alias("__key"))
    by = Window.partitionBy(unit).orderBy(windows.day_number(day))
    added = {}
    for n in days:
        w = by.rangeBetween(-n, -1)
        added |= {f"{v}_mean_{n}d": F.when(F.count(v).over(w) == n, F.avg(v).over(w)) for v in variables}
        added |= {f"days_{n}": F.count("__whole").over(w), f"complete_{n}": F.count("__whole").over(w) == n}
    return daily.unionByName(keys).withColumns(added).where("__key").drop("__key", "__whole", *variables)


def feature_audit(features: DataFrame, days: Sequence[int] = (1, 3, 7)) -> DataFrame:
    """(window, targets, complete, incomplete, least_days): how many targets have each window whole."""
    n = F.count(F.lit(1))
    wide = features.agg(n.alias("targets"), *[F.count_if(f"complete_{d}").alias(f"c{d}") for d in days], *[F.min(f"days_{d}").alias(f"d{d}") for d in days])
    rows = F.array(*[F.struct(F.lit(d).cast("long").alias("window"), F.col(f"c{d}").alias("complete"), (F.col("targets") - F.col(f"c{d}")).alias("incomplete"), F.col(f"d{d}").alias("least_days")) for d in days])
    return wide.select("targets", F.explode(rows).alias("r")).select("r.window", "targets", "r.complete", "r.incomplete", "r.least_days")


def oof_violations(fragments: DataFrame, expected: DataFrame, keys: Sequence[str], truth: str) -> DataFrame:
    """(family, fold, model, keys, problem): what keeps fragments from being one table of out-of-fold predictions.

    fragments: (family, fold, model, candidate, keys, truth, ...); expected: (family, fold, keys, truth), the test rows of every fold. A
    fragment may lack a row (missing), have one that is not its fold's (surplus) or one twice (doubled), or another truth (truth); a fold and
    model of more than one candidate (candidates) has null keys.

    Folds and models are few and go to all tasks; fragments and expected rows that are dealt out by their keys stay where they are.
    """
    parts = ["family", "fold", "model"]
    due = expected.join(F.broadcast(fragments.select(*parts).distinct()), ["family", "fold"])
    none = F.lit(None).cast(fragments.schema[truth].dataType)
    sides = due.select(*parts, *keys, F.lit(1).alias("__due"), F.lit(0).alias("__is"), F.col(truth).alias("__want"), none.alias("__have")).union(fragments.select(*parts, *keys, F.lit(0), F.lit(1), none, truth))
    least_most = [f(c).alias(f"{n}{c}") for c in ("__want", "__have") for f, n in ((F.min, "__low"), (F.max, "__high"))]
    j = sides.groupBy(*parts, *keys).agg(F.sum("__due").alias("__due"), F.sum("__is").alias("__n"), *least_most)
    equal = F.col("__low__want").eqNullSafe(F.col("__low__have")) & F.col("__high__want").eqNullSafe(F.col("__high__have"))
    problem = F.when(F.col("__n") == 0, "missing").when(F.col("__due") == 0, "surplus").when(F.col("__n") > 1, "doubled").when(~equal, "truth")
    rows = j.withColumn("problem", problem).where("problem is not null").select(*parts, *keys, "problem")
    many = fragments.groupBy(*parts).agg(F.countDistinct("candidate").alias("__n")).where("__n <> 1")
    return rows.unionByName(many.select(*parts, *[F.lit(None).cast(fragments.schema[k].dataType).alias(k) for k in keys], F.lit("candidates").alias("problem")))


def oof_tables(fragments: DataFrame, day: str, truth: str, pred: str) -> dict[str, DataFrame]:
    """The tables that are compiled from fragments without violations: `per_date`, `summary` by family and model, and `folds`."""
    e = F.col(pred) - F.col(truth)
    per_date = metrics.date_metrics(fragments, ["family", "model"], day, truth, pred)
    folds = fragments.groupBy("family", "fold", "model").agg(
        F.min("candidate").alias("candidate"), F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("dates"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")
    )
    return {"per_date": per_date, "summary": metrics.macro_metrics(per_date, ["family", "model"]), "folds": folds}


def summarise_dates(per_date: DataFrame, by: Sequence[str], values: Sequence[str], optional: Sequence[str] = ("rho",)) -> DataFrame:
    """(by, dates, <v>_mean, <v>_median, <o>_median, <o>_defined, <o>_undefined): a summary of date metrics.

    `optional` metrics may be null on a date; the median is over the dates that have one, and both counts are given.
    """
    stats = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.median(v).alias(f"{v}_median"))]
    gaps = [a for o in optional for a in (F.median(o).alias(f"{o}_median"), F.count(o).alias(f"{o}_defined"), (F.count(F.lit(1)) - F.count(o)).alias(f"{o}_undefined"))]
    return per_date.groupBy(*by).agg(F.count(F.lit(1)).alias("dates"), *stats, *gaps)


def sensor_tables(rows: DataFrame, sensor: str, day: str, truth: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """(per date and sensor: n, mae, bias, share of the date's rows; per sensor: dates, rows, their means, and the dates that it has alone)."""
    e = F.col(pred) - F.col(truth)
    per = rows.groupBy(day, sensor).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))
    # a date has as many rows here as it has sensors
    per = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(day)))
    summary = per.groupBy(sensor).agg(F.count(F.lit(1)).alias("dates"), F.sum("n").alias("rows"), F.avg("mae").alias("mae"), F.avg("bias").alias("bias"), F.count_if(F.col("share") == 1).alias("dates_alone"))
    return per, summary


def one_model_metrics(rows: DataFrame, day: str, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, dates, mae, macro_rmse, bias, median_rho, rho_dates, rho_undefined): one model's metrics, dates alike."""
    macro = metrics.macro_metrics(metrics.date_metrics(rows, [*by], day, truth, pred), [*by])
    return macro.select(*by, "rows", "dates", "mae", "macro_rmse", "bias", "median_rho", "rho_dates", (F.col("dates") - F.col("rho_dates")).alias("rho_undefined"))
