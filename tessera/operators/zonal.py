"""Zonal and composite aggregates with fixed denominators: a missing source makes a value null, and no weight is ever renormalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_target(pixels: DataFrame, units: DataFrame, by: list[str], unit: str, value: str, valid: str, eligible: str, least_share: float, least_pixels: int) -> DataFrame:
    """Per (by, unit): counts, median, mean, sample deviation, p10 and p90 of the valid pixels, their share of the eligible ones, and a gate.

    Every unit of the dimension has a row for every group. The value columns are null, and `reason` says why, where the gate fails.
    """
    v = F.when(F.col(valid), F.col(value))
    found = pixels.groupBy(*by, unit).agg(
        F.count(F.lit(1)).alias("raster"), F.count_if(eligible).alias("eligible"), F.count_if(F.col(valid)).alias("valid"),
        F.median(v).alias("median"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.1)).alias("p10"), F.percentile(v, F.lit(0.9)).alias("p90"),
    )
    grid = pixels.select(*by).distinct().join(units.select(unit)) if by else units.select(unit)
    rows = grid.join(found, [*by, unit], "left").fillna(0, ["raster", "eligible", "valid"])
    share = F.when(F.col("eligible") > 0, F.col("valid") / F.col("eligible"))
    reason = F.when(F.col("raster") == 0, "no_footprint").when(F.col("eligible") == 0, "no_eligible").when(F.col("valid") < least_pixels, "few_pixels").when(share < least_share, "low_share")
    rows = rows.withColumns({"share": share, "reason": reason})
    gate = F.col("reason").isNull()
    return rows.withColumns({c: F.when(gate, F.col(c)) for c in ("median", "mean", "std", "p10", "p90")}).withColumn("available", gate)


def static_zonal(cells: DataFrame, unit: str, land_class: str, groups: dict[str, list[int]], values: list[str], threshold: float) -> DataFrame:
    """Per unit: cell count, share of each class group, and for each layer mean, p10, p90, population deviation, coverage and share at or above a threshold."""
    n = F.count(F.lit(1))
    shares = [(F.count_if(F.col(land_class).isin(*c)) / n).alias(f"share_{g}") for g, c in groups.items()]
    stats = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.percentile(v, F.lit(0.1)).alias(f"{v}_p10"), F.percentile(v, F.lit(0.9)).alias(f"{v}_p90"), F.stddev_pop(v).alias(f"{v}_std"), (F.count(v) / n).alias(f"{v}_coverage"), (F.count_if(F.col(v) >= threshold) / n).alias(f"{v}_high"))]
    return cells.groupBy(unit).agg(n.alias("cells"), *shares, *stats)


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, name: str = "median") -> DataFrame:
    """(by, name): the first value in order whose running weight reaches half of the total. Rows without value or weight don't count."""
    w = Window.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    run = rows.withColumns({"__c": F.sum(weight).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__t": F.sum(weight).over(w)})
    return run.groupBy(*by).agg(F.min(F.when(F.col("__c") >= F.col("__t") / 2, F.col(value))).alias(name))


def coarse_cells(df: DataFrame, x: Column, y: Column, size: float, value: str, valid: Column, by: list[str] | None = None) -> DataFrame:
    """Average of valid values and share of valid cells on a coarser, aligned grid."""
    return df.groupBy(*(by or []), F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy")).agg(F.avg(F.when(valid, F.col(value))).alias("mean"), F.avg(valid.cast("double")).alias("valid_share"))


def trailing_composite(acquisitions: DataFrame, membership: DataFrame, keys: DataFrame, day: str, unit: str, acquisition: str, coverage: str, values: list[str], least_coverage: float, least: int) -> DataFrame:
    """Per key the median of each value over the acquisitions of its window with enough coverage and no missing value; null below `least` of them.

    membership: (day, acquisition, lag). Every key has a row.
    """
    joined = membership.join(acquisitions, acquisition)
    full = F.col(coverage) >= least_coverage
    for v in values:
        full = full & F.col(v).isNotNull()
    found = joined.groupBy(day, unit).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(full).alias("qualifying"), F.min(F.when(full, F.col("lag"))).alias("least_lag"), F.max(F.when(full, F.col("lag"))).alias("most_lag"), F.median(F.when(full, F.col(coverage))).alias("median_coverage"), *[F.median(F.when(full, F.col(v))).alias(v) for v in values])
    rows = keys.select(day, unit).join(found, [day, unit], "left").fillna(0, ["candidates", "qualifying"])
    return rows.withColumns({v: F.when(F.col("qualifying") >= least, F.col(v)) for v in values})


def cell_weights(pixels: DataFrame, unit: str, cell: str, area: float) -> DataFrame:
    """(unit, cell, pixels, area, denominator, weight): each unit's weights sum to 1 over its cells."""
    counted = pixels.groupBy(unit, cell).agg(F.count(F.lit(1)).alias("pixels")).withColumn("area", F.col("pixels") * area)
    total = F.sum("area").over(Window.partitionBy(unit))
    return counted.withColumns({"denominator": total, "weight": F.col("area") / total})


def weight_violations(weights: DataFrame, unit: str, cell: str, tolerance: float = 1e-12) -> DataFrame:
    """(unit, problem): doubled cells, weights not positive, more than one denominator, sums other than 1."""
    found = weights.groupBy(unit).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cell).alias("cells"), F.min("weight").alias("least"), F.countDistinct("denominator").alias("denominators"), F.sum("weight").alias("total"))
    problem = F.when(F.col("n") != F.col("cells"), "duplicate").when(F.col("least") <= 0, "not_positive").when(F.col("denominators") != 1, "denominator").when(F.abs(F.col("total") - 1) > tolerance, "sum")
    return found.withColumn("problem", problem).where("problem is not null").select(unit, "problem")


def weighted_mean(daily: DataFrame, weights: DataFrame, cell: str, unit: str, day: str, values: list[str]) -> DataFrame:
    """Per (unit, day): sum of weight x value, null unless every cell of the unit has a value that day."""
    days = daily.select(day).distinct()
    rows = weights.select(unit, cell, "weight").join(days).join(daily, [cell, day], "left")
    return rows.groupBy(unit, day).agg(F.count(F.lit(1)).alias("expected"), *[F.when(F.count(v) == F.count(F.lit(1)), F.sum(F.col(v) * F.col("weight"))).alias(v) for v in values], *[F.count(v).alias(f"{v}_present") for v in values])


def coverage_report(df: DataFrame, by: str, available: Column, count: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(n.alias("n"), F.count_if(available).alias("available"), (n - F.count_if(available)).alias("missing"), (F.count_if(available) / n).alias("share"), F.min(count).alias("least"), F.median(count).alias("median"), F.max(count).alias("most"))


def largest_share(areas: DataFrame, unit: str, label: str, area: str, least: float = 0.0) -> DataFrame:
    """The label with the largest area of each unit, ties by label, and its share; units whose best share is below `least` have none."""
    w = Window.partitionBy(unit)
    ranked = areas.withColumns({"share": F.col(area) / F.sum(area).over(w), "__r": F.row_number().over(w.orderBy(F.desc(area), label))})
    return ranked.where((F.col("__r") == 1) & (F.col("share") >= least)).drop("__r")


def threshold_sweep(pixels: DataFrame, by: list[str], uncertainty: str, distance: str, uncertainties: list[float | None], distances: list[float]) -> DataFrame:
    """Counts and shares kept under every pair of thresholds, in one pass over the pixels; no uncertainty threshold is null."""
    pairs = [(u, d) for u in uncertainties for d in distances]
    keep = lambda u, d: (F.col(distance) >= d) & ((F.col(uncertainty) <= u) if u is not None else F.lit(True))
    wide = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(keep(u, d)).alias(f"__{i}") for i, (u, d) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(u).cast("double").alias("uncertainty_k"), F.lit(float(d)).alias("distance_km"), F.col(f"__{i}").alias("kept")) for i, (u, d) in enumerate(pairs)])
    return wide.select(*by, "n", F.explode(rows).alias("t")).select(*by, "n", "t.*", (F.col("t.kept") / F.col("n")).alias("share"))


def relative_gate(df: DataFrame, day: str, target: str, block: str, lat: str, lon: str, least_share: float, gap: float) -> DataFrame:
    """(day, n, kept, share, block_gap, lat_gap, lon_gap, passes): retention by date and its spread over blocks and quartiles, by grouping sets."""
    sets = df.groupingSets([[day], [day, block], [day, lat], [day, lon]], day, block, lat, lon).agg(F.count(F.lit(1)).alias("n"), F.count(target).alias("kept"), F.grouping_id().alias("g"))
    share = F.col("kept") / F.col("n")
    spread = lambda g: F.max(F.when(F.col("g") == g, share)) - F.min(F.when(F.col("g") == g, share))
    out = sets.groupBy(day).agg(F.max(F.when(F.col("g") == 7, F.col("n"))).alias("n"), F.max(F.when(F.col("g") == 7, F.col("kept"))).alias("kept"), spread(3).alias("block_gap"), spread(5).alias("lat_gap"), spread(6).alias("lon_gap"))
    share = F.col("kept") / F.col("n")
    return out.withColumns({"share": share, "passes": (share >= least_share) & (F.greatest("block_gap", "lat_gap", "lon_gap") <= gap)})
