"""Tables of evidence: where inputs came from, how a control compares, whether stored estimates follow from their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import quality


def source_units(items: DataFrame, unit: Sequence[str], item: str, platform: str, acquired: str) -> DataFrame:
    """(unit, items, platforms, first, last, sha256): each unit's distinct items, their platforms joined in order, and a fingerprint of the set of items."""
    distinct = items.select(*unit, item, platform, acquired).distinct()
    sums = distinct.groupBy(*unit).agg(F.countDistinct(item).alias("items"), F.array_join(F.array_sort(F.collect_set(platform)), "|").alias("platforms"), F.min(acquired).alias("first"), F.max(acquired).alias("last"))
    prints = quality.group_fingerprints(items.select(*unit, item).distinct(), unit, [item]).drop("n")
    return sums.join(prints, [*unit])


def family_summaries(units: DataFrame, family: str, unit: str, items: str, first: str, last: str) -> DataFrame:
    """(family, units, items, first, last, members): a row a source family; members are its units' ids, sorted and joined. Families have as many units as the area has tiles."""
    return units.groupBy(family).agg(F.count(F.lit(1)).alias("units"), F.sum(items).alias("items"), F.min(first).alias("first"), F.max(last).alias("last"), F.array_join(F.transform(F.array_sort(F.collect_set(unit)), lambda x: x.cast("string")), "|").alias("members"))


def control_comparison(rows: DataFrame, table: str, day: str, feature: str, value: str, final: str, controls: Sequence[str], bounds: tuple[float, float]) -> DataFrame:
    """(feature, <t>_median, ..., nearest, outside, days, days_within): the final table's features against those of its controls.

    nearest: the control whose median is nearest, ties the first; outside: the final rows' share out of bounds; days_within: how many of the final table's
    date medians lie between the least and the greatest date median of all controls. rows: (table, day, feature, value).
    """
    known = rows.where(F.col(value).isNotNull())
    low, high = bounds
    of = lambda t: F.median(F.when(F.col(table) == t, F.col(value)))
    own = F.col(table) == final
    whole = known.groupBy(feature).agg(*[of(t).alias(f"{t}_median") for t in (final, *controls)], (F.count_if(own & ~F.col(value).between(low, high)) / F.count_if(own)).alias("outside"))
    gaps = F.array(*[F.struct(F.abs(F.col(f"{c}_median") - F.col(f"{final}_median")).alias("gap"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(controls)])
    whole = whole.withColumn("nearest", F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull()))["name"])
    dates = known.groupBy(feature, table, day).agg(F.median(value).alias("m"))
    envelope = dates.where(F.col(table).isin(*controls)).groupBy(feature).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    within = dates.where(own).join(envelope, feature, "left").groupBy(feature).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("m").between(F.col("lo"), F.col("hi"))).alias("days_within"))
    return whole.join(within, feature, "left")


def date_estimate(rows: DataFrame, source: str, estimate: str, day: str, value: str, z: float = 1.959963984540054) -> DataFrame:
    """(source, estimate, value, low, high, dates, rows): the mean of date means, with a normal interval over dates."""
    dates = rows.groupBy(day).agg(F.avg(value).alias("m"), F.count(value).alias("n")).where("m is not null")
    out = dates.agg(F.avg("m").alias("value"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("dates"), F.sum("n").alias("rows"))
    return out.select(F.lit(source).alias("source"), F.lit(estimate).alias("estimate"), "value", (F.col("value") - z * F.col("se")).alias("low"), (F.col("value") + z * F.col("se")).alias("high"), "dates", "rows")


def reconciled(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, stored, value, low, high, dates, rows, status): every estimate once. status: equal (within the tolerance, relative to its size), within (its interval),
    outside, missing (not stored) or unsupported (no rows behind it)."""
    j = stored.select(*keys, F.col("value").alias("stored")).join(recomputed, [*keys], "full_outer")
    close = F.abs(F.col("stored") - F.col("value")) <= tolerance * F.greatest(F.lit(1.0), F.abs("value"))
    status = F.when(F.col("value").isNull(), "unsupported").when(F.col("stored").isNull(), "missing").when(close, "equal").when(F.col("stored").between(F.col("low"), F.col("high")), "within").otherwise("outside")
    return j.select(*keys, "stored", "value", "low", "high", "dates", "rows", status.alias("status"))


def reporting_faults(targets: DataFrame, predictions: DataFrame, availability: DataFrame, keys: Sequence[str], reason: str) -> DataFrame:
    """(keys, fault): keys that a table lacks or has twice, and keys whose reason of absence differs between targets and availability."""
    parts = {"target": targets, "prediction": predictions, "availability": availability}
    have = None
    for name, df in parts.items():
        part = df.select(*keys, F.lit(name).alias("part"), F.col(reason).alias("reason") if name != "prediction" else F.lit(None).cast("string").alias("reason"))
        have = part if have is None else have.unionByName(part)
    n = lambda p: F.count_if(F.col("part") == p)
    at = lambda p: F.max(F.when(F.col("part") == p, F.col("reason")))
    sums = have.groupBy(*keys).agg(*[n(p).alias(p) for p in parts], at("target").alias("tr"), at("availability").alias("ar"))
    faults = [F.when(F.col(p) == 0, F.lit(f"no_{p}")) for p in parts] + [F.when(F.col(p) > 1, F.lit(f"twice_{p}")) for p in parts]
    faults.append(F.when((F.col("target") > 0) & (F.col("availability") > 0) & ~F.col("tr").eqNullSafe(F.col("ar")), F.lit("reason")))
    return sums.select(*keys, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("fault"))


def six_digits(v: Column) -> Column:
    """A double to six digits as its exact binary value rounds, halves to even, as C and SQL print it; format_string rounds its shortest decimal form instead.

    v is cut into two halves of its bits, whose products with a million are exact; so is their comparison with a half.
    """
    x = F.abs(v)
    wide = x * 134217729.0
    high = wide - (wide - x)
    whole = F.floor(x * 1e6).cast("double")
    over, rest = high * 1e6 - whole - 0.5, (high - x) * 1e6
    k = F.when(over > rest, whole + 1).when((over == rest) & (F.pmod(whole, F.lit(2.0)) == 1), whole + 1).otherwise(whole).cast("long")
    text = F.concat(F.when(v < 0, "-").otherwise(""), F.floor(k / 1_000_000).cast("string"), F.lit("."), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    return F.when(x < 1e9, text).otherwise(F.format_string("%.6f", v))


def sorted_shares(overlaps: DataFrame, unit: str, label: str, area: str) -> DataFrame:
    """(unit, label, share, shares): the label with the largest overlap, ties the least label, and all labels as `label:share` (six digits) from the largest on."""
    w = Window.partitionBy(unit)
    s = overlaps.groupBy(unit, label).agg(F.sum(area).alias("__a")).withColumn("share", F.col("__a") / F.sum("__a").over(w))
    listed = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("down"), F.col(label).alias("label"))))
    out = s.groupBy(unit).agg(listed.alias("l"))
    return out.select(unit, F.col("l")[0]["label"].alias(label), (-F.col("l")[0]["down"]).alias("share"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["label"].cast("string"), six_digits(-x["down"]))), "|").alias("shares"))


def name_reasons(names: DataFrame, name: str, patterns: dict[str, str]) -> DataFrame:
    """(name, reasons): names that break a pattern, with the reasons in the order of the patterns; empty for a legal registry. Names are compared in lower case."""
    hit = F.filter(F.array(*[F.when(F.lower(name).rlike(p), F.lit(r)) for r, p in patterns.items()]), lambda x: x.isNotNull())
    return names.select(F.col(name), F.array_join(hit, "; ").alias("reasons")).where("reasons <> ''")
