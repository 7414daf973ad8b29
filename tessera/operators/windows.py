"""Windows and rankings: complete trailing windows, calendars, ties, top-k, best versions, interval merges. Every ranking ends in an id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def day_number(day: str | Column) -> Column:
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit(EPOCH))


def trailing(df: DataFrame, unit: str, day: str, means: list[str], sums: list[str], days: tuple[int, ...] = (1, 3, 7)) -> DataFrame:
    """Adds `<v>_mean_<n>d` and `<v>_sum_<n>d` over the n days that end the day before; null unless all n are there and not null.

    One shuffle by unit serves all windows.
    """
    by = Window.partitionBy(unit).orderBy(day_number(day))
    added = {}
    for n in days:
        w = by.rangeBetween(-n, -1)
        added |= {f"{v}_mean_{n}d": F.when(F.count(v).over(w) == n, F.avg(v).over(w)) for v in means}
        added |= {f"{v}_sum_{n}d": F.when(F.count(v).over(w) == n, F.sum(v).over(w)) for v in sums}
    return df.withColumns(added)


def trailing_at(daily: DataFrame, targets: DataFrame, unit: str, day: str, value: str, n: int) -> DataFrame:
    """The trailing mean at given (unit, day) keys, with the window's first and last day, the days present, and whether it is complete.

    Keys need no daily row of their own: they join the series as rows without a value, so one window serves both.
    """
    series = daily.select(unit, day, value, F.lit(False).alias("__key")).unionByName(targets.select(unit, day, F.lit(None).cast("double").alias(value), F.lit(True).alias("__key")))
    w = Window.partitionBy(unit).orderBy(day_number(day)).rangeBetween(-n, -1)
    present = F.count(value).over(w)
    found = series.withColumns({"days_present": present, "mean": F.when(present == n, F.avg(value).over(w))}).where("__key")
    return found.select(unit, day, F.date_sub(day, n).alias("first_day"), F.date_sub(day, 1).alias("last_day"), "days_present", (F.col("days_present") == n).alias("complete"), "mean")


def dense_calendar(daily: DataFrame, unit: str, day: str, whole_years: bool = False) -> DataFrame:
    """One row for every day between a unit's first and last (of their years with `whole_years`), missing ones with nulls and `observed` false.

    `leap_gap` marks a missing 31 December of a leap year: sources with 365 days a year leave it out.
    """
    span = daily.groupBy(unit).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    if whole_years:
        span = span.select(unit, F.make_date(F.year("a"), F.lit(1), F.lit(1)).alias("a"), F.make_date(F.year("b"), F.lit(12), F.lit(31)).alias("b"))
    grid = span.select(unit, F.explode(F.sequence("a", "b")).alias(day))
    dense = grid.join(daily.withColumn("observed", F.lit(True)), [unit, day], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    return dense.withColumn("leap_gap", ~F.col("observed") & (F.dayofyear(day) == 366))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean: rank + (ties - 1) / 2."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Aggregate: correlation, null where a side is constant (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho): rank correlation; null with fewer than two rows or a constant side. Rows with a null on either side don't count."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rho"))


def top_share(df: DataFrame, by: list[str], score: str, unit: str, share: float, name: str = "hot") -> DataFrame:
    """Exactly ceil(share x n) rows of each group flagged, the highest scores first, ties by unit."""
    w = Window.partitionBy(*by)
    return df.withColumn(name, F.row_number().over(w.orderBy(F.desc(score), unit)) <= F.ceil(F.lit(share) * F.count(F.lit(1)).over(w)))


def quartile(value: str, unit: str, by: list[str]) -> Column:
    """min(3, 4 (r - 1) div n) by (value, unit): sizes as even as they can be, the larger groups spread (unlike ntile)."""
    w = Window.partitionBy(*by)
    return F.least(F.lit(3), F.floor((F.row_number().over(w.orderBy(value, unit)) - 1) * 4 / F.count(F.lit(1)).over(w)))


def average_precision(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """(by, positives, ap): sum of recall steps times precision, equal scores as one threshold; null without a positive."""
    steps = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select(*by, "tp", F.sum("tp").over(down).alias("ct"), F.sum("n").over(down).alias("cn"), F.sum("tp").over(w).alias("p"))
    part = F.col("tp").cast("double") / F.col("p") * (F.col("ct").cast("double") / F.col("cn"))
    return run.groupBy(*by).agg(F.max("p").alias("positives"), F.sum(F.when(F.col("p") > 0, part)).alias("ap"))


def best_row(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def mosaic(pixels: DataFrame, cell: list[str], value: str = "value", valid: str = "valid", uncertainty: str = "uncertainty", distance: str = "distance", scene: str = "scene") -> DataFrame:
    """The best scene of every cell: valid first, then low uncertainty, large distance, small scene id, nulls worst; the value is null unless it is valid."""
    best = best_row(pixels, cell, [F.desc(valid), F.asc_nulls_last(uncertainty), F.desc_nulls_last(distance), F.asc(scene)])
    return best.withColumn(value, F.when(F.col(valid), F.col(value)))


def tile_owner(pixels: DataFrame, cell: list[str], clear: str, complete: str, tile: str, item: str) -> DataFrame:
    """One owner of each cell: clear and complete before complete before the rest, ties by tile and item."""
    tier = F.when(F.col(clear) & F.col(complete), 1).when(F.col(complete), 2).otherwise(3)
    return best_row(pixels.withColumn("tier", tier), cell, [F.asc("tier"), F.asc(tile), F.asc(item)])


def cohort(items: DataFrame, acquisition: list[str], baseline: list[str], tile: str, generation: str, item: str, coverage: str) -> DataFrame:
    """Of each acquisition the processing baseline with the most coverage, then the highest number, the latest generation, the least ids; one item a tile."""
    latest = best_row(items, [*acquisition, *baseline, tile], [F.desc(generation), F.asc(item)])
    sets = latest.groupBy(*acquisition, *baseline).agg(F.sum(coverage).alias("coverage"), F.max(generation).alias("generation"), F.array_sort(F.collect_list(item)).alias("items"))
    return best_row(sets, acquisition, [F.desc("coverage"), *[F.desc(b) for b in baseline], F.desc("generation"), F.asc("items")])


def union_cohort(items: DataFrame, acquisition: list[str], baseline: list[str], tile: str, generation: str, item: str, footprints: Callable[[DataFrame], DataFrame], area: DataFrame, size: float) -> DataFrame:
    """As cohort(), by the share of the area that a baseline's footprints cover together, overlaps counted once.

    footprints: turns items into pieces (acquisition, baseline, x1, y1, x2, y2, w); area: the pieces of one polygon, met in strips of a grid of `size`.
    """
    from tessera.operators import polygons

    by = [*acquisition, *baseline]
    latest = best_row(items, [*by, tile], [F.desc(generation), F.asc(item)])
    sets = latest.groupBy(*by).agg(F.max(generation).alias("generation"), F.array_sort(F.collect_list(item)).alias("items"))
    clip = sets.select(*by).crossJoin(F.broadcast(area))  # one polygon's edges
    whole = polygons.union_areas(area.withColumn("__one", F.lit(1)), ["__one"], size).select(F.col("area").alias("__whole"))
    covered = polygons.union_areas(footprints(latest), by, size, clip)
    sets = sets.join(covered, by, "left").crossJoin(F.broadcast(whole)).withColumn("coverage", F.round(F.least(F.lit(1.0), F.coalesce("area", F.lit(0.0)) / F.col("__whole")), 9)).drop("area", "__whole")
    return best_row(sets, acquisition, [F.desc("coverage"), *[F.desc(b) for b in baseline], F.desc("generation"), F.asc("items")])


def gap_sessions(df: DataFrame, by: list[str], ts: str, item: str, gap_seconds: int) -> DataFrame:
    """Adds `session`: a new one where the time since the row before is over the gap."""
    w = Window.partitionBy(*by).orderBy(ts, item)
    new = F.when(F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(w)) <= gap_seconds, 0).otherwise(1)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def span_sessions(df: DataFrame, by: list[str], ts: str, item: str, span_seconds: int, path: str | None = None, row: str | None = None, date: str | None = None) -> DataFrame:
    """(by, item, session): a new group where the time since the group's first row is over the span.

    With `path` and `row`, also where no member of the group is within one of both; what is no whole number is next to nothing. With `date`, one
    of `by`, adds `ambiguous`: whether the date has more than one group, over all values of the other columns.

    Start and members depend on the rows before, so the state folds over ordered times. A gap longer than the span always begins a group, so
    only the rows between two such gaps are folded together.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    ordered = Window.partitionBy(*by).orderBy("__t", item)
    df = df.withColumn("__t", t).withColumn("__gap", F.when(F.col("__t") - F.lag("__t").over(ordered) <= span_seconds * 1_000_000, 0).otherwise(1))
    df = df.withColumn("__island", F.sum("__gap").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    place = [F.expr(f"try_cast(`{c}` AS long)") if c else F.lit(0).cast("long") for c in (path, row)]
    rows = df.groupBy(*by, "__island").agg(F.sort_array(F.collect_list(F.struct(F.col("__t").alias("t"), F.col(item).alias("id"), place[0].alias("path"), place[1].alias("row")))).alias("rows"))
    none = F.array().cast("array<struct<path:bigint,row:bigint>>")
    zero = F.struct(F.lit(None).cast("long").alias("start"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"), none.alias("members"))

    def step(acc: Column, r: Column) -> Column:
        near = F.exists(acc["members"], lambda m: F.coalesce((F.abs(m["path"] - r["path"]) <= 1) & (F.abs(m["row"] - r["row"]) <= 1), F.lit(False)))
        new = acc["start"].isNull() | (r["t"] - acc["start"] > span_seconds * 1_000_000) | ~near
        n = acc["n"] + F.when(new, 1).otherwise(0)
        own = F.struct(r["path"].alias("path"), r["row"].alias("row"))
        return F.struct(F.when(new, r["t"]).otherwise(acc["start"]).alias("start"), n.alias("n"), F.array_append(acc["out"], n).alias("out"), F.array_append(F.when(new, none).otherwise(acc["members"]), own).alias("members"))

    placed = rows.select(*by, "__island", "rows", F.aggregate("rows", zero, step)["out"].alias("out")).withColumn("__n", F.array_max("out"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__island").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("__before", F.coalesce(before, F.lit(0)))
    if date:
        placed = placed.withColumn("ambiguous", F.sum("__n").over(Window.partitionBy(date)) > 1)
    kept = [*by, "ambiguous"] if date else by
    found = placed.select(*kept, "__before", F.explode(F.arrays_zip("rows", "out")).alias("z"))
    return found.select(*by, F.col("z.rows.id").alias(item), (F.col("z.out") + F.col("__before")).cast("int").alias("session"), *kept[len(by) :])


def merge_intervals(df: DataFrame, by: list[str], low: str, high: str) -> DataFrame:
    """(by, low, high, parts): overlapping or adjacent day intervals as one."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = df.withColumn("__new", F.when(F.col(low) <= F.date_add(reach, 1), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "__island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("parts")).drop("__island")


def evenly_spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at rint(i (N - 1) / (n - 1)) of the ordered list; all of them if there are no more. Ranks come from ranges of the order, so the list may be of any length."""
    from tessera.operators.ranking import total_rank

    total = df.count()
    if total <= n:
        return df
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - 1) / max(1, n - 1)).cast("long"))
    return total_rank(df, [order], "__r").where(F.array_contains(places, F.col("__r") - 1)).drop("__r")


def select_candidate(scores: DataFrame, by: list[str], candidate: str, complexity: str, score: str, absolute: float, relative: float) -> DataFrame:
    """Per group the candidate with the least mean score; those within absolute + relative x best tie, and the simpler, then the smaller id wins."""
    means = scores.groupBy(*by, candidate, complexity).agg(F.avg(score).alias("mean_score"), F.count(score).alias("dates"))
    best = F.min("mean_score").over(Window.partitionBy(*by))
    near = means.withColumn("best", best).where(F.col("mean_score") <= F.col("best") + absolute + relative * F.abs("best"))
    return best_row(near, by, [F.asc(complexity), F.asc(candidate)])
