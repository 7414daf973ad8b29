"""Nested cross-validation of linear models over temporal, spatial and joint folds, from sums.

What a fold trains on is all rows less a year, less a block, or less both and the units near the block. So its sums are sums over years and
places: those of everything outside a place (nowhere, a block, or a block and what is near it), by year, are taken once by inclusion and
exclusion, and every outer and inner fold adds up those of its years. No row meets a fold before predictions are scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import models, splits, windows
from tessera.session import ship_code

FAMILIES = ("temporal", "spatial", "joint")


def near_rows(rows: DataFrame, buffer: DataFrame, block: str, unit: str) -> DataFrame:
    """Rows of units near a block, without the block's own: (the row, held_block)."""
    near = buffer.select("held_block", unit).distinct()
    return rows.join(near, unit).where(F.col(block).cast("string") != F.col("held_block"))


def outside_cells(rows: DataFrame, features: Sequence[str], target: str, year: str, day: str, block: str, unit: str, buffer: DataFrame, balanced: bool = True) -> DataFrame:
    """(held_block, near, year, rows, m_i, g_i_j): sums over the rows outside a place, by year.

    held_block null is nowhere; `near` says whether units near the block (buffer: held_block, unit) are left out with it. Balanced, dates weigh
    alike: a date's sums are divided by its rows that are left, so g_0_0 counts dates; `rows` counts rows.
    """
    k = len(features) + 2
    names = models.sum_names(k)
    cells = models.gram_cells(rows, [year, day, block], features, target)
    means = [f"m_{i}" for i in range(1, k)]
    total = lambda df, by: df.groupBy(*by).agg(*[F.first(m).alias(m) for m in means], *[F.sum(n).alias(n) for n in names])
    everything = total(cells, [year, day])
    own = cells.select(F.col(block).cast("string").alias("held_block"), year, day, *names)
    # the same centres, so that the sums can be taken from one another
    centred = near_rows(rows, buffer, block, unit).crossJoin(F.broadcast(cells.agg(*[F.first(m).alias(m) for m in means])))
    at = [F.lit(1.0), *[F.col(c) - F.col(m) for c, m in zip([*features, target], means, strict=True)]]
    near = centred.groupBy("held_block", year, day).agg(*[F.sum(at[i] * at[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)])
    places = own.select("held_block").distinct()
    nowhere = everything.withColumns({"held_block": F.lit(None).cast("string"), "near": F.lit(False)})
    # a place's sums, block alone and block with its buffer, as rows to be added up with all rows' as negatives
    minus = own.withColumn("near", F.explode(F.array(F.lit(False), F.lit(True)))).unionByName(near.withColumn("near", F.lit(True)))
    minus = minus.groupBy("held_block", "near", year, day).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    less = everything.crossJoin(places.crossJoin(rows.sparkSession.createDataFrame([(False,), (True,)], "near boolean"))).join(minus, ["held_block", "near", year, day], "left")
    less = less.select("held_block", "near", year, day, *means, *[(F.col(n) - F.coalesce(f"__{n}", F.lit(0.0))).alias(n) for n in names])
    dates = nowhere.select("held_block", "near", year, day, *means, *names).unionByName(less).where("g_0_0 > 0.5").withColumn("rows", F.round("g_0_0"))
    if balanced:
        dates = dates.withColumns({n: F.col(n) / F.col("rows") for n in names})
    return dates.groupBy("held_block", "near", year).agg(F.sum("rows").alias("rows"), *[F.first(m).alias(m) for m in means], *[F.sum(n).alias(n) for n in names])


def training_cells(cells: DataFrame, folds: DataFrame, year: str, inner: bool) -> DataFrame:
    """Each fold with the cells that it trains on; `inner` adds each of its training years in turn as inner_year, left out as well.

    folds: (family, fold, held_year, held_block). Families other than the three are taken to hold out nothing in space.
    """
    place = F.when(F.col("family").isin("spatial", "joint"), F.col("held_block"))
    f = folds.select("family", "fold", "held_year", "held_block", place.alias("__place"), (F.col("family") == "joint").alias("__near"))
    c = cells.withColumnRenamed("held_block", "__b")
    on = F.col("__place").eqNullSafe(F.col("__b")) & (F.col("__near") == F.col("near")) & (F.col("held_year").isNull() | (F.col("held_year") != F.col(year)))
    j = f.join(c, on).drop("__place", "__near", "__b", "near")
    if inner:
        years = j.select("fold", F.col(year).alias("inner_year")).distinct()
        j = j.join(years, "fold").where(F.col(year) != F.col("inner_year"))
    return j


def held(few: DataFrame) -> DataFrame:
    """A table of a few rows (folds, a place's sums by year), computed once and kept in the plan."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


#: So many errors (rows x fits) are held at a time.
ERRORS = 1_000_000


def inner_date_scores(rows: DataFrame, fits: DataFrame, features: Sequence[str], target: str, year: str, day: str, block: str, unit: str, buffer: DataFrame) -> DataFrame:
    """(family, fold, inner_year, alpha, day, mae): every inner fit on the rows of its inner year that are not left out in space.

    fits: (family, fold, held_block, inner_year, alpha, b_i); the driver takes them at once and sends them to all tasks, with the distinct sets of blocks
    that a unit is near. Rows never meet fits as rows: a task takes a batch's errors under all fits of its year as one product and adds them up by date,
    and what is shuffled is one row a date and task.
    """
    spark, width = rows.sparkSession, len(features)
    ship_code(spark)
    near = buffer.select("held_block", unit).distinct().groupBy(unit).agg(F.array_sort(F.collect_set("held_block")).alias("__near"))  # blocks near one unit
    sets = [r["__near"] for r in near.select("__near").distinct().collect()]
    codes = F.create_map(*[v for i, b in enumerate(sets) for v in (F.array(*map(F.lit, b)).cast("string"), F.lit(i))]) if sets else None
    coded = near.select(unit, codes[F.col("__near").cast("string")].alias("__near")) if sets else near.select(unit, F.lit(-1).alias("__near")).limit(0)
    at = rows.join(coded, unit, "left").select(F.col(year).alias("year"), F.col(day).alias("day"), F.col(block).cast("string").alias("block"), F.coalesce("__near", F.lit(-1)).alias("near"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y"))
    by_year: dict = {}
    for r in fits.collect():
        by_year.setdefault(r["inner_year"], []).append((r["family"], r["fold"], r["alpha"], r["held_block"], [r[f"b_{i}"] for i in range(width + 1)]))
    sent = spark.sparkContext.broadcast((by_year, [frozenset(b) for b in sets]))

    def left_in(listed: list, place: str | None, close: frozenset) -> np.ndarray:
        """Which fits score the rows of a block and set of near blocks."""
        return np.array([b is None or family == "temporal" or (place is not None and place != b and (family != "joint" or b not in close)) for family, _, _, b, _ in listed])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits_of, near_sets = sent.value
        slopes = {k: np.array([f[4] for f in v], float) for k, v in fits_of.items()}
        places: dict = {}
        total: dict = {}
        for batch in batches:
            kind = batch.schema.field("day").type
            coded = {c: batch.column(c).dictionary_encode(null_encoding="encode") for c in ("year", "day", "block")}
            names = {c: v.dictionary.to_pylist() for c, v in coded.items()}
            y_of, d_of, b_of = (coded[c].indices.to_numpy() for c in ("year", "day", "block"))
            n_of, values = batch.column("near").to_numpy(), np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*[f"x{i}" for i in range(width)], "y")])
            known = np.ones(len(values[0]), bool)
            for c in (*[f"x{i}" for i in range(width)], "y"):
                known &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            for i, this in enumerate(names["year"]):
                if this not in fits_of:
                    continue
                mine, b = np.flatnonzero(y_of == i), slopes[this]
                mine = mine[np.argsort(d_of[mine], kind="stable")]
                step = max(1, ERRORS // len(b))
                for part in (mine[k : k + step] for k in range(0, len(mine), step)):
                    error = np.abs(b[:, 0] + values[:-1, part].T @ b[:, 1:].T - values[-1, part][:, None])
                    pairs, which = np.unique(np.stack([b_of[part], n_of[part]]), axis=1, return_inverse=True)
                    kept = []
                    for place, close in pairs.T:
                        key = (this, names["block"][place], int(close))
                        if key not in places:
                            places[key] = left_in(fits_of[this], key[1], near_sets[close] if close >= 0 else frozenset())
                        kept.append(places[key])
                    seen = np.array(kept)[which.ravel()]
                    first = np.flatnonzero(np.diff(d_of[part], prepend=-1))
                    counted = seen & known[part][:, None]
                    held_ = (np.where(counted, error, 0.0), counted.astype(float), seen.astype(float))
                    for d, *sums in zip(d_of[part][first], *[np.add.reduceat(h, first, axis=0) for h in held_], strict=True):
                        key = (this, names["day"][d])
                        total[key] = total[key] + sums if key in total else np.array(sums)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int64()), pa.array([k[1] for k in total], kind), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["year", "day", "held"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits_of, total = sent.value[0], {}
        for batch in batches:
            kind = batch.schema.field("day").type
            for y, d, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total[y, d] = total.get((y, d), 0.0) + np.frombuffer(h)
        for (y, d), v in total.items():
            error, counted, seen = v.reshape(3, -1)
            kept = np.flatnonzero(seen)
            names = [fits_of[y][i] for i in kept]
            mae = pa.array(error[kept] / np.where(counted[kept] > 0, counted[kept], 1.0), mask=counted[kept] == 0)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in names], pa.string()), pa.array([f[1] for f in names], pa.string()), pa.array([y] * len(kept), pa.int64()), pa.array([f[2] for f in names], pa.float64()), pa.array([d] * len(kept), kind), mae], names=["family", "fold", "inner_year", "alpha", day, "mae"])

    of_day = rows.schema[day].dataType.simpleString()
    parts = at.withColumn("year", F.col("year").cast("long")).mapInArrow(summed, f"year long, day {of_day}, held binary").repartition("year", "day")
    return parts.mapInArrow(joined, f"family string, fold string, inner_year long, alpha double, `{day}` {of_day}, mae double")


def nested_scores(rows: DataFrame, cells: DataFrame, folds: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float], year: str, day: str, block: str, unit: str, buffer: DataFrame, l1_ratio: float | None = None, used: Sequence[str] | None = None) -> DataFrame:
    """Date scores of all inner fits of all folds: as inner_date_scores. `used` names the features that cells still have."""
    used = [*(used if used is not None else features)]
    fits = models.ridge_by_fold(training_cells(cells, folds, year, True), ["family", "fold", "held_block", "inner_year"], used, alphas, l1_ratio)
    return inner_date_scores(rows, fits, used, target, year, day, block, unit, buffer)


def chosen_candidates(scores: DataFrame, absolute: float = 1e-9, relative: float = 0.001) -> DataFrame:
    """(family, fold, alpha): the candidate of the least mean over all inner dates; among those as good, the largest penalty."""
    ranked = scores.withColumn("complexity", -F.col("alpha"))
    return windows.select_candidate(ranked, ["family", "fold"], "alpha", "complexity", "mae", absolute, relative).select("family", "fold", "alpha")


def outer_predictions(rows: DataFrame, cells: DataFrame, folds: DataFrame, chosen: DataFrame, features: Sequence[str], alphas: Sequence[float], year: str, block: str, l1_ratio: float | None = None) -> DataFrame:
    """(the row, family, fold, held_year, held_block, alpha, pred): each fold refitted with its candidate, on its test rows. A fit a fold goes to all tasks, rows stay where they are."""
    fits = models.ridge_by_fold(training_cells(cells, folds, year, False), ["family", "fold"], features, alphas, l1_ratio).join(chosen, ["family", "fold", "alpha"])
    return models.linear_predictions(splits.tested_rows(rows, folds, year, block), F.broadcast(fits), ["family", "fold"], features)
