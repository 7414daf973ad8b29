"""Models on panels: imputation, completeness, and linear models for many folds at once from additive sums.

Ordinary and ridge regression need only the sums of products of their columns. Those add up over the cells of any split, so one pass over
the data serves every fold: a fold's sums are those of the cells it trains on, and what is left is a solution of a few unknowns a fold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship_code


def exact_medians(df: DataFrame, columns: Sequence[str], bins: int = 2048) -> dict[str, float | None]:
    """Each column's exact median over its finite values (NaN and infinities count as missing), None where there is none.

    Rounds of counting in ranges, one job a round for all columns: of the bins between the values that have the middle between them, the one that
    holds it is cut again, until its least and largest values are one. The driver holds a count a bin and column, whatever the rows.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    values = values.where(F.col("v").isNotNull() & (F.abs("v") < float("inf")))
    out: dict[str, float | None] = dict.fromkeys(columns)
    first = {r["c"]: (r["n"], r["low"], r["high"]) for r in values.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    # (column, rank) of what is sought: its range and the number of values below that
    open_ = {(c, rank): (low, high, 0) for c, (n, low, high) in first.items() for rank in {(n - 1) // 2, n // 2}}
    found = {}
    while open_:
        for key in [k for k, (low, high, _) in open_.items() if low == high]:
            found[key] = open_.pop(key)[0]
        ranges = sorted({(c, low, high) for (c, _), (low, high, _) in open_.items()})
        if not ranges:
            break
        table = df.sparkSession.createDataFrame(ranges, "c int, low double, high double")
        # halves first, as the width of a range may be too large for a number
        place = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2) * bins))
        within = values.join(F.broadcast(table), "c").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        counts: dict[tuple, list] = {}
        for r in within.groupBy("c", "low", "high", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect():
            counts.setdefault((r["c"], r["low"], r["high"]), []).append((r["bin"], r["n"], r["a"], r["b"]))
        for (c, rank), (low, high, below) in list(open_.items()):
            for _, n, a, b in sorted(counts[c, low, high]):
                if below + n > rank:
                    # a range of two neighbouring numbers can't be cut: its ends are told apart by what lies at the lower one
                    if (a, b) == (low, high):
                        least = values.where((F.col("c") == c) & (F.col("v") == a)).count()
                        a = b = a if below + least > rank else b
                    open_[c, rank] = (a, b, below)
                    break
                below += n
    for c, (n, _, _) in first.items():
        out[columns[c]] = found[c, (n - 1) // 2] / 2 + found[c, n // 2] / 2
    return out


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, `median`: as exact_medians()."""
    return df.sparkSession.createDataFrame([(exact_medians(df, [column])[column],)], "median double")


def impute_medians(train: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the medians of the training rows; a column without any training value stays null (see all_null)."""
    medians = exact_medians(train, columns)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double")) for c in columns})


def incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, bad): values that are null, NaN or infinite, for each column that must be complete."""
    from tessera.functions.scalars import finite

    one = df.agg(*[F.count_if(~F.coalesce(finite(F.col(c).cast("double")), F.lit(False))).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad")) for c in columns])).alias("x")).select("x.*")


def gram_cells(rows: DataFrame, cell: Sequence[str], features: Sequence[str], target: str, weight: str | None = None) -> DataFrame:
    """(cell, m_1, ..., g_i_j, ...): weighted sums of products of (1, features, target), upper triangle.

    Features and target are taken from their means over all rows (m_i, the same in every cell), so that columns far from zero lose no digits.
    """
    cols = [*features, target]
    means = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"m_{i}") for i, c in enumerate(cols, 1)])
    rows = rows.crossJoin(F.broadcast(means))  # one row
    at = [F.lit(1.0), *[F.col(c) - F.col(f"m_{i}") for i, c in enumerate(cols, 1)]]
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(a * b * w).alias(f"g_{i}_{j}") for i, a in enumerate(at) for j, b in enumerate(at) if j >= i]
    return rows.groupBy(*cell).agg(*[F.first(f"m_{i}").alias(f"m_{i}") for i in range(1, len(at))], *sums)


def sum_names(k: int) -> list[str]:
    """The columns of gram cells that add up, for k columns in all (one, features, target)."""
    return [f"g_{i}_{j}" for i in range(k) for j in range(i, k)]


def without_features(cells: DataFrame, features: Sequence[str], dropped: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """(gram cells, features) without some features: a choice of sums, no new pass over the rows."""
    k = len(features) + 2
    kept = [0, *[i for i, f in enumerate(features, 1) if f not in dropped], k - 1]
    others = [c for c in cells.columns if not c.startswith(("g_", "m_"))]
    sums = [F.col(f"g_{a}_{b}").alias(f"g_{i}_{j}") for i, a in enumerate(kept) for j, b in enumerate(kept) if j >= i]
    return cells.select(*others, *[F.col(f"m_{a}").alias(f"m_{i}") for i, a in enumerate(kept) if i], *sums), [f for f in features if f not in dropped]


def _elastic(c: np.ndarray, r: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """argmin 1/2 b'cb - r'b + alpha (l1_ratio |b| + (1 - l1_ratio) / 2 b'b), by coordinate descent."""
    b = np.zeros(len(r))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(r)):
            z = r[j] - c[j] @ b + c[j, j] * b[j]
            new = np.sign(z) * max(abs(z) - alpha * l1_ratio, 0.0) / (c[j, j] + alpha * (1 - l1_ratio))
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tolerance * max(1.0, np.abs(b).max(initial=0)):
            return b
    raise ValueError("coordinate descent did not settle")


def ridge_by_fold(cells: DataFrame, fold: Sequence[str], features: Sequence[str], alphas: Sequence[float], l1_ratio: float | None = None) -> DataFrame:
    """(fold, alpha, b_0, b_1, ...): ridge on standardised features (population deviation), the intercept free, written back to raw units; alpha 0 is least squares.

    cells: gram cells joined to the folds that train on them. The sums of a fold are one row, so a task solves many folds at a time. With
    l1_ratio it is the elastic net instead, alpha (l1_ratio |b| + (1 - l1_ratio) / 2 b'b) beside half the mean squared error. Where the
    sums are weighted, a column `rows` gives the numbers of rows that ridge holds its penalty against.
    """
    ship_code(cells.sparkSession)
    k = len(features) + 2
    counted = "rows" in cells.columns
    totals = [*(F.first(f"m_{i}").alias(f"m_{i}") for i in range(1, k)), *(F.sum(n).alias(n) for n in sum_names(k))]
    summed = cells.groupBy(*fold).agg(*totals, *([F.sum("rows").alias("rows")] if counted else []))
    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in fold), "alpha double", *[f"b_{i} double" for i in range(k - 1)]])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                g = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
                n, mean = g[0, 0], g[0, 1:] / g[0, 0]
                cov = g[1:, 1:] / n - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
                use = sd > 1e-12
                centre = mean + np.array([row[f"m_{i}"] for i in range(1, k)])
                for a in alphas:
                    b = np.zeros(k - 2)
                    if use.any():
                        c, r = cov[:-1, :-1][np.ix_(use, use)] / np.outer(sd[use], sd[use]), cov[:-1, -1][use] / sd[use]
                        if l1_ratio is None:
                            b[use] = np.linalg.solve(c + np.eye(use.sum()) * a / (row["rows"] if counted else n), r) / sd[use]
                        else:
                            b[use] = _elastic(c, r, a, l1_ratio) / sd[use]
                    out.append([*(row[f] for f in fold), float(a), float(centre[-1] - b @ centre[:-1]), *map(float, b)])
            yield pd.DataFrame(out, columns=[*fold, "alpha", *[f"b_{i}" for i in range(k - 1)]])

    return summed.mapInPandas(solve, schema)


def linear_predictions(rows: DataFrame, coefficients: DataFrame, on: Sequence[str], features: Sequence[str], name: str = "pred") -> DataFrame:
    """Join each row to its fold's coefficients and predict by a column expression."""
    pred = F.col("b_0")
    for i, f in enumerate(features, 1):
        pred = pred + F.col(f"b_{i}") * F.col(f)
    return rows.join(coefficients, [*on]).withColumn(name, pred).drop(*[f"b_{i}" for i in range(len(features) + 1)])


def date_scores(rows: DataFrame, coefficients: DataFrame, on: Sequence[str], fits: Sequence[str], features: Sequence[str], target: str, day: str) -> DataFrame:
    """(on, fits, dates, mae): the mean over dates of each date's mean absolute error, for every fit (`fits`) that scores a row's part (`on`).

    Rows meet the fits of their own part only, and a date's errors are summed before they are shuffled.
    """
    scored = linear_predictions(rows, coefficients, on, features, "__pred")
    by_date = scored.groupBy(*on, *fits, day).agg(F.avg(F.abs(F.col("__pred") - F.col(target))).alias("__mae"))
    return by_date.groupBy(*on, *fits).agg(F.count(F.lit(1)).alias("dates"), F.avg("__mae").alias("mae"))


def make_model(kind: str, features: Sequence[str], target: str, weight: str | None = None, **settings) -> Pipeline:
    """A pipeline of median imputer, assembler, scaler and regressor: `ols`, `ridge`, `elastic` or `boosted` (absolute loss)."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", relativeError=0.0, inputCols=[*features], outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)]
    common = {"featuresCol": "__x", "labelCol": target, "predictionCol": "pred"} | ({"weightCol": weight} if weight else {})
    if kind == "boosted":
        regressor = GBTRegressor(lossType="absolute", seed=1, **common, **settings)
    else:
        mix = {"ols": 0.0, "ridge": 0.0, "elastic": settings.pop("l1_ratio", 0.5)}[kind]
        regressor = LinearRegression(elasticNetParam=mix, regParam=0.0 if kind == "ols" else settings.pop("alpha", 1.0), standardization=False, **common, **settings)
    return Pipeline(stages=[*stages, regressor])
