"""Fits of nested folds from sums against direct refits, and what the sums must bear: large offsets, penalties of two kinds."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds as O
from tessera.operators import models as L
from tessera.operators import splits as S

PLACE = {"year": "yr", "day": "day", "block": "block", "unit": "unit"}


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    data = []
    for unit in range(12):
        for year in (2019, 2020, 2021, 2022):
            for k in range(3):
                if rng.random() < 0.85:
                    a, b = rng.gauss(50, 5), rng.gauss(0, 1)
                    data.append((unit, unit % 4, year, dt.date(year, 6, 1 + k), a, b, 0.3 * a - b + 0.1 * (year - 2020) + rng.gauss(0, 1)))
    near = [(str(b), u) for b in range(4) for u in range(12) if u % 4 != b and (u + b) % 5 == 0]
    return data, near, spark.createDataFrame(data, "unit int, block int, yr long, day date, a double, b double, y double"), spark.createDataFrame(near, "held_block string, unit int")


def direct(train, alpha):
    """Ridge with dates weighing alike, from its rows."""
    days = [r[3] for r in train]
    w = np.array([len(train) / (len(set(days)) * days.count(d)) for d in days])
    x, y = np.array([[r[4], r[5]] for r in train]), np.array([r[6] for r in train])
    mean, my = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    sd = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = (x - mean) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(2), (z * w[:, None]).T @ (y - my)) / sd
    return my - b @ mean, b


def trains(row, fold, near):
    family, year, block = fold
    if family == "temporal":
        return row[2] != year
    if family == "spatial":
        return str(row[1]) != block
    return row[2] != year and str(row[1]) != block and (block, row[0]) not in near


def test_nested_scores_and_predictions_equal_direct_refits(panel):
    data, near_rows, rows, near = panel
    close, alphas = set(near_rows), [0.0, 4.0]
    folds = S.fold_table(rows, "yr", "block")
    cells = O.outside_cells(rows, ["a", "b"], "y", "yr", "day", "block", "unit", near).cache()
    scores = O.nested_scores(rows, cells, folds, ["a", "b"], "y", alphas, **PLACE, buffer=near).cache()
    got = {(r["fold"], r["inner_year"], r["alpha"], r["day"]): r["mae"] for r in scores.collect()}
    want, picks = {}, {}
    listed = [(r["family"], r["held_year"], r["held_block"], r["fold"]) for r in folds.collect()]
    for family, year, block, name in listed:
        outer = [r for r in data if trains(r, (family, year, block), close)]
        for inner in {r[2] for r in outer}:
            for alpha in alphas:
                b0, b = direct([r for r in outer if r[2] != inner], alpha)
                for day in {r[3] for r in outer if r[2] == inner}:
                    want[name, inner, alpha, day] = np.mean([abs(b0 + b @ [r[4], r[5]] - r[6]) for r in outer if r[3] == day])
        means = {a: np.mean([v for (n, _, al, _), v in want.items() if n == name and al == a]) for a in alphas}
        picks[name] = max(a for a in alphas if means[a] <= min(means.values()) * 1.001 + 1e-9)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    chosen = O.chosen_candidates(scores)
    assert {r["fold"]: r["alpha"] for r in chosen.collect()} == picks
    pred = O.outer_predictions(rows, cells, folds, chosen, ["a", "b"], alphas, "yr", "block").collect()
    assert len(pred) == 3 * len(data)
    for r in random.Random(1).sample(pred, 60):
        b0, b = direct([d for d in data if trains(d, (r["family"], r["held_year"], r["held_block"]), close)], r["alpha"])
        assert r["pred"] == pytest.approx(b0 + b @ [r["a"], r["b"]], abs=1e-9)


def test_sums_bear_large_offsets(spark):
    rng = np.random.default_rng(0)
    for offset in (0.0, 1e6, 1e8):
        x = rng.normal(size=300) + offset
        df = spark.createDataFrame([(i % 3, float(v), float(2 * v + 1)) for i, v in enumerate(x)], "cell int, x double, y double")
        cells = L.gram_cells(df, ["cell"], ["x"], "y").where("cell <> 0").withColumn("fold", F.lit(0))
        assert L.ridge_by_fold(cells, ["fold"], ["x"], [0.0]).first()["b_1"] == pytest.approx(2.0, abs=1e-6)


def test_elastic_net_from_sums_equals_a_fit_of_the_rows(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 4)) * [1, 5, 0.2, 3] + [0, 10, 1, -4]
    y = x @ [1.0, 0.2, 0.0, -0.5] + 7 + rng.normal(size=240)
    data = [(i % 4, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    names = ["p", "q", "r", "s"]
    df = spark.createDataFrame(data, "cell int, p double, q double, r double, s double, y double")
    cells = L.gram_cells(df, ["cell"], names, "y")
    folds = cells.join(spark.createDataFrame([(h,) for h in range(4)], "held int"), F.col("cell") != F.col("held"))
    got = {(r["held"], r["alpha"]): [r[f"b_{i}"] for i in range(5)] for r in L.ridge_by_fold(folds, ["held"], names, [0.05, 0.4], l1_ratio=0.5).collect()}
    assert len(got) == 8
    for held in (0, 3):
        part = np.arange(240) % 4 != held
        sd = x[part].std(0)
        scaled = spark.createDataFrame([(*map(float, v / sd), float(t)) for v, t in zip(x[part], y[part])], "p double, q double, r double, s double, y double")
        ready = VectorAssembler(inputCols=names, outputCol="v").transform(scaled)
        for alpha in (0.05, 0.4):
            # Spark divides the square penalty, not the absolute one, by the label's deviation
            one, two = alpha * 0.5, alpha * 0.5 * y[part].std()
            fit = LinearRegression(featuresCol="v", labelCol="y", regParam=one + two, elasticNetParam=one / (one + two), standardization=False, tol=1e-12, maxIter=5000).fit(ready)
            assert got[held, alpha][1:] == pytest.approx([c / s for c, s in zip(fit.coefficients, sd)], abs=1e-6)
            assert got[held, alpha][0] == pytest.approx(fit.intercept, abs=1e-5)
    assert all(abs(v[3]) < 1e-12 for (_, a), v in got.items() if a == 0.4)


def test_rows_do_not_meet_fits_in_a_join(panel):
    """A row of a year stood once for each of its fits."""
    from tests.test_polygons import joined

    data, _, rows, near = panel
    folds = O.held(S.fold_table(rows, "yr", "block"))
    cells = O.held(O.outside_cells(rows, ["a", "b"], "y", "yr", "day", "block", "unit", near))
    empty = rows.withColumn("b", F.when(F.col("unit") == 1, F.col("b")))  # a null feature: no error, but a date all the same
    scores = O.nested_scores(rows, cells, folds, ["a", "b"], "y", [0.0, 4.0, 9.0], **PLACE, buffer=near)
    assert joined(scores) <= 3 * len(data)
    fits = L.ridge_by_fold(O.training_cells(cells, folds, "yr", True), ["family", "fold", "held_block", "inner_year"], ["a", "b"], [0.0])
    got = O.inner_date_scores(empty.where("unit in (1, 2)"), fits, ["a", "b"], "y", **PLACE, buffer=near).collect()
    ones, twos = ({r[3] for r in data if r[0] == u} for u in (1, 2))
    assert {r["day"] for r in got if r["mae"] is None and r["family"] == "temporal"} == twos - ones and {r["day"] for r in got} == ones | twos


def test_tested_rows_stay_where_they_are(panel):
    """Predictions need no shuffle of the rows: folds and fits are sent to them."""
    _, _, rows, near = panel
    folds = O.held(S.fold_table(rows, "yr", "block"))
    cells = O.held(O.outside_cells(rows, ["a", "b"], "y", "yr", "day", "block", "unit", near))
    chosen = folds.select("family", "fold", F.lit(4.0).alias("alpha"))
    plan = O.outer_predictions(rows, cells, folds, chosen, ["a", "b"], [4.0], "yr", "block")._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Union")]
    assert "BroadcastHashJoin" in top and "SortMergeJoin" not in top


def test_few_rows_are_taken_once(panel):
    """Folds and sums by place and year are used by every way of an ablation; their plans stood in each of them."""
    _, _, rows, near = panel
    cells = O.outside_cells(rows, ["a", "b"], "y", "yr", "day", "block", "unit", near)
    kept = O.held(cells)
    assert kept.schema == cells.schema and sorted(map(str, kept.collect())) == sorted(map(str, O.held(kept).collect()))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
