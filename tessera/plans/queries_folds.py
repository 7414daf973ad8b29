"""Nested tuning, prediction and ablation over all three fold families (inventory F22 to F25), dates weighing alike in every fit.

Units are suppliers, blocks their number modulo 6; units whose last digit is a block's number are near it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import folds as O
from tessera.operators import splits as S
from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table

ALPHAS = [0.0, 1000.0, 100000.0]
FEATURES = ["x", "z"]
_PLACE = {"year": "yr", "day": "day", "block": "block", "unit": "unit"}


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("unit"), (F.col("l_suppkey") % 6).alias("block"), F.year("l_shipdate").cast("long").alias("yr"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("y"))


def near_blocks(rows: DataFrame) -> DataFrame:
    return rows.select("unit").distinct().withColumn("held_block", (F.col("unit") % 10).cast("string")).where("unit % 10 < 6")


# d has one row a fold and day of what the fold trains on: n rows and their mean moments; v the rows that its inner years score
_SQL = f"""r AS (SELECT l_orderkey, l_linenumber, l_suppkey AS unit, l_suppkey % 6 AS block, year(l_shipdate) AS yr, CAST(l_shipdate AS DATE) AS day, l_quantity AS x, l_discount * 100 AS z, l_extendedprice / 1000 AS y FROM lineitem),
    f AS (SELECT 'temporal' AS family, yr AS held_year, CAST(NULL AS BIGINT) AS held_block FROM r UNION SELECT 'spatial', NULL, block FROM r UNION SELECT 'joint', yr, block FROM r),
    v AS (SELECT f.*, r.* FROM r JOIN f ON CASE family WHEN 'temporal' THEN yr <> held_year WHEN 'spatial' THEN block <> held_block ELSE yr <> held_year AND block <> held_block AND unit % 10 <> held_block END),
    d AS (SELECT family, held_year, held_block, yr, day, count(*) AS n, avg(x) AS x, avg(z) AS z, avg(y) AS y, avg(x * x) AS xx, avg(z * z) AS zz, avg(x * z) AS xz, avg(x * y) AS xy, avg(z * y) AS zy FROM v GROUP BY ALL),
    a AS (SELECT unnest({ALPHAS}) AS alpha), iy AS (SELECT DISTINCT family, held_year, held_block, yr AS inner_year FROM d)"""
_SAME = "d.family = k.family AND d.held_year IS NOT DISTINCT FROM k.held_year AND d.held_block IS NOT DISTINCT FROM k.held_block"
_ONE = "(avg(d.xy) - avg(d.x) * avg(d.y)) / ((avg(d.xx) - avg(d.x) * avg(d.x)) * (1 + any_value(a.alpha) / sum(d.n)))"
_INNER = f"""{_SQL}, fits AS (SELECT k.family, k.held_year, k.held_block, k.inner_year, a.alpha, avg(d.y) - {_ONE} * avg(d.x) AS b0, {_ONE} AS b1 FROM iy k JOIN d ON {_SAME} AND d.yr <> k.inner_year, a GROUP BY ALL),
    dates AS (SELECT k.family, k.held_year, k.held_block, k.inner_year, k.alpha, d.day, avg(abs(b0 + b1 * d.x - d.y)) AS mae FROM fits k JOIN v d ON {_SAME} AND d.yr = k.inner_year GROUP BY ALL)"""
_CHOSEN = "means AS (SELECT family, held_year, held_block, alpha, avg(mae) AS mean_score, min(avg(mae)) OVER (PARTITION BY family, held_year, held_block) AS best FROM dates GROUP BY 1, 2, 3, 4), chosen AS (SELECT family, held_year, held_block, max(alpha) AS alpha FROM means WHERE mean_score <= best + 1e-9 + 0.001 * abs(best) GROUP BY 1, 2, 3)"
_TESTED = "CASE k.family WHEN 'temporal' THEN r.yr = k.held_year WHEN 'spatial' THEN r.block = k.held_block ELSE r.yr = k.held_year AND r.block = k.held_block END"


def nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, cells, folds, inner date scores) with one feature."""
    rows = fold_rows(spark, sf_dir)
    near, folds = near_blocks(rows), O.held(S.fold_table(rows, "yr", "block"))
    cells = O.held(O.outside_cells(rows, ["x"], "y", "yr", "day", "block", "unit", near))
    return rows, cells, folds, O.nested_scores(rows, cells, folds, ["x"], "y", ALPHAS, **_PLACE, buffer=near)


@query("f22_inner_scores_by_family", f"WITH {_INNER} SELECT family, held_year, CAST(held_block AS VARCHAR) AS held_block, inner_year, CAST(alpha AS DOUBLE) AS alpha, count(*) AS dates, round(avg(mae), 6) AS mae FROM dates GROUP BY ALL")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outer fold's inner years, for each candidate: no row of the fold's test or purged part trains or scores."""
    _, _, folds, scores = nested(spark, sf_dir)
    means = scores.groupBy("family", "fold", "inner_year", "alpha").agg(F.count(F.lit(1)).alias("dates"), F.round(F.avg("mae"), 6).alias("mae"))
    return means.join(folds, ["family", "fold"]).drop("fold")


@query("f23_predictions_by_family", f"WITH {_INNER}, {_CHOSEN}, outer_fits AS (SELECT k.family, k.held_year, k.held_block, a.alpha, avg(d.y) - {_ONE} * avg(d.x) AS b0, {_ONE} AS b1 FROM chosen k JOIN a ON a.alpha = k.alpha JOIN d ON {_SAME} GROUP BY ALL) SELECT k.family, l_orderkey, l_linenumber, CAST(alpha AS DOUBLE) AS alpha, round(y, 6) AS y, round(b0 + b1 * x, 5) AS pred FROM outer_fits k JOIN r ON {_TESTED}")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row once a family, by the fold that tests it, refitted with the candidate that its own inner years chose."""
    rows, cells, folds, scores = nested(spark, sf_dir)
    out = O.outer_predictions(rows, cells, folds, O.chosen_candidates(scores), ["x"], ALPHAS, "yr", "block")
    return rounded(out.select("family", "l_orderkey", "l_linenumber", "alpha", F.round("y", 6).alias("y"), "pred"), "pred", digits=5)


@query(
    "f24_final_tuning",
    f"""WITH {_SQL}, t AS (SELECT yr, day, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy FROM r GROUP BY ALL),
    fits AS (SELECT k.yr AS inner_year, a.alpha, avg(d.y) - {_ONE} * avg(d.x) AS b0, {_ONE} AS b1 FROM (SELECT DISTINCT yr FROM t) k JOIN t d ON d.yr <> k.yr, a GROUP BY ALL),
    dates AS (SELECT inner_year, alpha, day, avg(abs(b0 + b1 * x - y)) AS mae FROM fits JOIN r ON r.yr = inner_year GROUP BY ALL), m AS (SELECT alpha, count(*) AS dates, avg(mae) AS mean_score, min(avg(mae)) OVER () AS best FROM dates GROUP BY 1)
    SELECT CAST(alpha AS DOUBLE) AS alpha, dates, round(mean_score, 6) AS mean_score, alpha = max(alpha) FILTER (mean_score <= best + 1e-9 + 0.001 * abs(best)) OVER () AS chosen FROM m""",
)
def f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final model's candidate: each year of the whole development set left out once, dates scored alike."""
    rows = fold_rows(spark, sf_dir)
    near = near_blocks(rows)
    cells = O.outside_cells(rows, ["x"], "y", "yr", "day", "block", "unit", near).where("held_block is null")
    whole = spark.createDataFrame([("final", "final", None, None)], "family string, fold string, held_year long, held_block string")
    scores = O.nested_scores(rows, cells, whole, ["x"], "y", ALPHAS, **_PLACE, buffer=near)
    chosen = O.chosen_candidates(scores).select("alpha", F.lit(True).alias("chosen"))
    means = scores.groupBy("alpha").agg(F.count(F.lit(1)).alias("dates"), F.round(F.avg("mae"), 6).alias("mean_score"))
    return means.join(chosen, "alpha", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def _ablation_sql() -> str:
    """Both features, or either alone, in every fold of every family, with the candidate that inner years chose."""
    vx, vz, cxz, cxy, czy = (f"(avg(d.{a}{b}) - avg(d.{a}) * avg(d.{b}))" for a, b in ("xx", "zz", "xz", "xy", "zy"))
    lam = "(1 + any_value(a.alpha) / sum(d.n))"
    det = f"({lam} * {lam} * {vx} * {vz} - {cxz} * {cxz})"
    ways = {"none": (f"({lam} * {vz} * {cxy} - {cxz} * {czy}) / {det}", f"({lam} * {vx} * {czy} - {cxz} * {cxy}) / {det}"), "terms": (f"{cxy} / ({vx} * {lam})", "0.0"), "size": ("0.0", f"{czy} / ({vz} * {lam})")}

    def fits(name: str, keys: str, source: str) -> str:
        parts = [f"SELECT '{w}' AS left_out, {keys}, a.alpha, avg(d.y) - ({b}) * avg(d.x) - ({c}) * avg(d.z) AS b0, {b} AS b1, {c} AS b2 FROM {source}, a GROUP BY ALL" for w, (b, c) in ways.items()]
        return f"{name} AS ({' UNION ALL '.join(parts)})"

    fold = "k.family, k.held_year, k.held_block"
    return f"""WITH {_SQL}, {fits("fits", f"{fold}, k.inner_year", f"iy k JOIN d ON {_SAME} AND d.yr <> k.inner_year")},
    dates AS (SELECT k.left_out, {fold}, k.inner_year, k.alpha, d.day, avg(abs(b0 + b1 * d.x + b2 * d.z - d.y)) AS mae FROM fits k JOIN v d ON {_SAME} AND d.yr = k.inner_year GROUP BY ALL),
    means AS (SELECT left_out, {fold}, alpha, avg(mae) AS mean_score, min(avg(mae)) OVER (PARTITION BY left_out, {fold}) AS best FROM dates k GROUP BY 1, 2, 3, 4, 5),
    chosen AS (SELECT left_out, {fold}, max(alpha) AS alpha FROM means k WHERE mean_score <= best + 1e-9 + 0.001 * abs(best) GROUP BY 1, 2, 3, 4),
    {fits("outer_all", fold, f"f k JOIN d ON {_SAME}")},
    pred AS (SELECT c.left_out, k.family, r.day, avg(abs(b0 + b1 * x + b2 * z - y)) AS mae FROM chosen c JOIN outer_all k ON k.left_out = c.left_out AND k.alpha = c.alpha AND k.family = c.family AND k.held_year IS NOT DISTINCT FROM c.held_year AND k.held_block IS NOT DISTINCT FROM c.held_block JOIN r ON {_TESTED} GROUP BY ALL)
    SELECT left_out, family, count(*) AS dates, round(avg(mae), 5) AS mae FROM pred GROUP BY 1, 2"""


@query("f25_ablation_by_family", _ablation_sql())
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refits without each feature family, nested choice and all, in each fold family: one set of sums serves them all."""
    from tessera.operators import models as L

    rows = fold_rows(spark, sf_dir)
    near, folds = near_blocks(rows), O.held(S.fold_table(rows, "yr", "block"))
    cells, out = O.held(O.outside_cells(rows, FEATURES, "y", "yr", "day", "block", "unit", near)), None
    for left_out, dropped in (("none", []), ("size", ["x"]), ("terms", ["z"])):
        part, names = L.without_features(cells, FEATURES, dropped)
        scores = O.nested_scores(rows, part, folds, FEATURES, "y", ALPHAS, **_PLACE, buffer=near, used=names)
        pred = O.outer_predictions(rows, part, folds, O.chosen_candidates(scores), names, ALPHAS, "yr", "block")
        by_date = pred.groupBy("family", "day").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
        part = by_date.groupBy("family").agg(F.count(F.lit(1)).alias("dates"), F.round(F.avg("mae"), 5).alias("mae")).withColumn("left_out", F.lit(left_out))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "f19_elastic_by_year",
    """WITH r AS (SELECT year(l_shipdate) AS yr, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), s AS (SELECT h.yr AS held, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sd, covar_pop(y, x) / stddev_pop(x) AS c FROM r JOIN (SELECT DISTINCT yr FROM r) h ON r.yr <> h.yr GROUP BY 1),
    b AS (SELECT held, alpha, mx, my, sign(c) * greatest(abs(c) - alpha * 0.1, 0.0) / (1 + alpha * 0.9) / sd AS b1 FROM s, (SELECT unnest([0.001, 1.0, 500.0]) AS alpha))
    SELECT held, CAST(alpha AS DOUBLE) AS alpha, round(my - b1 * mx, 6) AS b_0, round(b1, 6) AS b_1 FROM b""",
)
def f19_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elastic net of every leave-one-year-out fold, by coordinate descent on its sums: one pass over the rows."""
    from tessera.operators import models as L

    cells = L.gram_cells(fold_rows(spark, sf_dir), ["yr"], ["x"], "y")
    folds = cells.join(cells.select(F.col("yr").alias("held")), F.col("yr") != F.col("held"))
    return rounded(L.ridge_by_fold(folds, ["held"], ["x"], [0.001, 1.0, 500.0], l1_ratio=0.1), "b_0", "b_1")
