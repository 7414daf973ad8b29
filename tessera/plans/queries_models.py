"""Models over the test tables (inventory F, second half)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import models as M
from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").cast("long").alias("yr"), F.to_date("l_shipdate").alias("day"), *FEATURES, (F.col("l_extendedprice") / 1000).alias("y"))


def fold_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gram cells by year, joined to the years that hold them out: leave-one-year-out needs one pass."""
    cells = M.gram_cells(rows(spark, sf_dir), ["yr"], FEATURES, "y")
    return cells.join(cells.select(F.col("yr").alias("held")), F.col("yr") != F.col("held"))


@query("f16_impute_medians", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, year(l_shipdate) AS yr, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q FROM lineitem), m AS (SELECT median(q) AS m FROM r WHERE yr < 1999) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(q, m) AS q FROM r, m")
def f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").alias("yr"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"))
    return M.impute_medians(r.where("yr < 1999"), r, ["q"]).drop("yr")


@query("f16_impute_many", "WITH r AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS yr, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS p, CASE WHEN l_tax > 0.01 THEN l_tax END AS t FROM lineitem), m AS (SELECT median(q) AS mq, median(p) AS mp, median(t) AS mt FROM r WHERE yr < 1999) SELECT l_orderkey, l_linenumber, round(coalesce(q, mq), 6) AS q, round(coalesce(p, mp), 6) AS p, round(coalesce(t, mt), 6) AS t FROM r, m")
def f16_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns at once, one job a round for all of them."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("yr"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("p"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("t"))
    return rounded(M.impute_medians(r.where("yr < 1999"), r, ["q", "p", "t"]).drop("yr"), "q", "p", "t")


@query("f17_completeness", 'SELECT unnest([\'q\', \'t\']) AS "column", unnest([count(*) FILTER (l_linenumber = 2), count(*) FILTER (l_tax = 0)]) AS bad FROM lineitem')
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("t"))
    return M.incomplete(r, ["q", "t"])


@query("f20_least_squares_one_feature", "SELECT h.held, round(regr_intercept(y, q), 6) AS b_0, round(regr_slope(y, q), 6) AS b_1 FROM (SELECT year(l_shipdate) AS yr, l_quantity AS q, l_extendedprice / 1000 AS y FROM lineitem), (SELECT DISTINCT year(l_shipdate) AS held FROM lineitem) h WHERE yr <> h.held GROUP BY 1")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = M.gram_cells(rows(spark, sf_dir), ["yr"], ["l_quantity"], "y")
    cells = cells.join(cells.select(F.col("yr").alias("held")), F.col("yr") != F.col("held"))
    return rounded(M.ridge_by_fold(cells, ["held"], ["l_quantity"], [0.0]).drop("alpha"), "b_0", "b_1")


@query("f22_f24_year_out_tuning")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner scores of every held year and penalty: fitted from sums, scored by an aggregate."""
    fits = M.ridge_by_fold(fold_cells(spark, sf_dir), ["held"], FEATURES, [0.0, 1.0, 100.0, 10000.0]).withColumnRenamed("held", "yr")
    scored = M.linear_predictions(rows(spark, sf_dir), fits, ["yr"], FEATURES)
    return scored.groupBy("yr", "alpha").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("y"))), 6).alias("mae"))


@query("f23_out_of_fold_predictions")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = M.ridge_by_fold(fold_cells(spark, sf_dir), ["held"], FEATURES, [1.0]).withColumnRenamed("held", "yr")
    return rounded(M.linear_predictions(rows(spark, sf_dir), fits, ["yr"], FEATURES).select("l_orderkey", "l_linenumber", "yr", "y", "pred"), "pred")


#: The registry of features: families are left out whole.
FAMILIES = {"size": ["l_quantity"], "terms": ["l_discount", "l_tax"]}


@query("f25_feature_ablation")
def f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refits without each feature family in turn, all from one set of sums; held-out years scored by date."""
    data = rows(spark, sf_dir)
    cells, out = fold_cells(spark, sf_dir), None
    for left_out in ["none", *FAMILIES]:
        part, names = M.without_features(cells, FEATURES, FAMILIES.get(left_out, []))
        fits = M.ridge_by_fold(part, ["held"], names, [1.0])
        at = {"b_0": F.col("b_0")} | {f"b_{FEATURES.index(f) + 1}": F.col(f"b_{i}") for i, f in enumerate(names, 1)}
        fits = fits.select(F.col("held").alias("yr"), F.lit(left_out).alias("left_out"), *[at.get(f"b_{i}", F.lit(0.0)).alias(f"b_{i}") for i in range(len(FEATURES) + 1)])
        out = fits if out is None else out.unionByName(fits)
    scores = M.date_scores(data, out, ["yr"], ["left_out"], FEATURES, "y", "day")
    return scores.groupBy("left_out").agg(F.sum("dates").alias("dates"), F.round(F.sum(F.col("mae") * F.col("dates")) / F.sum("dates"), 6).alias("mae"))


@query("f18_f19_f21_model_pipelines")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of model fitted on early years and scored on the last ones."""
    data = rows(spark, sf_dir)
    train, test = data.where("yr < 2000"), data.where("yr >= 2000")
    out = None
    for kind, settings in (("ols", {}), ("ridge", {"alpha": 0.1}), ("elastic", {"alpha": 0.05}), ("boosted", {"maxIter": 20, "maxDepth": 3})):
        fitted = M.make_model(kind, FEATURES, "y", **settings).fit(train)
        part = fitted.transform(test).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("pred") - F.col("y"))), 4).alias("mae")).select(F.lit(kind).alias("kind"), "n", "mae")
        out = part if out is None else out.unionByName(part)
    return out


@query("f19_boosted_trees")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees under absolute loss with dates weighing alike, fitted on early years and scored by date on the last ones. Each round is about ten short jobs, so the
    registered query takes 5 of the 300 rounds that the operator defaults to."""
    from tessera.functions.scalars import finite
    from tessera.operators import boosting as B
    from tessera.operators import metrics as E

    data = rows(spark, sf_dir)
    train = E.date_balanced_weights(data.where("yr < 2000"), "day")
    model = B.fit_boosted(train, FEATURES, "y", "weight", rounds=5, learning_rate=0.3)
    scored = B.predict_boosted(data.where("yr >= 2000"), model)
    by_date = scored.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("pred"))).alias("bad"), F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae"))
    return by_date.agg(F.count(F.lit(1)).alias("dates"), F.sum("n").alias("n"), F.sum("bad").alias("not_finite"), F.round(F.avg("mae"), 4).alias("mae"))
