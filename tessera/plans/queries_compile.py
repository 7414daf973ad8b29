"""Compiled tables over the test tables: weather features, out-of-fold predictions, summaries, nested tuning (inventory D and F)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import compiles as C
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import windows as W
from tessera.operators import zonal as Z
from tessera.plans.queries_metrics import _PER_DATE, _RANKED, PAIRS_SQL, pairs, rounded
from tessera.plans.registry import query
from tessera.session import table

# --- weather features: cells are line numbers, variables the means of quantity and tax, units the return flags -------------

VARIABLES = ["q", "t"]


def _weather_sql(weights: str, days: str, targets: str) -> str:
    """The chain in SQL; the three conditions cut the years of weights, daily values and targets."""
    over = ", ".join(f"w{n} AS (PARTITION BY unit ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (1, 3, 7))
    means = ", ".join(f"CASE WHEN count({v}) OVER w{n} = {n} THEN avg({v}) OVER w{n} END AS {v}_mean_{n}d" for n in (1, 3, 7) for v in VARIABLES)
    days_n = ", ".join(f"count(a) OVER w{n} AS days_{n}" for n in (1, 3, 7))
    return f"""
    d AS (SELECT l_linenumber AS cell, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS q, avg(l_tax) AS t FROM lineitem WHERE {days} GROUP BY 1, 2),
    w AS (SELECT l_returnflag AS unit, l_linenumber AS cell, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS weight FROM lineitem WHERE l_linenumber <= 3 AND {weights} GROUP BY 1, 2),
    g AS (SELECT w.unit, w.cell, w.weight, x.day FROM w, (SELECT DISTINCT day FROM d) x),
    u AS (SELECT unit, g.day, CASE WHEN count(q) = count(*) THEN sum(q * weight) END AS q, CASE WHEN count(t) = count(*) THEN sum(t * weight) END AS t FROM g LEFT JOIN d ON g.cell = d.cell AND g.day = d.day GROUP BY 1, 2),
    k AS (SELECT f.unit, o.day FROM (SELECT DISTINCT l_returnflag AS unit FROM lineitem) f, (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE {targets}) o),
    s AS (SELECT unit, day, q, t, CASE WHEN q IS NOT NULL AND t IS NOT NULL THEN 1 END AS a, false AS key FROM u UNION ALL SELECT unit, day, NULL, NULL, NULL, true FROM k),
    f AS (SELECT *, {means}, {days_n} FROM s WINDOW {over}),
    features AS (SELECT * FROM f WHERE key)"""


_SHOWN = ", ".join(f"round({v}_mean_{n}d, 6) AS {v}_mean_{n}d" for n in (1, 3, 7) for v in VARIABLES) + ", " + ", ".join(f"days_{n}, days_{n} = {n} AS complete_{n}" for n in (1, 3, 7))


def weather(spark: SparkSession, sf_dir: str, weights: str = "true", days: str = "true", targets: str = "true") -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    daily = li.where(days).groupBy(F.col("l_linenumber").alias("cell"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"))
    cells = daily.select("cell", "day", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in VARIABLES])).alias("x")).select("cell", "day", "x.*")
    w = Z.cell_weights(li.where("l_linenumber <= 3").where(weights).select(F.col("l_returnflag").alias("unit"), F.col("l_linenumber").alias("cell")), "unit", "cell", 900.0)
    keys = table(spark, sf_dir, "orders").where(targets).select(F.to_date("o_orderdate").alias("day")).distinct().crossJoin(li.select(F.col("l_returnflag").alias("unit")).distinct())
    return C.weather_features(cells, w, keys, "unit", "cell", "day", "variable", "value", VARIABLES)


def _shown(features: DataFrame) -> DataFrame:
    """Means to six digits. A sum's last bit depends on the order of its rows, so thirteen digits come first: a mean halfway between two values goes up in any order."""
    means = [f"{v}_mean_{n}d" for n in (1, 3, 7) for v in VARIABLES]
    return rounded(rounded(features, *means, digits=13), *means)


@query("d50_weather_features", f"WITH {_weather_sql('true', 'true', 'true')} SELECT unit, day, {_SHOWN} FROM features")
def d50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of two variables to unit days to complete trailing windows at every target."""
    return _shown(weather(spark, sf_dir))


@query("d50_weather_audit", f'WITH {_weather_sql("true", "true", "true")} ' + " UNION ALL ".join(f'SELECT CAST({n} AS BIGINT) AS "window", count(*) AS targets, count(*) FILTER (days_{n} = {n}) AS complete, count(*) - count(*) FILTER (days_{n} = {n}) AS incomplete, min(days_{n}) AS least_days FROM features' for n in (1, 3, 7)))
def d50_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.feature_audit(weather(spark, sf_dir))


_HELD = ("year(l_shipdate) < 2000", "year(l_shipdate) = 2000", "year(o_orderdate) = 2000")


@query("d51_frozen_weather_features", f"WITH {_weather_sql(*_HELD)} SELECT unit, day, {_SHOWN} FROM features")
def d51(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out year's features under weights frozen from the years before."""
    return _shown(weather(spark, sf_dir, *_HELD))


# --- out-of-fold predictions: two families of folds, two models ---------------------------------------------------------

_FRAGMENTS = f"""{PAIRS_SQL.replace('l_returnflag AS family, ', '').replace('pairs AS', 'lines AS')},
    clean AS (SELECT f.family, CASE f.family WHEN 'temporal' THEN yr ELSE l_suppkey % 5 END AS fold, m.model, 'c1' AS candidate, l_orderkey, l_linenumber, day, y, CASE m.model WHEN 'line' THEN p ELSE l_quantity * 1500 END AS p
      FROM lines, (SELECT unnest(['temporal', 'spatial']) AS family) f, (SELECT unnest(['line', 'flat']) AS model) m)"""


def fragments(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """Predictions of two models in the folds of two families; with `by`, lines are dealt out by these keys before each stands there four times."""
    lines = pairs(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "yr", "day", "y", "p")
    rows = (lines.repartition(*by) if by else lines).withColumn("flat", F.col("l_quantity") * 1500)
    parts = [F.struct(F.lit(f).alias("family"), fold.cast("long").alias("fold"), F.lit(m).alias("model"), F.col(p).alias("p")) for f, fold in (("temporal", F.col("yr")), ("spatial", F.col("l_suppkey") % 5)) for m, p in (("line", "p"), ("flat", "flat"))]
    return rows.select("l_orderkey", "l_linenumber", "day", "y", F.explode(F.array(*parts)).alias("x")).select("x.family", "x.fold", "x.model", F.lit("c1").alias("candidate"), "l_orderkey", "l_linenumber", "day", "y", "x.p")


@query(
    "d52_oof_violations",
    f"""
    WITH {_FRAGMENTS}
    SELECT DISTINCT family, fold, model, l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'missing' ELSE 'truth' END AS problem FROM clean WHERE l_orderkey % 5 = 0 AND l_linenumber IN (6, 7)
    UNION ALL SELECT DISTINCT family, fold, model, NULL, NULL, 'candidates' FROM clean WHERE family = 'spatial' AND fold = 3 AND model = 'flat'
    """,
)
def d52_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: rows left out, truths moved, and one fold with two candidates."""
    # line numbers repeat within an order here; a fragment has a key once
    whole = fragments(spark, sf_dir, ("l_orderkey", "l_linenumber")).groupBy("family", "fold", "model", "candidate", "l_orderkey", "l_linenumber").agg(F.min("y").alias("y"), F.min("p").alias("p"))
    mark = F.col("l_orderkey") % 5 == 0
    bad = whole.where(~(mark & (F.col("l_linenumber") == 7))).withColumn("y", F.when(mark & (F.col("l_linenumber") == 6), F.col("y") + 1).otherwise(F.col("y")))
    two = (F.col("family") == "spatial") & (F.col("fold") == 3) & (F.col("model") == "flat")
    bad = bad.withColumn("candidate", F.when(two & (F.col("l_linenumber") == 1), "c2").otherwise(F.col("candidate")))
    expected = whole.where("model = 'line'").select("family", "fold", "l_orderkey", "l_linenumber", "y")
    return C.oof_violations(bad, expected, ["l_orderkey", "l_linenumber"], "y")


@query("d52_oof_folds", f"WITH {_FRAGMENTS} SELECT family, fold, model, min(candidate) AS candidate, count(*) AS n, count(DISTINCT day) AS dates, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(p - y), 4) AS bias FROM clean GROUP BY 1, 2, 3")
def d52_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.oof_tables(fragments(spark, sf_dir), "day", "y", "p")["folds"], "mae", "rmse", "bias", digits=4)


_SUMMARY = "count(*) AS dates, CAST(sum(n) AS BIGINT) AS rows, round(avg(mae), 4) AS mae, round(avg(bias), 4) AS bias, round(avg(rmse), 4) AS macro_rmse, round(median(rho), 4) AS median_rho, count(rho) AS rho_dates"
_BY_MODEL = f"{_FRAGMENTS}, pairs AS (SELECT * FROM clean), {_RANKED.format(k='family, model, ')}, {_PER_DATE.format(k='family, model, ')}"


@query("d52_oof_summary", f"WITH {_BY_MODEL} SELECT family, model, {_SUMMARY} FROM per_date GROUP BY 1, 2")
def d52_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.oof_tables(fragments(spark, sf_dir), "day", "y", "p")["summary"]
    return rounded(got, "mae", "bias", "macro_rmse", "median_rho", digits=4).select("family", "model", "dates", "rows", "mae", "bias", "macro_rmse", "median_rho", "rho_dates")


# --- summaries ----------------------------------------------------------------------------------------------------------

_STORES = f"{PAIRS_SQL.replace('l_returnflag AS family, ', 'l_suppkey % 40 AS store, l_linestatus AS sensor, ')}"


def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return lines.select((F.col("l_suppkey") % 40).alias("store"), F.col("l_linestatus").alias("sensor"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))


@query(
    "d23_date_metric_summary",
    f"WITH {_STORES}, {_RANKED.format(k='store, ')}, {_PER_DATE.format(k='store, ')} SELECT store, count(*) AS dates, round(avg(mae), 4) AS mae_mean, round(median(mae), 4) AS mae_median, round(avg(rmse), 4) AS rmse_mean, round(median(rmse), 4) AS rmse_median, round(median(rho), 6) AS rho_median, count(rho) AS rho_defined, count(*) - count(rho) AS rho_undefined FROM per_date GROUP BY 1",
)
def d23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and medians over dates; most of a store's dates have too few rows for a rank correlation."""
    per = M.date_metrics(store_rows(spark, sf_dir), ["store"], "day", "y", "p")
    return rounded(rounded(C.summarise_dates(per, ["store"], ["mae", "rmse"]), "mae_mean", "mae_median", "rmse_mean", "rmse_median", digits=4), "rho_median")


_PER_SENSOR = f"{_STORES}, per AS (SELECT day, sensor, count(*) AS n, avg(abs(p - y)) AS mae, avg(p - y) AS bias, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY day) AS share FROM pairs GROUP BY 1, 2)"


@query("d47_sensor_per_date", f"WITH {_PER_SENSOR} SELECT day, sensor, n, round(mae, 6) AS mae, round(bias, 6) AS bias, round(share, 6) AS share FROM per")
def d47_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.sensor_tables(store_rows(spark, sf_dir), "sensor", "day", "y", "p")[0], "mae", "bias", "share")


@query("d47_sensor_summary", f"WITH {_PER_SENSOR} SELECT sensor, count(*) AS dates, CAST(sum(n) AS BIGINT) AS rows, round(avg(mae), 4) AS mae, round(avg(bias), 4) AS bias, count(*) FILTER (share = 1) AS dates_alone FROM per GROUP BY 1")
def d47_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.sensor_tables(store_rows(spark, sf_dir), "sensor", "day", "y", "p")[1], "mae", "bias", digits=4)


@query("d49_one_model_metrics", f"WITH {_STORES}, {_RANKED.format(k='store, ')}, {_PER_DATE.format(k='store, ')} SELECT store, CAST(sum(n) AS BIGINT) AS rows, count(*) AS dates, round(avg(mae), 4) AS mae, round(avg(rmse), 4) AS macro_rmse, round(avg(bias), 4) AS bias, round(median(rho), 6) AS median_rho, count(rho) AS rho_dates, count(*) - count(rho) AS rho_undefined FROM per_date GROUP BY 1")
def d49(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(C.one_model_metrics(store_rows(spark, sf_dir), "day", "y", "p", ["store"]), "mae", "macro_rmse", "bias", digits=4), "median_rho")


# --- nested tuning by one feature, which SQL can follow ------------------------------------------------------------------

_ROWS = "r AS (SELECT l_orderkey, l_linenumber, year(l_shipdate) AS yr, CAST(l_shipdate AS DATE) AS day, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), years AS (SELECT DISTINCT yr FROM r)"
_ALPHAS = [0.0, 1000.0, 100000.0]
_FIT = "avg(y) - covar_pop(y, x) / (var_pop(x) * (1 + a.alpha / count(*))) * avg(x) AS b0, covar_pop(y, x) / (var_pop(x) * (1 + a.alpha / count(*))) AS b1"
_NESTED = f"""{_ROWS}, a AS (SELECT unnest({_ALPHAS}) AS alpha),
    inner_fit AS (SELECT h.yr AS held, v.yr AS inner_year, a.alpha, {_FIT} FROM years h JOIN years v ON h.yr <> v.yr JOIN r ON r.yr <> h.yr AND r.yr <> v.yr, a GROUP BY 1, 2, 3),
    inner_date AS (SELECT held, inner_year, alpha, day, avg(abs(b0 + b1 * x - y)) AS mae FROM inner_fit JOIN r ON r.yr = inner_year GROUP BY 1, 2, 3, 4),
    scores AS (SELECT held, inner_year, alpha, count(*) AS dates, avg(mae) AS mae FROM inner_date GROUP BY 1, 2, 3),
    means AS (SELECT held, alpha, avg(mae) AS mean_score, min(avg(mae)) OVER (PARTITION BY held) AS best FROM scores GROUP BY 1, 2),
    chosen AS (SELECT held, max(alpha) AS alpha FROM means WHERE mean_score <= best + 1e-9 + 0.001 * abs(best) GROUP BY 1)"""


def tuning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.year("l_shipdate").cast("long").alias("yr"), F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def inner_scores(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram cells by year, scores (held, inner_year, alpha, dates, mae)): every inner year scored by date, under fits on the years that are neither."""
    cells = L.gram_cells(rows, ["yr"], ["x"], "y")
    years = cells.select("yr")
    folds = years.select(F.col("yr").alias("held")).join(years.select(F.col("yr").alias("inner_year")), F.col("held") != F.col("inner_year"))
    fits = L.ridge_by_fold(cells.join(folds, (F.col("yr") != F.col("held")) & (F.col("yr") != F.col("inner_year"))), ["held", "inner_year"], ["x"], _ALPHAS)
    return cells, L.date_scores(rows, fits.withColumnRenamed("inner_year", "yr"), ["yr"], ["held", "alpha"], ["x"], "y", "day").withColumnRenamed("yr", "inner_year")


@query("f22_inner_scores_by_date", f"WITH {_NESTED} SELECT held, inner_year, CAST(alpha AS DOUBLE) AS alpha, dates, round(mae, 6) AS mae FROM scores")
def f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inner_scores(tuning_rows(spark, sf_dir))[1], "mae")


@query("f23_nested_predictions", f"WITH {_NESTED}, outer_fit AS (SELECT c.held, a.alpha, {_FIT} FROM chosen c JOIN a ON a.alpha = c.alpha JOIN r ON r.yr <> c.held GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, held AS yr, CAST(alpha AS DOUBLE) AS alpha, round(y, 6) AS y, round(b0 + b1 * x, 6) AS pred FROM outer_fit JOIN r ON r.yr = held")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year predicted by the candidate that its own inner years chose, refitted on all other years. The larger penalty is the simpler model."""
    rows = tuning_rows(spark, sf_dir)
    cells, scores = inner_scores(rows)
    scores = scores.withColumn("complexity", -F.col("alpha"))
    chosen = W.select_candidate(scores, ["held"], "alpha", "complexity", "mae", 1e-9, 0.001).select("held", "alpha")
    fits = L.ridge_by_fold(cells.join(chosen.select("held"), F.col("yr") != F.col("held")), ["held"], ["x"], _ALPHAS).join(chosen, ["held", "alpha"]).withColumnRenamed("held", "yr")
    return rounded(L.linear_predictions(rows, fits, ["yr"], ["x"]).select("l_orderkey", "l_linenumber", "yr", "alpha", "y", "pred"), "y", "pred")


@query("f20_date_weighted_fit", f"WITH {_ROWS}, n AS (SELECT *, count(*) OVER (PARTITION BY day) AS nd FROM r), t AS (SELECT count(*) AS n, count(DISTINCT day) AS d FROM r), w AS (SELECT x, y, CAST(t.n AS DOUBLE) / (t.d * nd) AS w FROM n, t), s AS (SELECT sum(w) AS w, sum(w * x) AS wx, sum(w * y) AS wy, sum(w * x * x) AS wxx, sum(w * x * y) AS wxy FROM w) SELECT 'all' AS fold, round((wy - (w * wxy - wx * wy) / (w * wxx - wx * wx) * wx) / w, 6) AS b_0, round((w * wxy - wx * wy) / (w * wxx - wx * wx), 6) AS b_1 FROM s")
def f20_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares in which all dates weigh alike."""
    rows = M.date_balanced_weights(tuning_rows(spark, sf_dir), "day")
    cells = L.gram_cells(rows, ["yr"], ["x"], "y", weight="weight").withColumn("fold", F.lit("all"))
    return rounded(L.ridge_by_fold(cells, ["fold"], ["x"], [0.0]).drop("alpha"), "b_0", "b_1")


@query("f20_date_mean_baseline", f"WITH {_ROWS}, d AS (SELECT day, yr, avg(x) AS x, avg(y) AS y FROM r GROUP BY 1, 2) SELECT h.yr AS held, round(regr_intercept(y, x), 6) AS b_0, round(regr_slope(y, x), 6) AS b_1 FROM d JOIN years h ON d.yr <> h.yr GROUP BY 1")
def f20_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline fits one row a date: its means."""
    dates = tuning_rows(spark, sf_dir).groupBy("yr", "day").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    cells = L.gram_cells(dates, ["yr"], ["x"], "y")
    cells = cells.join(cells.select(F.col("yr").alias("held")), F.col("yr") != F.col("held"))
    return rounded(L.ridge_by_fold(cells, ["held"], ["x"], [0.0]).drop("alpha"), "b_0", "b_1")
