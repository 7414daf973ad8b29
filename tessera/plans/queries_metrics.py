"""Zonal aggregates, composites, metrics and cohorts over the test tables (inventory D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import zonal as Z
from tessera.plans.registry import query
from tessera.session import table

# truth and prediction by line: keyed by order and line, dated by ship date, in blocks by supplier
PAIRS_SQL = "pairs AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag AS family, CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS yr, l_extendedprice AS y, l_quantity * p_retailprice AS p, l_discount, l_tax, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    j = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_returnflag").alias("family"), F.to_date("l_shipdate").alias("day"), F.year("l_shipdate").cast("long").alias("yr"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"), "l_discount", "l_tax", "l_quantity")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "d01_zonal_target",
    """
    WITH px AS (SELECT l_returnflag AS grp, s_nationkey AS unit, l_quantity AS v, l_linenumber <> 3 AS ok, l_tax < 0.07 AS el FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    a AS (SELECT grp, unit, count(*) AS raster, count(*) FILTER (el) AS eligible, count(*) FILTER (ok) AS valid, median(v) FILTER (ok) AS median, avg(v) FILTER (ok) AS mean, stddev_samp(v) FILTER (ok) AS std, quantile_cont(v, 0.1) FILTER (ok) AS p10, quantile_cont(v, 0.9) FILTER (ok) AS p90 FROM px GROUP BY 1, 2),
    g AS (SELECT grp, n_nationkey AS unit FROM (SELECT DISTINCT grp FROM px), nation),
    j AS (SELECT g.grp, g.unit, coalesce(raster, 0) AS raster, coalesce(eligible, 0) AS eligible, coalesce(valid, 0) AS valid, median, mean, std, p10, p90 FROM g LEFT JOIN a USING (grp, unit)),
    r AS (SELECT *, CASE WHEN eligible > 0 THEN valid / CAST(eligible AS DOUBLE) END AS share, CASE WHEN raster = 0 THEN 'no_footprint' WHEN eligible = 0 THEN 'no_eligible' WHEN valid < 20 THEN 'few_pixels' WHEN valid / CAST(eligible AS DOUBLE) < 1.05 THEN 'low_share' END AS reason FROM j)
    SELECT grp, unit, raster, eligible, valid, round(share, 6) AS share, reason, reason IS NULL AS available, round(CASE WHEN reason IS NULL THEN median END, 6) AS median, round(CASE WHEN reason IS NULL THEN mean END, 6) AS mean, round(CASE WHEN reason IS NULL THEN std END, 6) AS std, round(CASE WHEN reason IS NULL THEN p10 END, 6) AS p10, round(CASE WHEN reason IS NULL THEN p90 END, 6) AS p90 FROM r
    """,
)
def d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("unit"))
    px = table(spark, sf_dir, "lineitem").join(sup, "l_suppkey").select(F.col("l_returnflag").alias("grp"), "unit", F.col("l_quantity").alias("v"), (F.col("l_linenumber") != 3).alias("ok"), (F.col("l_tax") < 0.07).alias("el"))
    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"))
    return rounded(Z.zonal_target(px, units, ["grp"], "unit", "v", "ok", F.col("el"), 1.05, 20), "share", "median", "mean", "std", "p10", "p90")


@query(
    "d02_threshold_sweep",
    """
    WITH t AS (SELECT unnest([NULL, 0.02, 0.05]) AS u), d AS (SELECT unnest([0.0, 0.04]) AS d)
    SELECT l_returnflag, u AS uncertainty_k, CAST(d AS DOUBLE) AS distance_km, count(*) AS n, count(*) FILTER (l_tax >= d AND (u IS NULL OR l_discount <= u)) AS kept, round(count(*) FILTER (l_tax >= d AND (u IS NULL OR l_discount <= u)) / CAST(count(*) AS DOUBLE), 6) AS share
    FROM lineitem, t, d GROUP BY 1, 2, 3
    """,
)
def d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.threshold_sweep(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_tax", [None, 0.02, 0.05], [0.0, 0.04]), "share")


@query(
    "d03_relative_gate",
    """
    WITH u AS (SELECT CAST(l_shipdate AS DATE) AS day, year(l_shipdate) AS yr, l_linenumber % 2 AS block, l_suppkey % 4 AS lat, l_partkey % 4 AS lon, CASE WHEN l_tax < 0.07 THEN l_quantity END AS v FROM lineitem),
    s AS (SELECT yr, count(*) AS n, count(v) AS kept FROM u GROUP BY 1),
    b AS (SELECT yr, max(r) - min(r) AS g FROM (SELECT yr, block, count(v) / CAST(count(*) AS DOUBLE) AS r FROM u GROUP BY 1, 2) GROUP BY 1),
    la AS (SELECT yr, max(r) - min(r) AS g FROM (SELECT yr, lat, count(v) / CAST(count(*) AS DOUBLE) AS r FROM u GROUP BY 1, 2) GROUP BY 1),
    lo AS (SELECT yr, max(r) - min(r) AS g FROM (SELECT yr, lon, count(v) / CAST(count(*) AS DOUBLE) AS r FROM u GROUP BY 1, 2) GROUP BY 1)
    SELECT yr, n, kept, round(kept / CAST(n AS DOUBLE), 6) AS share, round(b.g, 6) AS block_gap, round(la.g, 6) AS lat_gap, round(lo.g, 6) AS lon_gap, kept / CAST(n AS DOUBLE) >= 0.7 AND greatest(b.g, la.g, lo.g) <= 0.02 AS passes FROM s JOIN b USING (yr) JOIN la USING (yr) JOIN lo USING (yr)
    """,
)
def d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("yr"), (F.col("l_linenumber") % 2).alias("block"), (F.col("l_suppkey") % 4).alias("lat"), (F.col("l_partkey") % 4).alias("lon"), F.when(F.col("l_tax") < 0.07, F.col("l_quantity")).alias("v"))
    return rounded(Z.relative_gate(u, "yr", "v", "block", "lat", "lon", 0.7, 0.02), "share", "block_gap", "lat_gap", "lon_gap")


@query(
    "d04_d05_static_zonal",
    """
    SELECT p_brand, count(*) AS cells, round(count(*) FILTER (p_size IN (11, 12)) / CAST(count(*) AS DOUBLE), 6) AS share_water, round(count(*) FILTER (p_size IN (21, 22, 23)) / CAST(count(*) AS DOUBLE), 6) AS share_built,
      round(avg(p_retailprice), 6) AS p_retailprice_mean, round(quantile_cont(p_retailprice, 0.1), 6) AS p_retailprice_p10, round(quantile_cont(p_retailprice, 0.9), 6) AS p_retailprice_p90, round(stddev_pop(p_retailprice), 6) AS p_retailprice_std, CAST(1 AS DOUBLE) AS p_retailprice_coverage, round(count(*) FILTER (p_retailprice >= 1400) / CAST(count(*) AS DOUBLE), 6) AS p_retailprice_high FROM part GROUP BY 1
    """,
)
def d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Z.static_zonal(table(spark, sf_dir, "part"), "p_brand", "p_size", {"water": [11, 12], "built": [21, 22, 23]}, ["p_retailprice"], 1400)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


@query(
    "d06_d07_weighted_median",
    """
    WITH c AS (SELECT l_suppkey, l_extendedprice AS v, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice ROWS UNBOUNDED PRECEDING) AS cw, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS tw FROM lineitem)
    SELECT l_suppkey, min(v) FILTER (cw >= tw / 2) AS median, round(sum(w), 6) AS area FROM c GROUP BY 1
    """,
)
def d06(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    area = df.groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 6).alias("area"))
    return Z.weighted_median(df, ["l_suppkey"], "l_extendedprice", "l_quantity").join(area, "l_suppkey")


@query("d08_coarse_grid", "SELECT CAST(floor(p_size / 10.0) AS BIGINT) AS cx, CAST(floor(p_retailprice / 10.0 / 10.0) AS BIGINT) AS cy, round(avg(p_retailprice) FILTER (p_partkey % 3 <> 0), 6) AS mean, round(avg(CASE WHEN p_partkey % 3 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS valid_share FROM part GROUP BY 1, 2")
def d08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.coarse_cells(table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_retailprice") / 10.0, 10.0, "p_retailprice", F.col("p_partkey") % 3 != 0), "mean", "valid_share")


_D09 = """
    WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    a AS (SELECT CAST(l_shipdate AS DATE) AS acq, l_suppkey % 10 AS unit, avg(l_tax) * 20 AS coverage, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    j AS (SELECT t.day, unit, a.coverage, v, date_diff('day', acq, t.day) AS lag FROM t JOIN a ON date_diff('day', acq, t.day) BETWEEN 1 AND 60),
    f AS (SELECT day, unit, count(*) AS candidates, count(*) FILTER (coverage >= 0.8037) AS qualifying, min(lag) FILTER (coverage >= 0.8037) AS least_lag, max(lag) FILTER (coverage >= 0.8037) AS most_lag, median(v) FILTER (coverage >= 0.8037) AS v FROM j GROUP BY 1, 2)
    SELECT t.day, k.unit, coalesce(candidates, 0) AS candidates, coalesce(qualifying, 0) AS qualifying, CASE WHEN qualifying >= 3 THEN round(v, 6) END AS v FROM t CROSS JOIN (SELECT DISTINCT unit FROM a) k LEFT JOIN f ON f.day = t.day AND f.unit = k.unit
    """


@query("d09_d10_trailing_composite", _D09)
def d09(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.joins import lag_membership

    targets = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    acquired = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("acq"), (F.col("l_suppkey") % 10).alias("unit")).agg((F.avg("l_tax") * 20).alias("coverage"), F.avg("l_quantity").alias("v"))
    membership = lag_membership(targets, acquired.select("acq").distinct(), "day", "acq", 1, 60)
    keys = targets.crossJoin(acquired.select("unit").distinct())
    return Z.trailing_composite(acquired, membership, keys, "day", "unit", "acq", "coverage", ["v"], 0.8037, 3).select("day", "unit", "candidates", "qualifying", F.round("v", 6).alias("v"))


@query(
    "d11_d12_cell_weights",
    """
    WITH c AS (SELECT l_suppkey AS unit, l_linenumber AS cell, count(*) AS pixels FROM lineitem GROUP BY 1, 2)
    SELECT unit, CAST(cell AS BIGINT) AS cell, pixels, pixels * 900.0 AS area, sum(pixels * 900.0) OVER (PARTITION BY unit) AS denominator, round(pixels * 900.0 / sum(pixels * 900.0) OVER (PARTITION BY unit), 9) AS weight, false AS bad FROM c
    """,
)
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Z.cell_weights(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").cast("long").alias("cell")), "unit", "cell", 900.0)
    bad = Z.weight_violations(w, "unit", "cell").select("unit", F.lit(True).alias("bad"))
    return w.join(bad, "unit", "left").select("unit", "cell", "pixels", "area", "denominator", F.round("weight", 9).alias("weight"), F.coalesce("bad", F.lit(False)).alias("bad"))


@query(
    "d13_d14_weighted_mean",
    """
    WITH d AS (SELECT l_linenumber AS cell, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
    w AS (SELECT l_returnflag AS unit, l_linenumber AS cell, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS weight FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
    g AS (SELECT w.unit, w.cell, w.weight, x.day FROM w, (SELECT DISTINCT day FROM d) x)
    SELECT unit, g.day, count(*) AS expected, round(CASE WHEN count(v) = count(*) THEN sum(v * weight) END, 6) AS v, count(v) AS v_present FROM g LEFT JOIN d ON g.cell = d.cell AND g.day = d.day GROUP BY 1, 2
    """,
)
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(F.col("l_linenumber").alias("cell"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("v"))
    weights = Z.cell_weights(li.where("l_linenumber <= 4").select(F.col("l_returnflag").alias("unit"), F.col("l_linenumber").alias("cell")), "unit", "cell", 1.0)
    return rounded(Z.weighted_mean(daily, weights, "cell", "unit", "day", ["v"]), "v")


@query("d15_coverage_report", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_tax < 0.05) AS available, count(*) - count(*) FILTER (l_tax < 0.05) AS missing, round(count(*) FILTER (l_tax < 0.05) / CAST(count(*) AS DOUBLE), 6) AS share, min(l_quantity) AS least, median(l_quantity) AS median, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Z.coverage_report(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_tax") < 0.05, "l_quantity"), "share")


@query("d16_feature_coverage", "SELECT feature, count(*) AS n, count(v) AS present, count(*) - count(v) AS missing, round(count(v) / CAST(count(*) AS DOUBLE), 6) AS share FROM (SELECT unnest(['q', 't']) AS feature, unnest([CASE WHEN l_linenumber <> 2 THEN l_quantity END, CASE WHEN l_tax > 0.01 THEN l_tax END]) AS v FROM lineitem) GROUP BY 1")
def d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("t"))
    return rounded(M.missingness(df, ["q", "t"]), "share")


_RANKED = "ranked AS (SELECT *, p - y AS e, (p - y) - avg(p - y) OVER (PARTITION BY {k}day) AS a, rank() OVER (PARTITION BY {k}day ORDER BY y) + (count(*) OVER (PARTITION BY {k}day, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY {k}day ORDER BY p) + (count(*) OVER (PARTITION BY {k}day, p) - 1) / 2.0 AS rp FROM pairs)"
_PER_DATE = "per_date AS (SELECT {k}day, count(*) AS n, avg(abs(e)) AS mae, avg(e) AS bias, sqrt(avg(e * e)) AS rmse, avg(abs(a)) AS anomaly_mae, CASE WHEN min(ry) < max(ry) AND min(rp) < max(rp) THEN corr(ry, rp) END AS rho, sum(e * e) AS sse, sum(e) AS se, sum(y) AS st, sum(y * y) AS stt FROM ranked GROUP BY ALL)"
_MACRO = "count(*) AS dates, CAST(sum(n) AS BIGINT) AS rows, round(avg(mae), 4) AS mae, round(avg(bias), 4) AS bias, round(avg(rmse), 4) AS macro_rmse, round(avg(anomaly_mae), 4) AS anomaly_mae, round(median(rho), 4) AS median_rho, count(rho) AS rho_dates, round(sqrt(sum(sse) / sum(n)), 4) AS pooled_rmse, round(sum(se) / sum(n), 4) AS pooled_bias, round(1 - sum(sse) / (sum(stt) - sum(st) * sum(st) / sum(n)), 4) AS r2"
_MACRO_COLUMNS = ("mae", "bias", "macro_rmse", "anomaly_mae", "median_rho", "pooled_rmse", "pooled_bias", "r2")


@query("d17_date_macro_metrics", f"WITH {PAIRS_SQL}, {_RANKED.format(k='')}, {_PER_DATE.format(k='')} SELECT {_MACRO} FROM per_date")
def d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.macro_metrics(M.date_metrics(pairs(spark, sf_dir), [], "day", "y", "p"), []), *_MACRO_COLUMNS, digits=4)


@query("d18_d20_d27_metrics_by_group", f"WITH {PAIRS_SQL}, {_RANKED.format(k='family, ')}, {_PER_DATE.format(k='family, ')} SELECT family, {_MACRO} FROM per_date GROUP BY family")
def d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.macro_metrics(M.date_metrics(pairs(spark, sf_dir), ["family"], "day", "y", "p"), ["family"]), *_MACRO_COLUMNS, digits=4)


@query("d19_fold_metrics", f"WITH {PAIRS_SQL} SELECT family, yr AS fold, count(*) AS n, count(DISTINCT day) AS dates, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(p - y), 4) AS bias FROM pairs GROUP BY 1, 2")
def d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("p") - F.col("y")
    return rounded(pairs(spark, sf_dir).groupBy("family", F.col("yr").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("day").alias("dates"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")), "mae", "rmse", "bias", digits=4)


@query(
    "d21_stratum_metrics",
    f"WITH {PAIRS_SQL}, s AS (SELECT CASE WHEN l_tax > 0 AND l_discount > 0 THEN 'complete' WHEN l_tax = 0 AND l_discount = 0 THEN 'missing' ELSE 'partial' END AS stratum, day, avg(abs(p - y)) AS mae, count(*) AS n FROM pairs GROUP BY 1, 2) SELECT stratum, count(*) AS dates, CAST(sum(n) AS BIGINT) AS n, round(avg(mae), 4) AS mae FROM s GROUP BY 1",
)
def d21(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.when(F.col("l_tax") == 0, 1).otherwise(0) + F.when(F.col("l_discount") == 0, 1).otherwise(0)
    stratum = F.when(missing == 0, "complete").when(missing == 2, "missing").otherwise("partial")
    per_date = pairs(spark, sf_dir).groupBy(stratum.alias("stratum"), "day").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return per_date.groupBy("stratum").agg(F.count(F.lit(1)).alias("dates"), F.sum("n").alias("n"), F.round(F.avg("mae"), 4).alias("mae"))


@query(
    "d22_d46_hotspot_metrics",
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, sum(value) AS s, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 1 AS y FROM events GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s DESC, user_id) <= ceil(0.2 * count(*) OVER (PARTITION BY day)) AS top FROM d),
    c AS (SELECT day, count(*) FILTER (top) AS k, count(*) FILTER (top AND y) AS tp, count(*) FILTER (top AND NOT y) AS fp, count(*) FILTER (NOT top AND y) AS fn FROM t GROUP BY 1)
    SELECT day, k, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fn > 0 THEN CAST(fn AS DOUBLE) / (tp + fn) END, 6) AS miss_rate FROM c
    """,
)
def d22(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.sum("value").alias("s"), (F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)) == 1).alias("y"))
    return rounded(M.hotspot_metrics(d, ["day"], "y", "s", "user_id", 0.2), "precision", "recall", "miss_rate").drop("ap")


@query(
    "d24_d25_cohorts",
    f"""
    WITH {PAIRS_SQL}, m AS (SELECT *, 'all' AS dimension, 'all' AS label FROM pairs UNION ALL SELECT *, 'tax', 'low' FROM pairs WHERE l_tax <= 0.02 UNION ALL SELECT *, 'size', 'small' FROM pairs WHERE l_quantity < 10 UNION ALL SELECT *, 'size', 'large' FROM pairs WHERE l_quantity >= 40),
    d AS (SELECT dimension, label, day, avg(abs(p - y)) AS mae, count(*) AS n FROM m GROUP BY 1, 2, 3) SELECT dimension, label, count(*) AS dates, round(avg(mae), 4) AS mae, min(n) AS least, round(median(n), 4) AS median, max(n) AS most FROM d GROUP BY 1, 2
    """,
)
def d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    members = M.cohort_memberships(pairs(spark, sf_dir), [("all", "all", F.lit(True)), ("tax", "low", F.col("l_tax") <= 0.02), ("size", "small", q < 10), ("size", "large", q >= 40)])
    per_date = members.groupBy("dimension", "label", "day").agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))
    return per_date.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("dates"), F.round(F.avg("mae"), 4).alias("mae"), F.min("n").alias("least"), F.round(F.median("n"), 4).alias("median"), F.max("n").alias("most"))


@query(
    "d26_d45_improvement",
    f"WITH {PAIRS_SQL}, d AS (SELECT family, day, avg(abs(p - y)) AS b, avg(abs(l_quantity * 1500 - y)) AS t FROM pairs GROUP BY 1, 2), m AS (SELECT family, avg(b) AS b, avg(t) AS t FROM d GROUP BY 1) SELECT family, round(b, 4) AS baseline, round(t, 4) AS target, round(b - t, 4) AS absolute, round((b - t) / b, 6) AS relative FROM m",
)
def d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = M.unpivot_predictions(pairs(spark, sf_dir).withColumn("flat", F.col("l_quantity") * 1500), ["family", "day", "y"], {"line": "p", "flat": "flat"})
    per_date = long.groupBy("family", "model", "day").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae")).groupBy("family", "model").agg(F.avg("mae").alias("mae"))
    return rounded(rounded(M.improvement(per_date, ["family"], "model", "mae", "line", "flat"), "baseline", "target", "absolute", digits=4), "relative")


@query("d28_label_shift", "WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS w FROM events WHERE event_type <> 'view' GROUP BY 1, 2) SELECT day, count(*) AS matched, round(avg(w - v), 6) AS mean_shift, round(median(w - v), 6) AS median_shift, round(avg(abs(w - v)), 6) AS abs_shift, round(sqrt(avg((w - v) * (w - v))), 6) AS rms_shift FROM a JOIN b USING (user_id, day) GROUP BY 1")
def d28(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    # one pass: both versions of the label come from one aggregate
    both = ev.groupBy("user_id", "day").agg(F.avg("value").alias("v"), F.avg(F.when(F.col("event_type") != "view", F.col("value"))).alias("w")).where("w is not null")
    d = F.col("w") - F.col("v")
    return rounded(both.groupBy("day").agg(F.count(F.lit(1)).alias("matched"), F.avg(d).alias("mean_shift"), F.median(d).alias("median_shift"), F.avg(F.abs(d)).alias("abs_shift"), F.sqrt(F.avg(d * d)).alias("rms_shift")), "mean_shift", "median_shift", "abs_shift", "rms_shift")


@query("d29_d30_residual_cells", f"WITH {PAIRS_SQL} SELECT family, yr, l_suppkey % 8 AS block, count(*) AS n, round(avg(p - y), 7) AS mean_residual, round(avg(abs(p - y)), 7) AS mae, round(sqrt(avg((p - y) * (p - y))), 7) AS rmse, round(avg(y), 7) AS mean_truth, round(avg(p), 7) AS mean_prediction, count(DISTINCT day) AS dates FROM pairs GROUP BY 1, 2, 3")
def d29(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("p") - F.col("y")
    return rounded(pairs(spark, sf_dir).groupBy("family", "yr", (F.col("l_suppkey") % 8).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_residual"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("y").alias("mean_truth"), F.avg("p").alias("mean_prediction"), F.countDistinct("day").alias("dates")), "mean_residual", "mae", "rmse", "mean_truth", "mean_prediction", digits=7)


@query(
    "d32_d33_missingness_rollup",
    """
    WITH r AS (SELECT o_orderstatus AS day, CASE WHEN o_totalprice < 50000 THEN 'few' WHEN o_totalprice < 100000 THEN 'low' END AS reason FROM orders),
    c AS (SELECT day, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((day, reason), (reason))),
    t AS (SELECT day, count(*) AS n, count(reason) AS missing FROM r GROUP BY GROUPING SETS ((day), ()))
    SELECT coalesce(t.day, 'all') AS day, t.n, t.missing, '{' || string_agg('"' || c.reason || '":' || CAST(c.n AS VARCHAR), ',' ORDER BY c.reason) || '}' AS reasons FROM t JOIN c ON t.day IS NOT DISTINCT FROM c.day GROUP BY 1, 2, 3
    """,
)
def d32(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_totalprice") < 50000, "few").when(F.col("o_totalprice") < 100000, "low")
    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(F.col("o_orderstatus"), F.lit("all"))).alias("day"), reason.alias("reason"))
    totals = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("missing"))
    return totals.join(M.reason_counts(rows, ["day"], "reason"), "day")


@query("d34_zero_row_strata", "WITH g AS (SELECT * FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS flag), (SELECT unnest([1, 9]) AS line)) SELECT flag, CAST(line AS BIGINT) AS line, count(l_orderkey) AS n, round(avg(l_quantity), 6) AS mean FROM g LEFT JOIN lineitem ON l_returnflag = flag AND l_linenumber = line GROUP BY 1, 2")
def d34(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.lit(f) for f in "ANRX"])).alias("flag")).select("flag", F.explode(F.array(F.lit(1), F.lit(9))).alias("line"))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    return grid.join(found, ["flag", "line"], "left").select("flag", F.col("line").cast("long").alias("line"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


@query("d35_d36_source_rollup", "SELECT l_suppkey, count(*) AS items, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS platforms, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day FROM lineitem GROUP BY 1")
def d35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("items"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("platforms"), F.to_date(F.min("l_shipdate")).alias("first_day"), F.to_date(F.max("l_shipdate")).alias("last_day"))


@query("d37_d38_support_conservation", "SELECT p_brand, count(*) AS zone, count(*) FILTER (p_size <> 1) AS valid, count(*) FILTER (p_size <> 1 AND p_size NOT IN (11, 12)) AS eligible, count(*) FILTER (p_size IN (11, 12)) AS water, count(*) = count(*) FILTER (p_size = 1) + count(*) FILTER (p_size IN (11, 12)) + count(*) FILTER (p_size <> 1 AND p_size NOT IN (11, 12)) AS conserved FROM part GROUP BY 1")
def d37(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("zone"), F.count_if(s == 1).alias("nodata"), F.count_if(s != 1).alias("valid"), F.count_if((s != 1) & ~s.isin(11, 12)).alias("eligible"), F.count_if(s.isin(11, 12)).alias("water"))
    return out.withColumn("conserved", (F.col("zone") == F.col("valid") + F.col("nodata")) & (F.col("valid") == F.col("eligible") + F.col("water"))).drop("nodata")


@query("d39_control_comparison", "SELECT feature, round(median(v) FILTER (f = 'A'), 6) AS a_median, round(median(v) FILTER (f = 'N'), 6) AS n_median, round(median(v) FILTER (f = 'R'), 6) AS r_median, round(count(*) FILTER (v > 0.05) / CAST(count(*) AS DOUBLE), 6) AS out_rate FROM (SELECT l_returnflag AS f, unnest(['discount', 'tax']) AS feature, unnest([l_discount, l_tax]) AS v FROM lineitem) GROUP BY 1")
def d39(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.explode(F.array(F.struct(F.lit("discount").alias("feature"), F.col("l_discount").alias("v")), F.struct(F.lit("tax").alias("feature"), F.col("l_tax").alias("v")))).alias("x")).select("f", "x.*")
    at = lambda f: F.median(F.when(F.col("f") == f, F.col("v"))).alias(f"{f.lower()}_median")
    return rounded(long.groupBy("feature").agg(at("A"), at("N"), at("R"), (F.count_if(F.col("v") > 0.05) / F.count(F.lit(1))).alias("out_rate")), "a_median", "n_median", "r_median", "out_rate")


@query("d40_date_mean_training", "SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS target, CAST(min(dayofyear(ts)) AS BIGINT) AS feature, count(*) AS n, count(DISTINCT dayofyear(ts)) = 1 AS constant FROM events GROUP BY 1")
def d40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("target"), F.min(F.dayofyear("ts")).cast("long").alias("feature"), F.count(F.lit(1)).alias("n"), (F.countDistinct(F.dayofyear("ts")) == 1).alias("constant"))


@query("d41_denominator_invariance", "SELECT l_partkey, count(DISTINCT l_suppkey) AS variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def d41(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.quality import varying

    return varying(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_suppkey"])


@query("d42_reconciliation", "SELECT 'lineitem' AS source, 'quantity' AS estimate, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', 'totalprice', round(avg(o_totalprice), 6), count(*) FROM orders UNION ALL SELECT 'events', 'value', round(avg(value), 6), count(*) FROM events")
def d42(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [(t, e, c) for t, e, c in (("lineitem", "quantity", "l_quantity"), ("orders", "totalprice", "o_totalprice"), ("events", "value", "value"))]
    rows = [table(spark, sf_dir, t).agg(F.round(F.avg(c), 6).alias("value"), F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("source"), F.lit(e).alias("estimate"), "value", "n") for t, e, c in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("d43_checkpoint_audit", "WITH s AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderstatus, count(*) AS orders, count(s.n) AS with_lines, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS lines, round(coalesce(sum(s.q), 0), 6) AS quantity FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY 1")
def d43(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "orders").join(s, "o_orderkey", "left").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.count("n").alias("with_lines"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.round(F.coalesce(F.sum("q"), F.lit(0.0)), 6).alias("quantity"))


@query("d44_year_summary", "WITH d AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n, count(*) FILTER (l_tax < 0.05) AS usable FROM lineitem GROUP BY 1) SELECT year(day) AS yr, count(*) AS dates, count(*) FILTER (usable >= 5) AS usable_dates, CAST(sum(usable) AS BIGINT) AS model_rows FROM d GROUP BY 1")
def d44(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count_if(F.col("l_tax") < 0.05).alias("usable"))
    return d.groupBy(F.year("day").cast("long").alias("yr")).agg(F.count(F.lit(1)).alias("dates"), F.count_if(F.col("usable") >= 5).alias("usable_dates"), F.sum("usable").alias("model_rows"))


@query("d48_unit_map", "WITH f AS (SELECT o_custkey, avg(o_totalprice) AS m, count(DISTINCT CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1) SELECT c_custkey, coalesce(d, 0) AS dates, round(m, 6) AS mean FROM customer LEFT JOIN f ON c_custkey = o_custkey")
def d48(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.countDistinct(F.to_date("o_orderdate")).alias("dates"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(f, "c_custkey", "left").select("c_custkey", F.coalesce("dates", F.lit(0)).alias("dates"), "mean")
