"""Windows, rankings and selections over the test tables (inventory E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.plans.registry import query
from tessera.session import table

DAILY_SQL = "daily AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query("e01_row_weights", f"WITH {DAILY_SQL} SELECT user_id, day, round(CAST((SELECT count(*) FROM daily) AS DOUBLE) / ((SELECT count(DISTINCT day) FROM daily) * count(*) OVER (PARTITION BY day)), 6) AS weight FROM daily")
def e01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal mass for every date: N / (D n_d); the two scalars come by a one-row join."""
    from tessera.operators.metrics import date_balanced_weights

    return date_balanced_weights(daily(spark, sf_dir), "day").select("user_id", "day", F.round("weight", 6).alias("weight"))


@query(
    "e02_spearman",
    """
    WITH r AS (SELECT l_returnflag, l_suppkey % 7 AS grp, rank() OVER (PARTITION BY l_returnflag, l_suppkey % 7 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey % 7, l_quantity) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY l_returnflag, l_suppkey % 7 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_suppkey % 7, l_extendedprice) - 1) / 2.0 AS ry FROM lineitem)
    SELECT l_returnflag, grp, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1, 2
    """,
)
def e02(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lines(spark, sf_dir).withColumn("grp", F.col("l_suppkey") % 7)
    return W.spearman(df, ["l_returnflag", "grp"], "l_quantity", "l_extendedprice").withColumn("rho", F.round("rho", 6))


def _trail(n: int) -> str:
    w = f"(PARTITION BY user_id ORDER BY date_diff('day', DATE '1970-01-01', day) RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(v) OVER {w} = {n} THEN avg(v) OVER {w} END, 6) AS v_mean_{n}d, round(CASE WHEN count(n) OVER {w} = {n} THEN sum(n) OVER {w} END, 6) AS n_sum_{n}d"


@query("e03_lag_features", f"WITH {DAILY_SQL} SELECT user_id, day, {_trail(1)}, {_trail(3)}, {_trail(7)} FROM daily")
def e03(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = W.trailing(daily(spark, sf_dir).withColumn("n", F.col("n").cast("double")), "user_id", "day", ["v"], ["n"])
    return df.select("user_id", "day", *[F.round(c, 6).alias(c) for k in (1, 3, 7) for c in (f"v_mean_{k}d", f"n_sum_{k}d")])


_E04 = f"""
    WITH {DAILY_SQL}, t AS (SELECT DISTINCT user_id, day + 2 AS day FROM daily),
    j AS (SELECT t.user_id, t.day, count(d.v) AS c, avg(d.v) AS m FROM t LEFT JOIN daily d ON d.user_id = t.user_id AND d.day BETWEEN t.day - 3 AND t.day - 1 GROUP BY 1, 2)
    SELECT user_id, CAST(day AS DATE) AS day, CAST(day - 3 AS DATE) AS first_day, CAST(day - 1 AS DATE) AS last_day, c AS days_present, c = 3 AS complete, round(CASE WHEN c = 3 THEN m END, 6) AS mean FROM j
    """


@query("e04_lags_at_targets", _E04)
def e04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    targets = d.select("user_id", F.date_add("day", 2).alias("day"))
    return W.trailing_at(d, targets, "user_id", "day", "v", 3).withColumn("mean", F.round("mean", 6))


@query(
    "e05_dense_calendar",
    f"""
    WITH {DAILY_SQL}, s AS (SELECT user_id, min(day) AS a, max(day) AS b FROM daily GROUP BY 1), g AS (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
    SELECT g.user_id, g.day, round(d.v, 6) AS v, d.v IS NOT NULL AS observed, d.v IS NULL AND dayofyear(g.day) = 366 AS leap_gap FROM g LEFT JOIN daily d USING (user_id, day)
    """,
)
def e05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dense_calendar(daily(spark, sf_dir).drop("n"), "user_id", "day").withColumn("v", F.round("v", 6))


@query(
    "e06_average_precision",
    """
    WITH s AS (SELECT d.lang, d.n_chars AS score, sum(l.quality) AS tp, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2),
    c AS (SELECT lang, tp, sum(tp) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS ct, sum(n) OVER (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn, sum(tp) OVER (PARTITION BY lang) AS p FROM s)
    SELECT lang, CAST(max(p) AS BIGINT) AS positives, round(sum(CASE WHEN p > 0 THEN CAST(tp AS DOUBLE) / p * (CAST(ct AS DOUBLE) / cn) END), 6) AS ap FROM c GROUP BY 1
    """,
)
def e06(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return W.average_precision(scored, ["lang"], "quality", "n_chars").withColumn("ap", F.round("ap", 6))


@query("e07_top_share", f"WITH {DAILY_SQL} SELECT user_id, day, row_number() OVER (PARTITION BY day ORDER BY v DESC, user_id) <= ceil(0.2 * count(*) OVER (PARTITION BY day)) AS hot FROM daily")
def e07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_share(daily(spark, sf_dir), ["day"], "v", "user_id", 0.2).select("user_id", "day", "hot")


@query("e08_quartiles", "SELECT s_suppkey, CAST(least(3, floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1) * 4 / count(*) OVER (PARTITION BY s_nationkey))) AS BIGINT) AS quartile FROM supplier")
def e08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", W.quartile("s_acctbal", "s_suppkey", ["s_nationkey"]).cast("long").alias("quartile"))


@query(
    "e09_mosaic",
    """
    WITH r AS (SELECT *, l_linenumber <> 3 AS ok, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY (l_linenumber <> 3) DESC, l_discount, l_tax DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem)
    SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS scene, CASE WHEN ok THEN l_quantity END AS value FROM r WHERE k = 1
    """,
)
def e09(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = lines(spark, sf_dir).select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("scene"), (F.col("l_linenumber") != 3).alias("valid"), F.col("l_discount").alias("uncertainty"), F.col("l_tax").alias("distance"), F.col("l_quantity").alias("value"))
    return W.mosaic(pixels, ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey", "scene", "value")


@query(
    "e10_tile_owner",
    """
    WITH r AS (SELECT *, CASE WHEN l_discount < 0.05 AND l_tax < 0.05 THEN 1 WHEN l_tax < 0.05 THEN 2 ELSE 3 END AS tier FROM lineitem),
    o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY tier, l_suppkey, l_orderkey * 10 + l_linenumber) AS k FROM r)
    SELECT l_suppkey, CAST(tier AS BIGINT) AS tier, count(*) AS owned FROM o WHERE k = 1 GROUP BY 1, 2
    """,
)
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = lines(spark, sf_dir).select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), ((F.col("l_discount") < 0.05) & (F.col("l_tax") < 0.05)).alias("clear"), (F.col("l_tax") < 0.05).alias("complete"))
    return W.tile_owner(pixels, ["l_partkey"], "clear", "complete", "l_suppkey", "item").groupBy("l_suppkey", F.col("tier").cast("long").alias("tier")).agg(F.count(F.lit(1)).alias("owned"))


@query("e11_latest_version", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_row(lines(spark, sf_dir), ["l_partkey", "l_suppkey"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "e12_e13_cohorts",
    """
    WITH l AS (SELECT * FROM (SELECT *, l_orderkey * 10 + l_linenumber AS item, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k = 1),
    s AS (SELECT l_suppkey, l_linenumber, round(sum(l_quantity), 6) AS coverage, max(l_shipdate) AS generation, list_sort(list(item)) AS items FROM l GROUP BY 1, 2)
    SELECT l_suppkey, CAST(l_linenumber AS BIGINT) AS baseline, coverage, array_to_string(items, '|') AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY coverage DESC, l_linenumber DESC, generation DESC, items) AS k FROM s) WHERE k = 1
    """,
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lines(spark, sf_dir).withColumn("item", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    best = W.cohort(items, ["l_suppkey"], ["l_linenumber"], "l_returnflag", "l_shipdate", "item", "l_quantity")
    return best.select("l_suppkey", F.col("l_linenumber").cast("long").alias("baseline"), F.round("coverage", 6).alias("coverage"), F.array_join(F.col("items").cast("array<string>"), "|").alias("items"))


@query(
    "e14_gap_sessions",
    """
    WITH n AS (SELECT *, CASE WHEN epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) <= 14400 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n
    """,
)
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.gap_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 14400).select("event_id", "session")


@query("e14_span_sessions")
def e14_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose span counts from their first row: stateful, so tested against a loop rather than SQL."""
    return W.span_sessions(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "ts", "event_id", 14400)


@query(
    "e15_interval_merge",
    """
    WITH i AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 20 AS b FROM orders),
    r AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM i),
    s AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT o_custkey, min(a) AS a, CAST(max(b) AS DATE) AS b, count(*) AS parts FROM s GROUP BY o_custkey, island
    """,
)
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("a"), F.date_add(F.to_date("o_orderdate"), 20).alias("b")).distinct()
    return W.merge_intervals(spans, ["o_custkey"], "a", "b")


@query("e16_probe_pick", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.best_row(lines(spark, sf_dir), ["l_suppkey"], [F.desc("l_quantity"), F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "e17_e18_largest_overlap",
    """
    WITH o AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS area FROM lineitem GROUP BY 1, 2), t AS (SELECT *, area / sum(area) OVER (PARTITION BY l_partkey) AS share, row_number() OVER (PARTITION BY l_partkey ORDER BY area DESC, l_suppkey) AS k FROM o)
    SELECT l_partkey, l_suppkey AS label, round(share, 6) AS share FROM t WHERE k = 1 AND share >= 0.1
    """,
)
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.zonal import largest_share

    area = lines(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("area"))
    return largest_share(area, "l_partkey", "l_suppkey", "area", 0.1).select("l_partkey", F.col("l_suppkey").alias("label"), F.round("share", 6).alias("share"))


@query("e19_failure_cases", "SELECT l_suppkey, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1500)), 6) AS mae FROM lineitem GROUP BY 1 ORDER BY mae DESC, l_suppkey LIMIT 25")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 units with the largest mean error: a report, so its limit is the feature."""
    error = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500)
    return lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(error), 6).alias("mae")).orderBy(F.desc("mae"), "l_suppkey").limit(25)


@query(
    "e20_e21_strongest_baseline",
    """
    WITH m AS (SELECT l_returnflag AS family, l_linenumber AS model, avg(abs(l_extendedprice - l_quantity * 1500)) AS mae FROM lineitem GROUP BY 1, 2),
    b AS (SELECT family, model AS base, mae AS base_mae FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mae, model) AS k FROM m WHERE model <= 3) WHERE k = 1)
    SELECT family, CAST(model AS BIGINT) AS model, CAST(base AS BIGINT) AS base, round(mae, 6) AS mae, round((base_mae - mae) / base_mae, 6) AS improvement, model = base AS is_baseline FROM m JOIN b USING (family)
    """,
)
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = lines(spark, sf_dir).groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").cast("long").alias("model")).agg(F.avg(F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500)).alias("mae"))
    base = W.best_row(summary.where("model <= 3"), ["family"], [F.asc("mae"), F.asc("model")]).select("family", F.col("model").alias("base"), F.col("mae").alias("base_mae"))
    return summary.join(base, "family").select("family", "model", "base", F.round("mae", 6).alias("mae"), F.round((F.col("base_mae") - F.col("mae")) / F.col("base_mae"), 6).alias("improvement"), (F.col("model") == F.col("base")).alias("is_baseline"))


@query(
    "e22_e23_select_candidate",
    """
    WITH s AS (SELECT l_returnflag AS fold, l_linenumber AS candidate, l_linenumber % 3 AS complexity, avg(l_discount) AS m, count(l_discount) AS n FROM lineitem GROUP BY 1, 2, 3),
    t AS (SELECT *, min(m) OVER (PARTITION BY fold) AS best FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY complexity, candidate) AS r FROM t WHERE m <= best + 0.0001 + 0.01 * abs(best))
    SELECT fold, CAST(candidate AS BIGINT) AS candidate, round(m, 6) AS mean_score, n AS dates FROM k WHERE r = 1
    """,
)
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lines(spark, sf_dir).select(F.col("l_returnflag").alias("fold"), F.col("l_linenumber").alias("candidate"), (F.col("l_linenumber") % 3).alias("complexity"), "l_discount")
    best = W.select_candidate(scores, ["fold"], "candidate", "complexity", "l_discount", 0.0001, 0.01)
    return best.select("fold", F.col("candidate").cast("long").alias("candidate"), F.round("mean_score", 6).alias("mean_score"), "dates")


@query("e24_canonical_order", "SELECT n_name, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END, n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def e24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a literal rank, then by name. The table is a dimension of fixed size, so one task may number it."""
    from pyspark.sql import Window

    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rank = F.when(F.col("r_name") == "EUROPE", 0).when(F.col("r_name") == "ASIA", 1).otherwise(2)
    return named.select("n_name", F.row_number().over(Window.orderBy(rank, "n_name")).cast("long").alias("place"))


@query("e25_evenly_spaced", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM d) SELECT day FROM r WHERE n <= 7 OR i IN (SELECT CAST(round_even(g * (n - 1) / 6.0, 0) AS BIGINT) FROM (SELECT unnest(range(7)) AS g))")
def e25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.evenly_spaced(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct(), "day", 7)


@query("e26_largest_child", "SELECT s_nationkey, s_suppkey, CAST(floor((s_acctbal / 100 + 180) / 6) + 1 AS BIGINT) AS zone FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k = 1")
def e26(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = W.best_row(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")])
    return best.select("s_nationkey", "s_suppkey", (F.floor((F.col("s_acctbal") / 100 + 180) / 6) + 1).alias("zone"))
