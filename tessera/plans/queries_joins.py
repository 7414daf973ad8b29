"""Joins and contract checks over the test tables (inventory C and H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import quality as Q
from tessera.plans.registry import query
from tessera.session import table


@query("c01_c18_h13_key_difference", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) SELECT k, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)")
def c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.key_difference(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), ["k"])


@query(
    "c02_c24_assemble",
    """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS target FROM events GROUP BY 1, 2), s AS (SELECT c_custkey AS user_id, c_acctbal FROM customer WHERE c_custkey % 4 <> 0),
    w AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1)
    SELECT d.user_id, d.day, round(target, 6) AS target, c_acctbal, s.user_id IS NULL AS missing_0, round(price, 6) AS price, w.day IS NULL AS missing_1 FROM d LEFT JOIN s USING (user_id) LEFT JOIN w ON w.day = d.day
    """,
)
def c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("target"))
    s = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    w = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("price"))
    return J.assemble(d, [(s, ["user_id"]), (w, ["day"])])


@query(
    "c03_c20_one_shot_join",
    "SELECT l_orderkey, l_linenumber, o_orderpriority, o_orderkey IS NOT NULL AS matched FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey",
)
def c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return J.assemble(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), [(o, ["l_orderkey"])]).select("l_orderkey", "l_linenumber", "o_orderpriority", (~F.col("missing_0")).alias("matched"))


_C04 = """
    WITH k AS (SELECT d.day, c.c_custkey AS unit FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d, customer c),
    v AS (SELECT user_id AS unit, CAST(ts AS DATE) AS day, avg(value) AS a, count(*) AS b FROM events GROUP BY 1, 2)
    SELECT k.day, k.unit, c_acctbal, round(a, 6) AS a, a IS NULL AS missing FROM k JOIN customer ON unit = c_custkey LEFT JOIN v USING (day, unit)
    """


@query("c04_c05_predictor_frame", _C04)
def c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    keys = J.key_universe(ev.select("day").distinct(), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")))
    static = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), "c_acctbal")
    values = ev.groupBy(F.col("user_id").alias("unit"), "day").agg(F.round(F.avg("value"), 6).alias("a"))
    return J.assemble(keys, [(static, ["unit"]), (values, ["day", "unit"])]).select("day", "unit", "c_acctbal", "a", F.col("missing_1").alias("missing"))


@query("c06_c07_key_universe", "SELECT day, n_nationkey AS unit, n_regionkey FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), nation")
def c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.key_universe(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct(), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("unit"), "n_regionkey"))


_C08 = "WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS target FROM orders), a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS acquired FROM lineitem) SELECT target, acquired, date_diff('day', acquired, target) AS lag FROM t, a WHERE date_diff('day', acquired, target) BETWEEN 1 AND 60"


@query("c08_c09_lag_membership", _C08)
def c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("target")).distinct()
    a = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("acquired")).distinct()
    return J.lag_membership(t, a, "target", "acquired", 1, 60).select("target", "acquired", F.col("lag").cast("long").alias("lag"))


@query("c10_membership_audit", "WITH t AS (SELECT DISTINCT CAST(ts AS DATE) AS target FROM events), m AS (SELECT a.target, b.target AS acquired, date_diff('day', b.target, a.target) AS lag FROM t a, t b WHERE date_diff('day', b.target, a.target) BETWEEN 1 AND 10) SELECT target, acquired, lag, 'stored' AS side FROM m WHERE lag > 7")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A membership stored with too wide a window differs from the recomputed one by exactly its surplus."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("target")).distinct()
    other = days.withColumnRenamed("target", "acquired")
    stored, expected = (J.lag_membership(days, other, "target", "acquired", 1, n).withColumn("lag", F.col("lag").cast("long")) for n in (10, 7))
    return J.membership_violations(stored, expected, ["target", "acquired", "lag"])


@query("c11_lag_requirements", "SELECT DISTINCT CAST(day - CAST(g AS INTEGER) AS DATE) AS source_day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), (SELECT unnest(range(1, 8)) AS g)")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lag_requirements(table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")), "day", 1, 7)


@query("c12_c13_paired_models", "SELECT l_orderkey, round(sum(l_extendedprice), 4) AS truth, round(sum(l_quantity * 1500), 4) AS baseline_pred, round(sum(l_quantity * p_retailprice), 4) AS target_pred, false AS unpaired, false AS unequal_truth FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.metrics import unpivot_predictions
    from tessera.plans.queries_metrics import pairs

    orders = pairs(spark, sf_dir).groupBy("l_orderkey").agg(F.round(F.sum("y"), 4).alias("y"), F.round(F.sum(F.col("l_quantity") * 1500), 4).alias("flat"), F.round(F.sum("p"), 4).alias("line"))
    long = unpivot_predictions(orders, ["l_orderkey", "y"], {"line": "line", "flat": "flat"})
    return J.paired_models(long, ["l_orderkey"], "model", "y", "pred", "flat", "line")


@query(
    "c14_fixed_support",
    "WITH p AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_tax < 0.06) AS v, count(DISTINCT l_linestatus) AS k FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_tax < 0.03) AS v, count(DISTINCT l_linestatus) AS k FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) SELECT count(*) FILTER (s.l_suppkey IS NULL) AS unmatched_keys, count(*) FILTER (s.n <> p.n OR s.k <> p.k) AS moved, count(*) FILTER (s.v > p.v) AS risen, count(*) FILTER (s.v > 20 AND NOT p.v > 20) AS appeared FROM p LEFT JOIN s USING (l_suppkey)",
)
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(limit: float, rows: DataFrame) -> DataFrame:
        return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") < limit).alias("v"), F.countDistinct("l_linestatus").alias("k")).withColumn("ok", F.col("v") > 20)

    li = table(spark, sf_dir, "lineitem")
    return J.fixed_support(run(0.06, li), run(0.03, li.where("l_suppkey % 7 <> 0")), ["l_suppkey"], ["n", "k"], "v", "ok")


@query("c15_date_retention", "WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CAST(ts AS DATE) AS day, count(*) AS m FROM events WHERE value > 60 GROUP BY 1) SELECT day, coalesce(n, 0) AS primary_n, coalesce(m, 0) AS strict_n, coalesce(n, 0) - coalesce(m, 0) AS lost FROM a FULL JOIN b USING (day)")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    a, b = ev.groupBy("day").agg(F.count(F.lit(1)).alias("primary_n")), ev.where("value > 60").groupBy("day").agg(F.count(F.lit(1)).alias("strict_n"))
    return a.join(b, "day", "full_outer").select("day", F.coalesce("primary_n", F.lit(0)).alias("primary_n"), F.coalesce("strict_n", F.lit(0)).alias("strict_n"), (F.coalesce("primary_n", F.lit(0)) - F.coalesce("strict_n", F.lit(0))).alias("lost"))


@query("c16_rescored_predictions", "WITH s AS (SELECT l_orderkey, avg(l_extendedprice) AS y FROM lineitem WHERE l_tax < 0.04 GROUP BY 1) SELECT o_orderstatus, count(*) AS n, round(avg(abs(o_totalprice - y)), 4) AS mae FROM orders JOIN s ON o_orderkey = l_orderkey GROUP BY 1")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = table(spark, sf_dir, "lineitem").where("l_tax < 0.04").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_extendedprice").alias("y"))
    return table(spark, sf_dir, "orders").join(strict, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("o_totalprice") - F.col("y"))), 4).alias("mae"))


@query("c17_unit_block_consistency", "SELECT s_suppkey, s_nationkey, n_regionkey AS block, n_regionkey = s_suppkey % 5 AS agrees FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("block"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(n, "s_nationkey", "left").withColumn("agrees", F.col("block") == F.col("s_suppkey") % 5)


@query("c18_shared_groups", "SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1997)")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return J.shared_groups(li.where("year(l_shipdate) = 1996"), li.where("year(l_shipdate) = 1997"), ["l_partkey"])


@query("c19_contribution_reconcile", "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), t AS (SELECT l_orderkey, count(*) AS expected FROM lineitem GROUP BY 1) SELECT l_orderkey, expected, coalesce(n, 0) AS found FROM t LEFT JOIN s USING (l_orderkey) WHERE expected <> coalesce(n, 0)")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    targets = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("expected"))
    return J.contribution_violations(targets, li.where("l_linenumber <= 4").select("l_orderkey", F.lit(1).alias("one")), ["l_orderkey"], "expected", "one")


@query("c21_c23_reporting_rows", "WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS y FROM events WHERE event_type = 'click' GROUP BY 1, 2), p AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS p FROM events WHERE event_type = 'view' GROUP BY 1, 2), d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS day_n FROM events GROUP BY 1) SELECT user_id, day, round(y, 6) AS y, round(p, 6) AS p, y IS NOT NULL AS has_target, p IS NOT NULL AS has_prediction, day_n FROM t FULL JOIN p USING (user_id, day) LEFT JOIN d USING (day)")
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    t = ev.where("event_type = 'click'").groupBy("user_id", "day").agg(F.round(F.avg("value"), 6).alias("y"))
    p = ev.where("event_type = 'view'").groupBy("user_id", "day").agg(F.round(F.max("value"), 6).alias("p"))
    return J.reporting_rows(t, p, ev.groupBy("day").agg(F.count(F.lit(1)).alias("day_n")), ["user_id", "day"], "day")


@query("c22_diagnostic_frame", "SELECT l_orderkey, l_linenumber, l_discount <= 0.02 AS certain, o_orderstatus = 'F' AS settled, p_size IS NOT NULL AS described FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount").join(o, "l_orderkey", "left").join(p, "l_partkey", "left")
    return J.flag(J.flag(J.flag(j, "certain", F.col("l_discount") <= 0.02), "settled", F.col("o_orderstatus") == "F"), "described", F.col("p_size").isNotNull()).select("l_orderkey", "l_linenumber", "certain", "settled", "described")


def _json_sql(numbers: list[str], texts: list[str]) -> str:
    """A row as JSON in SQL: numbers, then texts."""
    parts = [f"'\"{c}\":' || CAST({c} AS VARCHAR)" for c in numbers] + [f"'\"{c}\":\"' || {c} || '\"'" for c in texts]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_SUMS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 16 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4))
_NUMBERS, _TEXTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus", "shipped"]


@query("h01_fingerprint", f"WITH r AS (SELECT sha256({_json_sql(_NUMBERS, _TEXTS)}) AS h FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped FROM lineitem)) SELECT count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {_SUMS}) AS sha256 FROM r")
def h01(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return Q.fingerprint(li, [*_NUMBERS, *_TEXTS])


@query("h02_h26_broken_rules", "SELECT l_orderkey, l_linenumber, 'quantity' AS rule FROM lineitem WHERE NOT l_quantity <= 45 UNION ALL SELECT l_orderkey, l_linenumber, 'tax' FROM lineitem WHERE NOT l_tax >= 0.01")
def h02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.broken_rules(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity") <= 45, "tax": F.col("l_tax") >= 0.01})


@query("h03_h04_h21_group_fingerprints", f"WITH r AS (SELECT l_suppkey, sha256({_json_sql(['l_orderkey', 'l_linenumber'], [])}) AS h, count(*) AS m FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, CAST(sum(m) AS BIGINT) AS n, sha256(CAST(count(*) AS VARCHAR) || ':' || {_SUMS}) AS sha256 FROM r GROUP BY 1")
def h03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.group_fingerprints(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("h05_h30_h31_duplicate_keys", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def h05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("h06_locked_rows", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 2000")
def h06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.locked_rows(table(spark, sf_dir, "orders"), "o_orderdate", 2000).select("o_orderkey")


@query("h07_late_windows", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate")
def h07(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return Q.late_windows(table(spark, sf_dir, "lineitem").join(o, "l_orderkey"), "l_shipdate", "o_orderdate").select("l_orderkey", "l_linenumber")


@query("h08_h22_gate_mismatches", "SELECT event_id FROM events WHERE (event_type = 'click') <> (CASE WHEN value > 50 THEN value END IS NOT NULL)")
def h08(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("target", F.when(F.col("value") > 50, F.col("value")))
    return Q.gate_mismatches(ev, "target", F.col("event_type") == "click").select("event_id")


@query("h09_legal_rows", "SELECT event_id FROM events WHERE value > 50 AND event_type = 'click' AND year(ts) < 2025")
def h09(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.where((F.col("value") > 50) & (F.col("event_type") == "click") & (F.year("ts") < 2025)).select("event_id")


@query("h10_h11_registry_contract", "SELECT 'l_' || r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'model' ELSE 'audit_only' END AS role, CAST(r_regionkey + 1 AS BIGINT) AS window_days FROM region WHERE r_name <> 'ASIA' UNION ALL SELECT 'n_' || n_name, 'model', CAST(n_nationkey % 7 + 1 AS BIGINT) FROM nation WHERE n_nationkey % 7 < 7")
def h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as the union of typed fragments; rows that break a rule (role, window, name) are taken out by the contract."""
    a = table(spark, sf_dir, "region").select(F.concat(F.lit("l_"), "r_name").alias("name"), F.when(F.col("r_regionkey") % 2 == 0, "model").otherwise("audit_only").alias("role"), (F.col("r_regionkey") + 1).cast("long").alias("window_days"))
    b = table(spark, sf_dir, "nation").select(F.concat(F.lit("n_"), "n_name").alias("name"), F.lit("model").alias("role"), (F.col("n_nationkey") % 7 + 1).cast("long").alias("window_days"))
    registry = a.unionByName(b)
    bad = Q.broken_rules(registry, ["name"], {"role": F.col("role").isin("model", "audit_only"), "window": F.col("window_days").between(1, 7), "name": F.col("name") != "l_ASIA"}).select("name").distinct()
    return registry.join(bad, "name", "left_anti")


@query("h12_h16_partly_missing", "WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN 1 END AS a, CASE WHEN l_discount > 0 THEN 1 END AS b FROM lineitem) SELECT l_orderkey, l_linenumber, 1 AS missing FROM r WHERE (a IS NULL) <> (b IS NULL)")
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, 1).alias("a"), F.when(F.col("l_discount") > 0, 1).alias("b"))
    return Q.partly_missing(r, ["l_orderkey", "l_linenumber"], ["a", "b"])


@query("h14_joined_lists", "SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY l_suppkey, l_partkey), '|') AS items, count(*) AS n FROM lineitem GROUP BY 1")
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_suppkey", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_partkey"].cast("string")), "|").alias("items"), F.count(F.lit(1)).alias("n"))


@query("h15_h17_set_differences", "SELECT l_orderkey, 'left' AS side FROM lineitem WHERE l_tax < 0.01 AND l_linenumber > 3")
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_tax < 0.01")
    return Q.set_differences(li.select("l_orderkey"), li.where("l_linenumber <= 3").select("l_orderkey"))


@query("h18_exclusion_reasons", "SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'few' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'low' END AS reason FROM orders")
def h18(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_totalprice") < 20000, "few").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderpriority").startswith("5"), "low")
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@query("h19_h24_h27_incomplete_grid", "SELECT a.user_id, b.event_type FROM (SELECT DISTINCT user_id FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = b.event_type AND e.value > 90)")
def h19(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    grid = J.key_universe(ev.select("user_id").distinct(), ev.select("event_type").distinct())
    return grid.join(ev.where("value > 90").select("user_id", "event_type").distinct(), ["user_id", "event_type"], "left_anti")


@query("h20_h25_h28_mismatched_values", "SELECT l_suppkey, 'mean' AS \"column\" FROM lineitem GROUP BY 1 HAVING abs(avg(l_quantity) - avg(CASE WHEN l_linenumber < 7 THEN l_quantity END)) > 0.05")
def h20(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    stored = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean"))
    again = li.groupBy("l_suppkey").agg(F.avg(F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))).alias("mean"))
    return Q.mismatched_values(stored, again, ["l_suppkey"], ["mean"], 0.05)


@query("h23_canonical_predictions", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS y_true, l_quantity * 1500 AS y_pred FROM lineitem")
def h23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("y_true"), (F.col("l_quantity") * 1500).alias("y_pred"))


@query("h29_registry_from_windows", "SELECT r_name || '_' || CAST(w AS VARCHAR) || 'd' AS name, CAST(w AS BIGINT) AS window_days FROM region, (SELECT unnest([1, 3, 7]) AS w)")
def h29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_name", F.explode(F.array(F.lit(1), F.lit(3), F.lit(7))).alias("w")).select(F.concat("r_name", F.lit("_"), F.col("w").cast("string"), F.lit("d")).alias("name"), F.col("w").cast("long").alias("window_days"))
