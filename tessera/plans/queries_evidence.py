"""Evidence over the test tables: source units and families, controls, reconciled estimates, name filters, reporting keys (inventory B, C, D, E, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import is_canonical
from tessera.operators import contracts as C
from tessera.operators import evidence as E
from tessera.plans.queries_joins import _SUMS
from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table

_ITEMS = "i AS (SELECT l_returnflag AS source, l_suppkey AS unit, 'i' || CAST(l_orderkey % 5000 AS VARCHAR) AS item, l_linestatus AS platform, CAST(l_shipdate AS DATE) AS acquired FROM lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("source"), F.col("l_suppkey").alias("unit"), F.concat(F.lit("i"), (F.col("l_orderkey") % 5000).cast("string")).alias("item"), F.col("l_linestatus").alias("platform"), F.to_date("l_shipdate").alias("acquired"))


_UNITS = f"{_ITEMS}, h AS (SELECT source, unit, sha256('{{\"item\":\"' || item || '\"}}') AS h FROM (SELECT DISTINCT source, unit, item FROM i)), p AS (SELECT source, unit, sha256(CAST(count(*) AS VARCHAR) || ':' || {_SUMS}) AS sha256 FROM h GROUP BY 1, 2), u AS (SELECT source, unit, count(DISTINCT item) AS items, array_to_string(list_sort(list(DISTINCT platform)), '|') AS platforms, min(acquired) AS first, max(acquired) AS last FROM i GROUP BY 1, 2)"


@query("d35_source_units", f"WITH {_UNITS} SELECT * FROM u JOIN p USING (source, unit)")
def d35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.source_units(items(spark, sf_dir), ["source", "unit"], "item", "platform", "acquired")


@query("d36_family_summaries", f"WITH {_UNITS} SELECT source, count(*) AS units, CAST(sum(items) AS BIGINT) AS items, min(first) AS first, max(last) AS last, array_to_string(list_sort(list(unit)), '|') AS members FROM u GROUP BY 1")
def d36(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = E.source_units(items(spark, sf_dir), ["source", "unit"], "item", "platform", "acquired")
    return E.family_summaries(units, "source", "unit", "items", "first", "last")


_LONG = "l AS (SELECT l_returnflag AS f, CAST(l_shipdate AS DATE) AS day, unnest(['discount', 'price', 'tax']) AS feature, unnest([l_discount, l_extendedprice / 100000, l_tax]) AS v FROM lineitem)"


@query(
    "d39_controls",
    f"""WITH {_LONG}, w AS (SELECT feature, median(v) FILTER (f = 'R') AS r, median(v) FILTER (f = 'A') AS a, median(v) FILTER (f = 'N') AS n, CAST(count(*) FILTER (f = 'R' AND NOT v BETWEEN 0.01 AND 0.5) AS DOUBLE) / count(*) FILTER (f = 'R') AS outside FROM l GROUP BY 1),
    d AS (SELECT feature, f, day, median(v) AS m FROM l GROUP BY 1, 2, 3), e AS (SELECT feature, min(m) AS lo, max(m) AS hi FROM d WHERE f IN ('A', 'N') GROUP BY 1), c AS (SELECT feature, count(*) AS days, count(*) FILTER (m BETWEEN lo AND hi) AS days_within FROM d JOIN e USING (feature) WHERE f = 'R' GROUP BY 1)
    SELECT feature, round(r, 6) AS "R_median", round(a, 6) AS "A_median", round(n, 6) AS "N_median", CASE WHEN abs(a - r) <= abs(n - r) THEN 'A' ELSE 'N' END AS nearest, round(outside, 6) AS outside, days, days_within FROM w JOIN c USING (feature)""",
)
def d39(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final table's features against two controls': medians, the nearer control, rows out of bounds, dates inside the controls' envelope."""
    cols = {"discount": F.col("l_discount"), "price": F.col("l_extendedprice") / 100000, "tax": F.col("l_tax")}
    long = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), F.to_date("l_shipdate").alias("day"), F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("v")) for k, v in cols.items()])).alias("x")).select("f", "day", "x.*")
    return rounded(E.control_comparison(long, "f", "day", "feature", "v", "R", ["A", "N"], (0.01, 0.5)), "R_median", "A_median", "N_median", "outside")


_EST = [("lineitem", "quantity", "l_shipdate", "l_quantity", 1.0), ("lineitem", "tax", "l_shipdate", "l_tax", 1.0001), ("orders", "totalprice", "o_orderdate", "o_totalprice", 2.0), ("events", "value", "ts", "value", None)]
_DATES = " UNION ALL ".join(f"SELECT '{t}' AS source, '{e}' AS estimate, avg(m) AS value, stddev_samp(m) / sqrt(count(*)) AS se, count(*) AS dates, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT CAST({d} AS DATE) AS day, avg({c}) AS m, count({c}) AS n FROM {t} GROUP BY 1)" for t, e, d, c, _ in _EST)


@query(
    "d42_reconciled_estimates",
    f"""WITH e AS ({_DATES}), s AS ({" UNION ALL ".join(f"SELECT source, estimate, value * {f} AS stored FROM e WHERE estimate = '{n}'" for _, n, _, _, f in _EST if f)} UNION ALL SELECT 'nothing', 'there', 1.0),
    j AS (SELECT coalesce(e.source, s.source) AS source, coalesce(e.estimate, s.estimate) AS estimate, stored, value, value - 1.959963984540054 * se AS low, value + 1.959963984540054 * se AS high, dates, rows FROM e FULL JOIN s ON e.source = s.source AND e.estimate = s.estimate)
    SELECT source, estimate, round(stored, 5) AS stored, round(value, 5) AS value, round(low, 5) AS low, round(high, 5) AS high, dates, rows, CASE WHEN value IS NULL THEN 'unsupported' WHEN stored IS NULL THEN 'missing' WHEN abs(stored - value) <= 1e-9 * greatest(1.0, abs(value)) THEN 'equal' WHEN stored BETWEEN low AND high THEN 'within' ELSE 'outside' END AS status FROM j""",
)
def d42(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored estimates against their rows: one equal, one inside its interval, one outside, one that nobody stored and one without rows."""
    found = None
    for t, e, d, c, _ in _EST:
        part = E.date_estimate(table(spark, sf_dir, t).withColumn("__day", F.to_date(d)), t, e, "__day", c)
        found = part if found is None else found.unionByName(part)
    factor = F.coalesce(*[F.when(F.col("estimate") == e, F.lit(f)) for _, e, _, _, f in _EST if f])
    stored = found.where(factor.isNotNull()).select("source", "estimate", (F.col("value") * factor).alias("value")).unionByName(spark.createDataFrame([("nothing", "there", 1.0)], "source string, estimate string, value double"))
    return rounded(E.reconciled(stored, found, ["source", "estimate"]), "stored", "value", "low", "high", digits=5)


#: Reasons and patterns of names that a feature may not have.
NAME_PATTERNS = {"identifier": "(^|_)(id|key|name)(_|$)|[0-9]{4,}", "target": "(^|_)(target|brass|label)", "fold": "(^|_)(fold|block|steel)(_|$)", "count": "(^|_)n_|count"}
_NAMES = "(SELECT DISTINCT lower(replace(p_type, ' ', '_')) AS name FROM part UNION SELECT DISTINCT lower(replace(p_name, ' ', '_')) FROM part UNION SELECT DISTINCT lower(replace(event_type, ' ', '_')) || '_count' FROM events)"


@query("b28_name_reasons", f"SELECT name, concat_ws('; ', {', '.join(f"CASE WHEN regexp_matches(name, '{p}') THEN '{r}' END" for r, p in NAME_PATTERNS.items())}) AS reasons FROM {_NAMES} WHERE regexp_matches(name, '{'|'.join(NAME_PATTERNS.values())}')")
def b28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names made of the tables' own words, with every reason why a name is refused."""
    return E.name_reasons(feature_names(spark, sf_dir), "name", NAME_PATTERNS)


def feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, events = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    flat = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_"))).alias("name")
    return part.select(flat("p_type")).union(part.select(flat("p_name"))).union(events.select(F.concat(F.lower(F.replace(F.col("event_type"), F.lit(" "), F.lit("_"))), F.lit("_count")).alias("name"))).distinct()


@query("b27_forbidden_tokens", f"SELECT name FROM {_NAMES} WHERE contains(name, 'steel') OR contains(name, 'click') OR contains(name, '7')")
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that hold a forbidden token anywhere."""
    names = feature_names(spark, sf_dir)
    return names.where(F.col("name").contains("steel") | F.col("name").contains("click") | F.col("name").contains("7"))


@query(
    "g04_standardise_faults",
    "WITH c AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 89 = 0 THEN lpad(CAST(c_custkey - 1 AS VARCHAR), 8, '0') ELSE lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS geoid, CASE WHEN c_custkey % 53 = 0 THEN ' ' || c_name WHEN c_custkey % 59 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 61 = 0 THEN 99 ELSE c_nationkey END AS state FROM customer) "
    "SELECT 'geoid_width' AS rule, geoid AS at, CAST(1 AS BIGINT) AS n FROM c WHERE length(geoid) <> 8 UNION ALL SELECT 'name', geoid, 1 FROM c WHERE name IS NULL OR name <> trim(name) OR length(name) = 0 UNION ALL SELECT 'duplicate_key', geoid, count(*) FROM c GROUP BY geoid HAVING count(*) > 1 UNION ALL SELECT 'unknown_state', geoid, 1 FROM c WHERE state NOT IN (SELECT n_nationkey FROM nation)",
)
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps places and units from being standardised, row by row and rule by rule; nothing is dropped."""
    k = F.col("c_custkey")
    geoid = F.when(k % 97 == 0, k.cast("string")).when(k % 89 == 0, F.lpad((k - 1).cast("string"), 8, "0")).otherwise(F.lpad(k.cast("string"), 8, "0"))
    c = table(spark, sf_dir, "customer").select(geoid.alias("geoid"), F.when(k % 53 == 0, F.concat(F.lit(" "), "c_name")).when(k % 59 == 0, None).otherwise(F.col("c_name")).alias("name"), F.when(k % 61 == 0, 99).otherwise(F.col("c_nationkey")).alias("state"))
    states = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("state"))
    return C.all_of([C.by_rule(c, ["geoid"], {"geoid_width": F.length("geoid") == 8, "name": is_canonical(F.col("name"))}), C.duplicates(c, ["geoid"]), C.named(c.join(states, "state", "left_anti"), "unknown_state", ["geoid"])])


_REP = "ev AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value FROM events), t AS (SELECT user_id, day, CASE WHEN min(value) < 1 THEN 'low' END AS reason FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2), p AS (SELECT user_id, day FROM ev WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2), v AS (SELECT user_id, day, CASE WHEN min(value) < 2 THEN 'low' END AS reason FROM ev WHERE event_type IN ('click', 'view') AND user_id % 13 <> 0 GROUP BY 1, 2 UNION ALL SELECT user_id, day, NULL FROM ev WHERE event_type = 'click' AND user_id % 17 = 0 GROUP BY 1, 2)"


@query(
    "c21_reporting_faults",
    f"""WITH {_REP}, a AS (SELECT user_id, day, 'target' AS part, reason FROM t UNION ALL SELECT user_id, day, 'prediction', NULL FROM p UNION ALL SELECT user_id, day, 'availability', reason FROM v),
    s AS (SELECT user_id, day, count(*) FILTER (part = 'target') AS target, count(*) FILTER (part = 'prediction') AS prediction, count(*) FILTER (part = 'availability') AS availability, max(reason) FILTER (part = 'target') AS tr, max(reason) FILTER (part = 'availability') AS ar FROM a GROUP BY 1, 2)
    {" UNION ALL ".join([f"SELECT user_id, day, 'no_{x}' AS fault FROM s WHERE {x} = 0" for x in ("target", "prediction", "availability")] + [f"SELECT user_id, day, 'twice_{x}' FROM s WHERE {x} > 1" for x in ("target", "prediction", "availability")] + ["SELECT user_id, day, 'reason' FROM s WHERE target > 0 AND availability > 0 AND tr IS DISTINCT FROM ar"])}""",
)
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, predictions and availability have to have the same keys, once each, and the same reasons."""
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    of = lambda *kinds: ev.where(F.col("event_type").isin(*kinds))
    low = lambda df, least: df.groupBy("user_id", "day").agg(F.when(F.min("value") < least, "low").alias("reason"))
    again = of("click").where("user_id % 17 = 0").select("user_id", "day").distinct().withColumn("reason", F.lit(None).cast("string"))
    return E.reporting_faults(low(of("click", "view"), 1), of("click", "purchase", "view").select("user_id", "day").distinct(), low(of("click", "view").where("user_id % 13 <> 0"), 2).unionByName(again), ["user_id", "day"], "reason")


@query(
    "e17_sorted_shares",
    "WITH o AS (SELECT l_suppkey, l_linenumber AS label, sum(l_quantity) AS area FROM lineitem GROUP BY 1, 2), s AS (SELECT *, area / sum(area) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY area DESC, label) AS k FROM o) SELECT l_suppkey, any_value(label) FILTER (k = 1) AS label, round(any_value(share) FILTER (k = 1), 6) AS share, string_agg(CAST(label AS VARCHAR) || ':' || format('{:.6f}', share), '|' ORDER BY k) AS shares FROM s GROUP BY 1",
)
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with the largest overlap, and all labels with their shares in order."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("label"), "l_quantity")
    return rounded(E.sorted_shares(li, "l_suppkey", "label", "l_quantity"), "share")
