"""Whole contracts over tables made from the test tables, with each rule broken somewhere (inventory H, B27, B28, D43).

Both sides read the same expressions for the planted tables; the rules are written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import contracts as C
from tessera.plans.registry import query
from tessera.session import table

# a row a supplier and day; the day's number and the supplier place the faults
_KEYS = "SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, CAST(sum(l_quantity) AS DOUBLE) AS q, CAST(min(l_extendedprice) AS DOUBLE) AS y, CAST(max(l_extendedprice) AS DOUBLE) AS p, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)"


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"), F.min("l_extendedprice").alias("y"), F.max("l_extendedprice").alias("p"), F.count(F.lit(1)).alias("n"))


def made(df: DataFrame, columns: dict[str, str], twice: str | None = None) -> DataFrame:
    """The planted table; rows for which `twice` holds stand there twice."""
    out = df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()])
    return out if twice is None else out.unionByName(df.where(twice).selectExpr(*[f"{v} AS {k}" for k, v in columns.items()]))


def _made_sql(name: str, columns: dict[str, str], twice: str | None = None) -> str:
    one = f"SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM k"
    return f"k AS ({_KEYS}), {name} AS ({one}{f' UNION ALL {one} WHERE {twice}' if twice else ''})"


def _at(*columns: str) -> str:
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns)


def _rule(name: str, source: str, at: tuple[str, ...], broken: str) -> str:
    return f"SELECT '{name}' AS rule, {_at(*at)} AS at, CAST(1 AS BIGINT) AS n FROM {source} WHERE {broken}"


def _twice(source: str, at: tuple[str, ...]) -> str:
    return f"SELECT 'duplicate_key' AS rule, {_at(*at)} AS at, count(*) AS n FROM {source} GROUP BY {', '.join(at)} HAVING count(*) > 1"


_PRED = {
    "unit": "CASE WHEN s = 3 THEN concat(' ', CAST(s AS STRING)) ELSE CAST(s AS STRING) END", "block": "CASE WHEN s = 5 AND day(d) = 9 THEN 'other' WHEN s = 8 AND day(d) = 4 THEN '' ELSE concat('b', CAST(s % 4 AS STRING)) END",
    "day": "CASE WHEN s = 6 AND day(d) = 2 THEN CAST(d AS TIMESTAMP) + INTERVAL 3 HOUR ELSE CAST(d AS TIMESTAMP) END", "y": "CASE WHEN s = 7 AND day(d) = 5 THEN CAST('NaN' AS DOUBLE) ELSE y END", "p": "CASE WHEN s = 7 AND day(d) = 6 THEN CAST('Infinity' AS DOUBLE) WHEN s = 7 AND day(d) = 7 THEN NULL ELSE p END",
}
_CANON = "{0} IS NOT NULL AND {0} = trim({0}) AND length({0}) > 0"
_FINITE = "{0} IS NOT NULL AND NOT isnan({0}) AND NOT isinf({0})"


@query(
    "h23_prediction_faults",
    f"WITH {_made_sql('t', _PRED, 's = 2 AND day(d) = 3')} "
    + " UNION ALL ".join([_rule("unit_text", "t", ("unit", "day"), f"NOT ({_CANON.format('unit')})"), _rule("block_text", "t", ("unit", "day"), f"NOT ({_CANON.format('block')})"), _rule("day", "t", ("unit", "day"), "day <> date_trunc('day', day)"), _rule("truth_not_finite", "t", ("unit", "day"), f"NOT ({_FINITE.format('y')})"), _rule("pred_not_finite", "t", ("unit", "day"), f"NOT ({_FINITE.format('p')})"), _rule("locked", "t", ("unit", "day"), "year(day) >= 2001"), _twice("t", ("unit", "day")), "SELECT 'several_blocks', unit, count(DISTINCT block) FROM t GROUP BY unit HAVING count(DISTINCT block) > 1"]),
)
def h23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prediction_faults(made(keys(spark, sf_dir), _PRED, "s = 2 AND day(d) = 3"), "unit", "block", "day", "y", "p", 2001)


@query("h23_canonical_rows", f"WITH k AS ({_KEYS}) SELECT CAST(s AS VARCHAR) AS unit, 'b' || CAST(s % 4 AS VARCHAR) AS block, d AS day, y, p FROM k")
def h23_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that keeps the contract, with a column too many: typed, and every row there."""
    rows = keys(spark, sf_dir).selectExpr("CAST(s AS STRING) AS unit", "concat('b', CAST(s % 4 AS STRING)) AS block", "CAST(d AS TIMESTAMP) AS day", "y", "p", "q")
    return C.canonical_predictions(rows, "unit", "block", "day", "y", "p", None)


_GROUPS = {k: _PRED[k] for k in ("unit", "day", "block")}


@query(
    "h30_row_group_faults",
    f"WITH {_made_sql('t', _GROUPS, 's = 2 AND day(d) = 3')}, yrs AS (SELECT DISTINCT year(day) AS yr FROM t) "
    + " UNION ALL ".join([_rule("day", "t", ("unit", "day"), "day <> date_trunc('day', day)"), _rule("unit_text", "t", ("unit", "day"), f"NOT ({_CANON.format('unit')})"), _rule("block_text", "t", ("unit", "day"), f"NOT ({_CANON.format('block')})"), _twice("t", ("unit", "day")), _rule("surplus_year", "yrs", ("yr",), "yr NOT IN (1996, 1997, 1998, 1990)"), "SELECT 'missing_year', CAST(y AS VARCHAR), 1 FROM (SELECT unnest([1996, 1997, 1998, 1990]) AS y) WHERE y NOT IN (SELECT yr FROM yrs)"]),
)
def h30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.row_group_faults(made(keys(spark, sf_dir), _GROUPS, "s = 2 AND day(d) = 3"), "unit", "day", "block", [1996, 1997, 1998, 1990])


@query("h31_training_key_faults", f"WITH {_made_sql('t', _GROUPS, 's = 2 AND day(d) = 3')} " + " UNION ALL ".join([_rule("unit_text", "t", ("unit", "day"), f"NOT ({_CANON.format('unit')})"), _rule("day", "t", ("unit", "day"), "day <> date_trunc('day', day)"), _rule("locked", "t", ("unit", "day"), "year(day) >= 2000"), _twice("t", ("unit", "day"))]))
def h31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.training_key_faults(made(keys(spark, sf_dir), _GROUPS, "s = 2 AND day(d) = 3"), "unit", "day", 2000)


# two families and three models of which one pair is absent and one is short; a null, a block of its own, a fold that no family has
_OOF = {"family": "f", "model": "m", "unit": "CAST(s AS STRING)", "day": "d", "block": "CASE WHEN s = 5 AND day(d) = 9 AND m = 'm1' THEN 'other' WHEN s = 4 AND day(d) = 8 AND m = 'm0' THEN NULL ELSE concat('b', CAST(s % 4 AS STRING)) END", "y": "CASE WHEN s = 7 AND day(d) = 5 THEN CAST('NaN' AS DOUBLE) ELSE y END", "p": "p"}
_IDENTITY = ("family", "model", "unit", "day")
_KEEP = "NOT (f = 'temporal' AND m = 'm2') AND NOT (f = 'joint' AND m = 'm1' AND s = 1)"
_OOF_SQL = f"k0 AS ({_KEYS}), k AS (SELECT k0.*, f, m FROM k0, (SELECT unnest(['temporal', 'joint']) AS f), (SELECT unnest(['m0', 'm1', 'm2']) AS m) WHERE {_KEEP}), t AS (SELECT {', '.join(f'{v} AS {c}' for c, v in _OOF.items())} FROM k UNION ALL SELECT {', '.join(f'{v} AS {c}' for c, v in _OOF.items())} FROM k WHERE s = 2 AND day(d) = 3 AND m = 'm0')"


@query(
    "h19_oof_faults",
    f"WITH {_OOF_SQL}, z AS (SELECT family, model, count(*) AS n FROM t GROUP BY 1, 2), due AS (SELECT f, m FROM (SELECT unnest(['temporal', 'joint', 'spatial']) AS f), (SELECT unnest(['m0', 'm1']) AS m)), u AS (SELECT DISTINCT unit, day, block FROM t), c AS (SELECT count(*) AS rows, count(DISTINCT day) AS dates, count(DISTINCT block) AS blocks FROM u) "
    + " UNION ALL ".join([*[_rule(f"null:{c}", "t", _IDENTITY, f"{c} IS NULL") for c in (*_IDENTITY, "block", "y", "p")], _rule("locked", "t", _IDENTITY, "year(day) >= 2001"), _rule("truth_not_finite", "t", _IDENTITY, f"y IS NOT NULL AND NOT ({_FINITE.format('y')})"), _rule("pred_not_finite", "t", _IDENTITY, f"p IS NOT NULL AND NOT ({_FINITE.format('p')})"), _twice("t", _IDENTITY), "SELECT 'missing_pair', f || '|' || m, 1 FROM due WHERE NOT EXISTS (SELECT 1 FROM z WHERE family = f AND model = m)", "SELECT 'surplus_pair', family || '|' || model, 1 FROM z WHERE NOT EXISTS (SELECT 1 FROM due WHERE family = f AND model = m)", "SELECT 'pair_rows', family || '|' || model, n FROM z WHERE n <> (SELECT count(*) FROM k0)", f"SELECT 'several_blocks', {_at('unit', 'day')}, count(*) FROM u GROUP BY unit, day HAVING count(*) > 1", "SELECT 'count:rows', CAST(rows AS VARCHAR), rows FROM c WHERE rows <> (SELECT count(*) FROM k0)", "SELECT 'count:dates', CAST(dates AS VARCHAR), dates FROM c WHERE dates <> (SELECT count(DISTINCT d) FROM k0)", "SELECT 'count:blocks', CAST(blocks AS VARCHAR), blocks FROM c WHERE blocks <> 4"]),
)
def h19(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keys(spark, sf_dir)
    many = k.crossJoin(spark.createDataFrame([(f, m) for f in ("temporal", "joint") for m in ("m0", "m1", "m2")], "f string, m string")).where(_KEEP)
    size = k.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("d").alias("dates")).first()
    return C.oof_faults(made(many, _OOF, "s = 2 AND day(d) = 3 AND m = 'm0'"), _IDENTITY, "block", "day", "y", "p", ["temporal", "joint", "spatial"], ["m0", "m1"], {"rows": size["rows"], "dates": size["dates"], "blocks": 4}, 2001)


_FEATURES = {"unit": "CASE WHEN s = 9 AND day(d) = 1 THEN -9 ELSE s END", "day": "d", "c1": "CASE WHEN s = 6 AND day(d) = 2 THEN NULL ELSE q END", "c2": "CASE WHEN s = 7 AND day(d) = 3 THEN CAST('NaN' AS DOUBLE) ELSE y END", "w1": "CASE WHEN s % 5 = 0 THEN NULL ELSE q END", "w2": "CASE WHEN s % 5 = 0 OR s = 8 AND day(d) = 4 THEN NULL ELSE p END", "v1": "CAST(NULL AS DOUBLE)"}


@query(
    "h12_readiness_faults",
    f"WITH {_made_sql('t', _FEATURES, 's = 2 AND day(d) = 3')} "
    + " UNION ALL ".join([f"SELECT DISTINCT 'missing_key' AS rule, {_at('s', 'd')} AS at, CAST(1 AS BIGINT) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE unit = s AND day = d)", f"SELECT DISTINCT 'surplus_key', {_at('unit', 'day')}, 1 FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE unit = s AND day = d)", _twice("t", ("unit", "day")), _rule("incomplete:static", "t", ("unit", "day"), "c1 IS NULL OR c2 IS NULL"), _rule("partly_missing:weather", "t", ("unit", "day"), "(w1 IS NULL) <> (w2 IS NULL)"), *[_rule(f"not_finite:{c}", "t", ("unit", "day"), f"{c} IS NOT NULL AND NOT ({_FINITE.format(c)})") for c in ("c1", "c2", "w1", "w2")], "SELECT 'no_value', 'v1', 1"]),
)
def h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keys(spark, sf_dir)
    return C.readiness_faults(made(k, _FEATURES, "s = 2 AND day(d) = 3"), k.select(F.col("s").alias("unit"), F.col("d").alias("day")), ["unit", "day"], {"static": ["c1", "c2"], "weather": ["w1", "w2"], "void": ["v1"]}, ["static"])


# acquisitions are ship modes' worth of line numbers; items their return flags; the table says for each supplier what it holds
_INV = "inv AS (SELECT DISTINCT l_linenumber AS acq, l_returnflag || l_linestatus AS item, 'p' || CAST(l_linenumber % 2 AS VARCHAR) AS platform FROM lineitem)"


@query(
    "h14_acquisition_faults",
    f"WITH {_INV}, li AS (SELECT acq, array_to_string(list_sort(list(item)), '|') AS items, any_value(platform) AS platform FROM inv GROUP BY 1), t0 AS (SELECT s_suppkey AS unit, acq, CASE WHEN s_suppkey = 3 AND acq = 2 THEN 'x' || items ELSE items END AS items, CASE WHEN s_suppkey = 4 AND acq = 3 THEN 'p9' ELSE platform END AS platform, s_suppkey * 10 + CASE WHEN s_suppkey = 6 AND acq = 1 THEN 1 ELSE 0 END AS cells FROM supplier, li WHERE NOT (s_suppkey = 5 AND acq = 4)), t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE unit = 7 AND acq = 1 UNION ALL SELECT 8, 99, '', 'p1', 80), j AS (SELECT t.*, li.items AS due, li.platform AS of FROM t JOIN li USING (acq)) "
    + " UNION ALL ".join(["SELECT 'missing_cell' AS rule, CAST(s_suppkey AS VARCHAR) || '|' || CAST(acq AS VARCHAR) AS at, CAST(1 AS BIGINT) AS n FROM supplier, li WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.unit = s_suppkey AND t.acq = li.acq)", "SELECT 'surplus_cell', '8|99', 1", _twice("t", ("unit", "acq")), _rule("items", "j", ("unit", "acq"), "items <> due"), _rule("identity:platform", "j", ("unit", "acq"), "platform <> of"), "SELECT 'denominator', CAST(unit AS VARCHAR), count(DISTINCT cells) FROM t GROUP BY unit HAVING count(DISTINCT cells) > 1"]),
)
def h14(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("acq"), F.concat("l_returnflag", "l_linestatus").alias("item"), F.concat(F.lit("p"), (F.col("l_linenumber") % 2).cast("string")).alias("platform")).distinct()
    units = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"))
    listed = inventory.groupBy("acq").agg(F.array_join(F.sort_array(F.collect_list("item")), "|").alias("items"), F.min("platform").alias("platform"))
    t = units.crossJoin(listed).selectExpr("unit", "acq", "CASE WHEN unit = 3 AND acq = 2 THEN concat('x', items) ELSE items END AS items", "CASE WHEN unit = 4 AND acq = 3 THEN 'p9' ELSE platform END AS platform", "unit * 10 + CASE WHEN unit = 6 AND acq = 1 THEN 1 ELSE 0 END AS cells").where("NOT (unit = 5 AND acq = 4)")
    t = t.unionByName(t.where("unit = 7 AND acq = 1")).unionByName(spark.createDataFrame([(8, 99, "", "p1", 80)], "unit long, acq long, items string, platform string, cells long"))
    return C.acquisition_faults(t, inventory, units, "unit", "acq", ["platform"], "items", "cells")


# lineage: units are nations' remainders, days are quarters, acquisitions line numbers
_LIN = "l AS (SELECT l_suppkey % 8 AS unit, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, l_linenumber AS acq, round(avg(l_quantity), 4) AS v FROM lineitem GROUP BY ALL), lin AS (SELECT unit, day, acq, CASE WHEN unit = 3 AND acq IN (1, 2, 3) THEN NULL ELSE v END AS v FROM l WHERE NOT (unit = 2 AND acq = 4 AND month(day) = 7) AND NOT (acq = 6 AND month(day) = 1) UNION ALL SELECT unit, day, acq, v FROM l WHERE unit = 5 AND acq = 1 AND month(day) = 4)"


@query(
    "h15_lineage_faults",
    f"WITH {_LIN}, held AS (SELECT DISTINCT day, acq FROM lin), mem AS (SELECT DISTINCT day, acq FROM l WHERE NOT (acq = 5 AND month(day) = 10)), a AS (SELECT unit, day, count(v) AS n, CASE WHEN count(v) >= 5 THEN median(v) END AS m FROM lin GROUP BY 1, 2), f AS (SELECT unit, day, CASE WHEN unit = 1 AND month(day) = 1 THEN m + 1 ELSE m END AS f, CASE WHEN unit = 4 AND month(day) = 7 THEN n + 1 ELSE n END AS c FROM a WHERE NOT (unit = 6 AND month(day) = 10)), j AS (SELECT coalesce(a.unit, f.unit) AS unit, coalesce(a.day, f.day) AS day, f, c, n, m FROM a FULL JOIN f ON a.unit = f.unit AND a.day = f.day) "
    + " UNION ALL ".join([f"SELECT 'missing_membership' AS rule, {_at('day', 'acq')} AS at, CAST(1 AS BIGINT) AS n FROM (SELECT * FROM mem EXCEPT SELECT * FROM held)", f"SELECT 'surplus_membership', {_at('day', 'acq')}, 1 FROM (SELECT * FROM held EXCEPT SELECT * FROM mem)", f"SELECT 'unit_set', {_at('day', 'acq')}, count(DISTINCT unit) FROM lin GROUP BY day, acq HAVING count(DISTINCT unit) <> 8", _twice("lin", ("unit", "day", "acq")), _rule("feature", "j", ("unit", "day"), "NOT coalesce(abs(f - m) <= 1e-9, f IS NULL AND m IS NULL)"), _rule("count", "j", ("unit", "day"), "coalesce(c, 0) <> coalesce(n, 0)")]),
)
def h15(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.groupBy((F.col("l_suppkey") % 8).alias("unit"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), F.col("l_linenumber").alias("acq")).agg(F.round(F.avg("l_quantity"), 4).alias("v"))
    lineage = rows.where("NOT (unit = 2 AND acq = 4 AND month(day) = 7) AND NOT (acq = 6 AND month(day) = 1)").withColumn("v", F.expr("CASE WHEN unit = 3 AND acq IN (1, 2, 3) THEN NULL ELSE v END")).unionByName(rows.where("unit = 5 AND acq = 1 AND month(day) = 4"))
    membership = rows.where("NOT (acq = 5 AND month(day) = 10)").select("day", "acq").distinct()
    features = lineage.groupBy("unit", "day").agg(F.count("v").alias("n"), F.median("v").alias("m")).where("NOT (unit = 6 AND month(day) = 10)")
    features = features.selectExpr("unit", "day", "CASE WHEN unit = 1 AND month(day) = 1 THEN CASE WHEN n >= 5 THEN m END + 1 ELSE CASE WHEN n >= 5 THEN m END END AS f", "CASE WHEN unit = 4 AND month(day) = 7 THEN n + 1 ELSE n END AS c")
    return C.lineage_faults(lineage, membership, rows.select("unit").distinct(), features, "unit", "day", "acq", "v", "f", "c", 5)


_TARGET = {
    "unit": "s", "day": "d", "eligible": "CASE WHEN s = 9 THEN 0 ELSE n + 2 END", "valid": "CASE WHEN s = 9 OR s = 8 THEN 0 WHEN s = 1 AND day(d) = 11 THEN n + 3 ELSE n END", "share": "CASE WHEN s = 9 THEN NULL WHEN s = 8 THEN 0.0 WHEN s = 1 AND day(d) = 11 THEN CAST(n + 3 AS DOUBLE) / (n + 2) WHEN s = 2 AND day(d) = 12 THEN 0.25 ELSE CAST(n AS DOUBLE) / (n + 2) END",
    "flag": "CASE WHEN s = 9 OR s = 8 THEN false WHEN s = 1 AND day(d) = 11 THEN true WHEN s = 3 AND day(d) = 13 THEN NOT n >= 2 ELSE n >= 2 END", "reason": "CASE WHEN s = 9 THEN 'no_eligible' WHEN s = 8 THEN 'no_valid' WHEN s = 4 AND day(d) = 14 THEN 'odd' WHEN n >= 2 OR s = 1 AND day(d) = 11 THEN 'ok' ELSE 'low_share' END", "target": "CASE WHEN s = 9 OR s = 8 THEN NULL WHEN s = 5 AND day(d) = 15 THEN CASE WHEN n < 2 THEN y END WHEN n >= 2 OR s = 1 AND day(d) = 11 THEN y END",
}
_FLAG = "coalesce(CASE WHEN eligible > 0 THEN CAST(valid AS DOUBLE) / eligible END >= 0.5, false)"


@query(
    "h17_target_faults",
    f"WITH {_made_sql('t', _TARGET, 's = 6 AND day(d) = 16')}, r AS (SELECT day, count(*) AS units, count(*) FILTER (flag) AS passed, avg(target) AS mean FROM t GROUP BY 1), "
    "z AS (SELECT day, units + CASE WHEN day(day) = 17 THEN 1 ELSE 0 END AS units, passed, CASE WHEN day(day) = 18 THEN mean + 1 ELSE mean END AS mean FROM r) "
    + " UNION ALL ".join([_rule("counts", "t", ("unit", "day"), "NOT (valid <= eligible AND valid >= 0)"), _rule("share", "t", ("unit", "day"), "NOT coalesce(abs(share - CASE WHEN eligible > 0 THEN CAST(valid AS DOUBLE) / eligible END) <= 1e-12, share IS NULL AND eligible = 0)"), _rule("flag", "t", ("unit", "day"), f"flag <> {_FLAG}"), _rule("reason", "t", ("unit", "day"), f"reason <> CASE WHEN eligible = 0 THEN 'no_eligible' WHEN valid = 0 THEN 'no_valid' WHEN NOT {_FLAG} THEN 'low_share' ELSE 'ok' END"), _rule("target", "t", ("unit", "day"), f"(target IS NOT NULL) <> {_FLAG}"), _twice("t", ("unit", "day")), "SELECT 'summary', CAST(day AS VARCHAR) || '|units', 1 FROM r WHERE day(day) = 17", "SELECT 'summary', CAST(day AS VARCHAR) || '|mean', 1 FROM r WHERE day(day) = 18 AND mean IS NOT NULL"]),
)
def h17(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = made(keys(spark, sf_dir), _TARGET, "s = 6 AND day(d) = 16")
    summary = t.groupBy("day").agg(F.count(F.lit(1)).alias("units"), F.count_if("flag").alias("passed"), F.avg("target").alias("mean"))
    summary = summary.selectExpr("day", "units + CASE WHEN day(day) = 17 THEN 1 ELSE 0 END AS units", "passed", "CASE WHEN day(day) = 18 THEN mean + 1 ELSE mean END AS mean")
    return C.target_faults(t, summary, "unit", "day", 0.5)


@query(
    "h22_label_faults",
    f"WITH k AS ({_KEYS}), g AS (SELECT *, day(d) % 3 <> 0 AS gated, row_number() OVER (PARTITION BY d ORDER BY y DESC, s) <= ceil(0.2 * count(*) OVER (PARTITION BY d)) AS top FROM k), t AS (SELECT s, d, gated, top, CASE WHEN s = 3 THEN NOT top WHEN s = 4 THEN NULL WHEN gated OR s = 5 THEN top END AS label FROM g) "
    + " UNION ALL ".join([_rule("label_without_gate", "t", ("s", "d"), "NOT gated AND label IS NOT NULL"), _rule("label_missing", "t", ("s", "d"), "gated AND label IS NULL"), _rule("not_top", "t", ("s", "d"), "gated AND label <> top")]),
)
def h22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: a supplier labelled the wrong way round, one without labels, one that has them on every day."""
    from pyspark.sql import Window

    k, w = keys(spark, sf_dir), Window.partitionBy("d")
    top = F.row_number().over(w.orderBy(F.desc("y"), "s")) <= F.ceil(F.lit(0.2) * F.count(F.lit(1)).over(w))
    rows = k.withColumns({"gated": F.dayofmonth("d") % 3 != 0, "top": top})
    rows = rows.selectExpr("s", "d", "y", "CASE WHEN s = 3 THEN NOT top WHEN s = 4 THEN NULL WHEN gated OR s = 5 THEN top END AS label")
    gates = k.select("d").distinct().withColumn("gated", F.dayofmonth("d") % 3 != 0)
    return C.label_faults(rows, gates, "s", "d", "y", "label", 0.2)


@query(
    "d43_checkpoint_faults",
    f"WITH k AS ({_KEYS}), c AS (SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d, l_linenumber AS scene, sum(l_quantity) AS valid FROM lineitem WHERE NOT (l_suppkey = 4 AND l_linenumber = 1) GROUP BY 1, 2, 3), t0 AS (SELECT s, d, s * 100 + CASE WHEN s = 3 AND day(d) = 5 THEN 1 ELSE 0 END AS cells, q AS valid FROM k), t AS (SELECT * FROM t0 UNION ALL SELECT * FROM t0 WHERE s = 2 AND day(d) = 3), r AS (SELECT d, count(*) AS units, sum(valid) AS valid FROM t GROUP BY 1), z AS (SELECT s, d, sum(valid) AS valid FROM c GROUP BY 1, 2) "
    + " UNION ALL ".join([_twice("t", ("s", "d")), "SELECT 'denominator', CAST(s AS VARCHAR), count(DISTINCT cells) FROM t GROUP BY s HAVING count(DISTINCT cells) > 1", "SELECT 'roll_up', CAST(d AS VARCHAR) || '|valid', 1 FROM r WHERE day(d) = 7", f"SELECT 'contributions', {_at('s', 'd')}, 1 FROM t LEFT JOIN z USING (s, d) WHERE NOT coalesce(abs(t.valid - z.valid) <= 1e-9, false)"]),
)
def d43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: repeated keys, a varying denominator, days whose stored sum is off, and scenes that are not there."""
    li, k = table(spark, sf_dir, "lineitem"), keys(spark, sf_dir)
    scenes = li.where("NOT (l_suppkey = 4 AND l_linenumber = 1)").groupBy(F.col("l_suppkey").alias("s"), F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").alias("scene")).agg(F.sum("l_quantity").alias("valid"))
    rows = k.selectExpr("s", "d", "s * 100 + CASE WHEN s = 3 AND day(d) = 5 THEN 1 ELSE 0 END AS cells", "q AS valid")
    rows = rows.unionByName(rows.where("s = 2 AND day(d) = 3"))
    summary = rows.groupBy("d").agg(F.count(F.lit(1)).alias("units"), F.sum("valid").alias("valid")).withColumn("valid", F.expr("CASE WHEN day(d) = 7 THEN valid + 1 ELSE valid END"))
    return C.checkpoint_faults(rows, summary, scenes, "s", "d")
