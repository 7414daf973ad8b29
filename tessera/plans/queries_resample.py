"""Splits, bootstraps, spatial statistics over the test tables (inventory F, first half)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resample as R
from tessera.operators import splits as S
from tessera.plans.queries_metrics import PAIRS_SQL, pairs, rounded
from tessera.plans.registry import query
from tessera.session import table

_CELLS = f"{PAIRS_SQL}, cells AS (SELECT {{k}}date_trunc('quarter', day) AS q, l_suppkey % 8 AS block, count(*) AS n, sum(abs(p - y)) AS bs, sum(abs(l_quantity * 1500 - y)) AS ts FROM pairs GROUP BY ALL)"


def cells(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumns({"q": F.date_trunc("quarter", "day"), "block": F.col("l_suppkey") % 8, "flat": F.col("l_quantity") * 1500})
    return R.error_cells(rows, by, "q", "block", "y", "p", "flat")


@query("f01_error_cells", f"WITH {_CELLS.format(k='family, ')} SELECT family, CAST(q AS DATE) AS q, block, n, round(bs, 2) AS baseline_sum, round(ts, 2) AS target_sum FROM cells")
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cells(spark, sf_dir, ["family"]).withColumn("q", F.to_date("q")), "baseline_sum", "target_sum", digits=2)


def _bootstrap_sql(by: str, seed: int, replicates: int, keep: int | None = None) -> str:
    """The same draws and sums in SQL; by is empty or one column."""
    k, text = (f"{by}, ", f"{by} || ':' || ") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    on = f"AND c.{by} = m.{by}" if by else ""

    def mult(column: str, kind: str) -> str:
        return f"""
        dim_{kind} AS (SELECT {k}{column}, row_number() OVER ({part}ORDER BY {column}) - 1 AS i, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {k}{column} FROM cells)),
        draw_{kind} AS (SELECT {k}rep, CAST('0x' || substr(md5('{seed}:{kind}:' || {text}CAST(rep AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) % n AS i FROM dim_{kind}, reps),
        m_{kind} AS (SELECT {", ".join(f"d.{c}" for c in ([by] if by else []) + [column])}, w.rep, count(*) AS m FROM draw_{kind} w JOIN dim_{kind} d ON d.i = w.i {f"AND d.{by} = w.{by}" if by else ""} GROUP BY ALL)"""

    kept = f"reps_used AS (SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY rep) AS r FROM per_rep) WHERE r <= {keep})" if keep else "reps_used AS (SELECT * FROM per_rep)"
    return f"""
    WITH {_CELLS.format(k=k)}, reps AS (SELECT unnest(range({replicates})) AS rep), {mult('q', 'd')}, {mult('block', 'b')},
    per_date AS (SELECT {f"c.{by}, " if by else ""}m.rep, c.q, any_value(m.m) AS m, sum(c.bs * b.m) / sum(c.n * b.m) AS b, sum(c.ts * b.m) / sum(c.n * b.m) AS t
      FROM cells c JOIN m_d m ON c.q = m.q {on} JOIN m_b b ON b.rep = m.rep AND b.block = c.block {f"AND b.{by} = c.{by}" if by else ""} GROUP BY ALL),
    per_rep AS (SELECT {k}rep, sum(b * m) / sum(m) AS b, sum(t * m) / sum(m) AS t FROM per_date GROUP BY ALL), {kept}
    SELECT {k}count(*) AS used, {replicates} - count(*) AS empty, round(quantile_cont(b - t, 0.025), 4) AS low, round(quantile_cont(b - t, 0.975), 4) AS high, round(quantile_cont((b - t) / b, 0.025), 6) AS relative_low, round(quantile_cont((b - t) / b, 0.975), 6) AS relative_high,
      round(avg(CASE WHEN b - t > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_better, round(avg(CASE WHEN (b - t) / b > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS p_much_better FROM reps_used {f"GROUP BY {by}" if by else ""}
    """


_ROUND = ("relative_low", "relative_high", "p_better", "p_much_better")


@query("f02_f06_crossed_bootstrap", _bootstrap_sql("", 7, 5000))
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(R.crossed_bootstrap(cells(spark, sf_dir, []), "q", "block", 7, 5000), "low", "high", digits=4), *_ROUND)


@query("f03_sparse_bootstrap", _bootstrap_sql("", 11, 6000, 5000))
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(R.crossed_bootstrap(cells(spark, sf_dir, []), "q", "block", 11, 6000, keep=5000), "low", "high", digits=4), *_ROUND)


@query("f04_f05_cohort_bootstrap", _bootstrap_sql("family", 5, 5000))
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(R.crossed_bootstrap(cells(spark, sf_dir, ["family"]), "q", "block", 5, 5000, by=["family"]), "low", "high", digits=4), *_ROUND)


@query("f07_f26_gates", "WITH s AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t, count(*) AS n FROM lineitem), g AS (SELECT 'quantity' AS gate, round(q, 6) AS observed, 20.0 AS threshold, q > 20 AS passed, true AS required FROM s UNION ALL SELECT 'tax', round(t, 6), 0.01, t < 0.01, false FROM s UNION ALL SELECT 'rows', n, 10, n > 10, true FROM s) SELECT gate, CAST(observed AS DOUBLE) AS observed, CAST(threshold AS DOUBLE) AS threshold, passed, required, (SELECT bool_and(passed) FILTER (required) FROM g) AS all_passed FROM g")
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").agg(F.avg("l_quantity").alias("q"), F.avg("l_tax").alias("t"), F.count(F.lit(1)).alias("n"))
    return rounded(R.gates(s, [("quantity", "q", ">", 20, True), ("tax", "t", "<", 0.01, False), ("rows", "n", ">", 10, True)]), "observed")


_BLOCKS = "b AS (SELECT l_returnflag AS grp, CAST(floor(l_suppkey % 25 / 5) AS BIGINT) AS bx, l_suppkey % 5 AS by_, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.floor(F.col("l_suppkey") % 25 / 5).alias("bx"), (F.col("l_suppkey") % 5).alias("by_")).agg(F.avg("l_extendedprice").alias("v"))


@query("f08_rook_edges", f"WITH {_BLOCKS} SELECT a.grp, a.bx, a.by_, c.bx AS x2, c.by_ AS y2 FROM b a JOIN b c ON a.grp = c.grp AND ((c.bx = a.bx + 1 AND c.by_ = a.by_) OR (c.bx = a.bx AND c.by_ = a.by_ + 1))")
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rook_edges(blocks(spark, sf_dir), ["grp"])


@query(
    "f09_f10_d31_morans_i",
    f"""
    WITH {_BLOCKS}, z AS (SELECT *, v - avg(v) OVER (PARTITION BY grp) AS z FROM b),
    e AS (SELECT a.grp, count(*) AS edges, sum(a.z * c.z) AS s FROM z a JOIN z c ON a.grp = c.grp AND ((c.bx = a.bx + 1 AND c.by_ = a.by_) OR (c.bx = a.bx AND c.by_ = a.by_ + 1)) GROUP BY 1),
    n AS (SELECT grp, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY 1)
    SELECT grp, n, edges, round(CAST(n AS DOUBLE) / edges * s / zz, 6) AS moran, round(-1.0 / (n - 1), 6) AS expected FROM n JOIN e USING (grp)
    """,
)
def f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.morans_i(blocks(spark, sf_dir), ["grp"], "v").drop("p"), "moran", "expected")


@query("f09_moran_permutations")
def f09p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.morans_i(blocks(spark, sf_dir), ["grp"], "v", permutations=199, seed=3)


# rows of the split queries: one a supplier and quarter, blocks by nation
_ROWS = "r AS (SELECT DISTINCT l_suppkey AS unit, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, year(l_shipdate) AS yr, l_suppkey % 6 AS block FROM lineitem)"
_FOLDS = "f AS (SELECT 'temporal' AS family, yr AS held_year, CAST(NULL AS VARCHAR) AS held_block FROM r UNION SELECT 'spatial', NULL, CAST(block AS VARCHAR) FROM r UNION SELECT 'joint', yr, CAST(block AS VARCHAR) FROM r)"
# a temporal or spatial fold only tests and trains; a joint fold trains on neither its year, nor its block, nor units near it
_ROLES = """roles AS (SELECT *, 'temporal' AS kind, CASE WHEN yr = held_year THEN 'test' ELSE 'train' END AS role FROM r, f WHERE family = 'temporal'
    UNION ALL SELECT *, 'spatial', CASE WHEN CAST(block AS VARCHAR) = held_block THEN 'test' ELSE 'train' END FROM r, f WHERE family = 'spatial'
    UNION ALL SELECT *, 'joint', CASE WHEN yr <> held_year AND CAST(block AS VARCHAR) <> held_block AND unit % 10 <> CAST(held_block AS BIGINT) THEN 'train' WHEN yr = held_year AND CAST(block AS VARCHAR) = held_block THEN 'test' ELSE 'purged' END FROM r, f WHERE family = 'joint')"""


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("unit"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day"), F.year("l_shipdate").cast("long").alias("yr"), (F.col("l_suppkey") % 6).alias("block")).distinct()


def near_units(rows: DataFrame) -> DataFrame:
    """Units within the buffer of a held block: here, those whose last digit is the block's."""
    return rows.select("unit").distinct().withColumn("held_block", F.explode(F.array(*[F.lit(str(b)) for b in range(6)]))).where(F.col("unit") % 10 == F.col("held_block").cast("long"))


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    return S.fold_roles(rows, S.fold_table(rows, "yr", "block"), "yr", "block", near_units(rows), "unit")


@query("f11_fold_roles", f"WITH {_ROWS}, {_FOLDS}, {_ROLES} SELECT family, held_year, held_block, unit, day, yr, block, role FROM roles")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of every row in every fold."""
    return roles(spark, sf_dir).drop("fold")


@query("f12_inner_roles", f"WITH {_ROWS}, {_FOLDS}, {_ROLES}, t AS (SELECT * FROM roles WHERE role = 'train' AND family = 'temporal') SELECT t.held_year, y.yr AS inner_year, count(*) AS n, count(*) FILTER (t.yr = y.yr) AS validation FROM t JOIN (SELECT DISTINCT held_year, yr FROM t) y USING (held_year) GROUP BY 1, 2")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = S.inner_roles(roles(spark, sf_dir).where("family = 'temporal'"), "held_year", "yr")
    return inner.groupBy("held_year", "inner_year").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("inner_role") == "validation").alias("validation"))


@query("f13_fold_definitions", f"WITH {_ROWS}, {_FOLDS}, {_ROLES} SELECT family, held_year, held_block, " + ", ".join(f"count(*) FILTER (role = '{r}') AS {r}_rows, count(DISTINCT CASE WHEN role = '{r}' THEN day END) AS {r}_dates, count(DISTINCT CASE WHEN role = '{r}' THEN unit END) AS {r}_units, count(DISTINCT CASE WHEN role = '{r}' THEN block END) AS {r}_blocks" for r in ("train", "test", "purged")) + " FROM roles GROUP BY 1, 2, 3")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    return S.fold_definitions(rows, S.fold_table(rows, "yr", "block"), ["family", "held_year", "held_block"], "yr", "block", "day", "unit", near_units(rows))


@query("f14_coverage_audit", f"WITH {_ROWS}, {_FOLDS}, {_ROLES}, r2 AS (SELECT *, 1 AS k FROM roles WHERE NOT (family = 'joint' AND held_year = 1996) UNION ALL SELECT *, 2 FROM roles WHERE family = 'spatial' AND held_block = '3') SELECT family, unit, day, yr, count(*) FILTER (role = 'test') AS times FROM r2 GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (role = 'test') <> 1")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted: a year's joint folds left out, so that its rows are never tested, and a spatial fold listed twice."""
    rows = split_rows(spark, sf_dir)
    folds = S.fold_table(rows, "yr", "block")
    bad = folds.where("not (family = 'joint' and held_year = 1996)").unionByName(folds.where("family = 'spatial' and held_block = '3'"))
    return S.coverage_violations(rows, bad, ["unit", "day", "yr"], "yr", "block")


@query("f15_task_plan", f"WITH {_ROWS}, {_FOLDS} SELECT family, held_year, held_block, candidate, CAST(inner_year AS BIGINT) AS inner_year FROM f, (SELECT r_name AS candidate FROM region), (SELECT DISTINCT yr AS inner_year FROM r) WHERE family <> 'joint'")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_rows(spark, sf_dir)
    plan = S.task_plan(S.fold_table(rows, "yr", "block", ("temporal", "spatial")), table(spark, sf_dir, "region").select(F.col("r_name").alias("candidate")), rows.select(F.col("yr").alias("inner_year")).distinct())
    return plan.select("family", "held_year", "held_block", "candidate", "inner_year")
