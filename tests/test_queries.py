"""Every registered panel query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import numbers
import os

import pandas as pd
import pytest

from tessera.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def text(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "NULL"
        if isinstance(v, numbers.Number) and not isinstance(v, bool):
            return repr(round(float(v), 5) + 0.0)
        return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, twin, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), twin.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"f18_f19_f21_model_pipelines"}))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_boxes_by_cells_equal_all_pairs(spark, twin):
    """The twins of g08 and g09 meet on cells; here every pair is taken."""
    from tessera.plans import queries_geometry as Q

    cover = f"WITH {Q._U}, {Q._A}, k AS (SELECT aid, a0, b0, a1, b1, unnest(range(CAST(floor(a0) AS BIGINT), CAST(floor(a1) AS BIGINT) + 1)) AS kx FROM a), c AS (SELECT *, unnest(range(CAST(floor(b0) AS BIGINT), CAST(floor(b1) AS BIGINT) + 1)) AS ky FROM k), f AS (SELECT aid, kx + 0.5 AS cx, ky + 0.5 AS cy FROM c WHERE kx + 0.5 >= a0 AND kx + 0.5 < a1 AND ky + 0.5 >= b0 AND ky + 0.5 < b1) SELECT aid, round(avg(CASE WHEN EXISTS (SELECT 1 FROM u WHERE cx >= x0 AND cx < x1 AND cy >= y0 AND cy < y1) THEN 1.0 ELSE 0.0 END), 6) AS share FROM f GROUP BY 1"
    pairs = f"WITH {Q._U}, d AS (SELECT a.brand AS held_block, b.id, min(sqrt(power(greatest(0.0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0.0, b.y0 - a.y1, a.y0 - b.y1), 2))) AS distance FROM u a JOIN u b ON a.brand <> b.brand GROUP BY 1, 2) SELECT held_block, id, 'buffer_only' AS role, round(distance, 6) AS distance FROM d WHERE distance <= 1.5 UNION ALL SELECT brand, id, 'held_out', 0.0 FROM u"
    for name, sql in (("g08_union_coverage", cover), ("g09_buffer_units", pairs)):
        assert canonical(registry.queries()[name](spark, SF).toPandas()) == canonical(twin.sql(sql).df())


def test_fold_roles_are_whole(spark, twin):
    """A role for every unit and quarter in every fold, each row once; what a fold tests is its year, its block or both."""
    got = registry.queries()["f11_fold_roles"](spark, SF).toPandas()
    rows = twin.sql("SELECT DISTINCT l_suppkey AS unit, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, year(l_shipdate) AS yr, l_suppkey % 6 AS block FROM lineitem").df()
    years, blocks = set(rows["yr"]), set(rows["block"])
    folds = [("temporal", y, None) for y in years] + [("spatial", None, b) for b in blocks] + [("joint", y, b) for y, b in set(zip(rows["yr"], rows["block"]))]

    def role(r, family, year, block):
        near = family == "joint" and r.unit % 10 == block
        hit = [r.yr == year] * (year is not None) + [r.block == block] * (block is not None)
        return "test" if all(hit) else "purged" if family == "joint" and (any(hit) or near) else "train"

    want = pd.DataFrame([(f, y, None if b is None else str(b), r.unit, r.day, r.yr, r.block, role(r, f, y, b)) for r in rows.itertuples() for f, y, b in folds], columns=["family", "held_year", "held_block", "unit", "day", "yr", "block", "role"])
    assert len(got) == len(rows) * len(folds) and sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
