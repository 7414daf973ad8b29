"""Planar geometry over the test tables (inventory G). Parts give coordinates: size and price as x and y, boxes and polygons around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table

_U = "u AS (SELECT p_partkey AS id, p_brand AS brand, CAST(p_size AS DOUBLE) AS x0, p_retailprice / 10 AS y0, p_size + 3.0 AS x1, p_retailprice / 10 + 4.0 AS y1 FROM part)"
_S = "s AS (SELECT s_suppkey AS sid, CAST(s_suppkey % 40 AS DOUBLE) AS x1, s_acctbal / 100 + 90 AS y1, s_suppkey % 40 + s_nationkey / 10.0 AS x2, s_acctbal / 100 + 93 AS y2 FROM supplier)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("x0"), (F.col("p_retailprice") / 10).alias("y0"), (F.col("p_size") + 3.0).alias("x1"), (F.col("p_retailprice") / 10 + 4.0).alias("y1"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 40
    return s.select(F.col("s_suppkey").alias("sid"), k.cast("double").alias("x1"), (F.col("s_acctbal") / 100 + 90).alias("y1"), (k + F.col("s_nationkey") / 10.0).alias("x2"), (F.col("s_acctbal") / 100 + 93).alias("y2"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") % 5) * 10, F.floor(F.col("n_nationkey") / 5) * 20 + 90
    return n.select(F.col("n_nationkey").alias("aid"), x.cast("double").alias("a0"), y.cast("double").alias("b0"), (x + 8.0).alias("a1"), (y + 15.0).alias("b1"))


_A = "a AS (SELECT n_nationkey AS aid, CAST(n_nationkey % 5 * 10 AS DOUBLE) AS a0, CAST(n_nationkey // 5 * 20 + 90 AS DOUBLE) AS b0, n_nationkey % 5 * 10 + 8.0 AS a1, n_nationkey // 5 * 20 + 90 + 15.0 AS b1 FROM nation)"
_OVER = "greatest(0.0, least(x1, a1) - greatest(x0, a0)) * greatest(0.0, least(y1, b1) - greatest(y0, b0))"
_BOX, _ABOX = ("x0", "y0", "x1", "y1"), ("a0", "b0", "a1", "b1")


@query("g01_g21_fixed_grid", f"WITH {_U}, b AS (SELECT brand, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM u GROUP BY 1) SELECT brand, floor((x0 - 1) / 5) * 5 + 1 AS gx0, floor((y0 - 2) / 5) * 5 + 2 AS gy0, ceil((x1 - 1) / 5) * 5 + 1 AS gx1, ceil((y1 - 2) / 5) * 5 + 2 AS gy1, CAST(round(((ceil((x1 - 1) / 5) - floor((x0 - 1) / 5)))) AS BIGINT) AS width, CAST(round(ceil((y1 - 2) / 5) - floor((y0 - 2) / 5)) AS BIGINT) AS height, CAST(round((ceil((x1 - 1) / 5) - floor((x0 - 1) / 5)) * (ceil((y1 - 2) / 5) - floor((y0 - 2) / 5))) AS BIGINT) AS cells FROM b")
def g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).groupBy("brand").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    grid = G.fixed_grid(b, 1.0, 2.0, 5.0)
    cells = G.grid_cells(grid, 5.0).groupBy("brand").agg(F.count(F.lit(1)).alias("cells"))
    return grid.join(cells, "brand").select("brand", *[F.col(c).cast("double").alias(c) for c in ("gx0", "gy0", "gx1", "gy1")], "width", "height", "cells")


@query("g02_g03_select_by_share", f"WITH {_U}, {_A}, o AS (SELECT id, sum({_OVER}) AS area FROM u, a GROUP BY 1) SELECT id, round(area / 12.0, 6) AS share, NOT (area = 0 OR id % 11 = 0 OR area / 12.0 < 0.5) AS selected, CASE WHEN area = 0 THEN 'outside' WHEN id % 11 = 0 THEN 'special_use' WHEN area / 12.0 < 0.5 THEN 'small_share' ELSE 'selected' END AS reason FROM o")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = boxes(spark, sf_dir)
    overlaps = G.overlapping_boxes(u, areas(spark, sf_dir), "id", "aid", _BOX, _ABOX, 10.0)
    return rounded(G.select_by_share(u.withColumns({"area_own": F.lit(12.0), "special": F.col("id") % 11 == 0}), overlaps, "id", "area_own", 0.5, "special"), "share")


@query("g04_standardise", "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS geoid, c_name AS name, c_nationkey AS state FROM customer WHERE length(trim(c_name)) > 0")
def g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scalars import is_canonical, zero_pad

    return table(spark, sf_dir, "customer").where(is_canonical(F.col("c_name"))).select(zero_pad(F.col("c_custkey"), 8).alias("geoid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("state"))


@query("g05_g07_g26_cell_overlap", f"WITH {_A}, k AS (SELECT aid, a0, b0, a1, b1, unnest(range(CAST(floor(a0 / 4) AS BIGINT), CAST(floor(a1 / 4) AS BIGINT) + 1)) AS kx FROM a), c AS (SELECT *, unnest(range(CAST(floor(b0 / 4) AS BIGINT), CAST(floor(b1 / 4) AS BIGINT) + 1)) AS ky FROM k), o AS (SELECT aid, kx, ky, greatest(0.0, least(a1, kx * 4 + 4) - greatest(a0, kx * 4)) * greatest(0.0, least(b1, ky * 4 + 4) - greatest(b0, ky * 4)) AS area FROM c) SELECT aid, kx, ky, round(area, 6) AS area, round(area / 16, 6) AS share FROM o WHERE area > 0")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles (cells) that meet an area, with the area they share."""
    c = G.cells_of_box(areas(spark, sf_dir), *_ABOX, 4.0).withColumns({"t0": F.col("kx") * 4.0, "s0": F.col("ky") * 4.0, "t1": F.col("kx") * 4.0 + 4, "s1": F.col("ky") * 4.0 + 4})
    c = c.withColumn("area", G.box_overlap(_ABOX, ("t0", "s0", "t1", "s1"))).where("area > 0")
    return c.select("aid", "kx", "ky", F.round("area", 6).alias("area"), F.round(F.col("area") / 16, 6).alias("share"))


@query("g06_index_window", f"WITH {_A} SELECT aid, CAST(floor(a0 / 4) - 1 AS BIGINT) AS c0, CAST(ceil(a1 / 4) + 1 AS BIGINT) AS c1, CAST(floor(b0 / 4) - 1 AS BIGINT) AS r0, CAST(ceil(b1 / 4) + 1 AS BIGINT) AS r1 FROM a")
def g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return areas(spark, sf_dir).select("aid", (F.floor(F.col("a0") / 4) - 1).alias("c0"), (F.ceil(F.col("a1") / 4) + 1).alias("c1"), (F.floor(F.col("b0") / 4) - 1).alias("r0"), (F.ceil(F.col("b1") / 4) + 1).alias("r1"))


# the footprints' cells by an equi-join on cells, so that all footprints can be taken
_COVERED = f"WITH {_U}, {_A}, k AS (SELECT aid, a0, b0, a1, b1, unnest(range(CAST(floor(a0) AS BIGINT), CAST(floor(a1) AS BIGINT) + 1)) AS kx FROM a), c AS (SELECT *, unnest(range(CAST(floor(b0) AS BIGINT), CAST(floor(b1) AS BIGINT) + 1)) AS ky FROM k), f AS (SELECT aid, kx, ky FROM c WHERE kx + 0.5 >= a0 AND kx + 0.5 < a1 AND ky + 0.5 >= b0 AND ky + 0.5 < b1), h AS (SELECT x0, y0, x1, y1, unnest(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS kx FROM u), i AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT) + 1)) AS ky FROM h), m AS (SELECT DISTINCT kx, ky FROM i WHERE kx + 0.5 >= x0 AND kx + 0.5 < x1 AND ky + 0.5 >= y0 AND ky + 0.5 < y1)"


@query("g08_union_coverage", f"{_COVERED} SELECT aid, round(avg(CASE WHEN m.kx IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM f LEFT JOIN m USING (kx, ky) GROUP BY 1")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.union_coverage(areas(spark, sf_dir), boxes(spark, sf_dir), "aid", _ABOX, _BOX, 1.0), "share")


# units meet on cells of the radius: those of one side's box widened by it
_MEET = f"WITH {_U}, p AS (SELECT *, unnest(range(CAST(floor((x0 - 1.5) / 1.5) AS BIGINT), CAST(floor((x1 + 1.5) / 1.5) AS BIGINT) + 1)) AS kx FROM u), a AS (SELECT *, unnest(range(CAST(floor((y0 - 1.5) / 1.5) AS BIGINT), CAST(floor((y1 + 1.5) / 1.5) AS BIGINT) + 1)) AS ky FROM p), q AS (SELECT *, unnest(range(CAST(floor(x0 / 1.5) AS BIGINT), CAST(floor(x1 / 1.5) AS BIGINT) + 1)) AS kx FROM u), b AS (SELECT *, unnest(range(CAST(floor(y0 / 1.5) AS BIGINT), CAST(floor(y1 / 1.5) AS BIGINT) + 1)) AS ky FROM q)"


@query("g09_buffer_units", f"{_MEET}, d AS (SELECT a.brand AS held_block, b.id, min(sqrt(power(greatest(0.0, b.x0 - a.x1, a.x0 - b.x1), 2) + power(greatest(0.0, b.y0 - a.y1, a.y0 - b.y1), 2))) AS distance FROM a JOIN b ON a.kx = b.kx AND a.ky = b.ky AND a.brand <> b.brand GROUP BY 1, 2) SELECT held_block, id, 'buffer_only' AS role, round(distance, 6) AS distance FROM d WHERE distance <= 1.5 UNION ALL SELECT brand, id, 'held_out', 0.0 FROM u")
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.buffer_units(boxes(spark, sf_dir), "id", "brand", _BOX, 1.5), "distance")


_NEAR = "n AS (SELECT id, sid, sqrt(power(px - (x1 + t * (x2 - x1)), 2) + power(py - (y1 + t * (y2 - y1)), 2)) AS d FROM (SELECT *, CASE WHEN x2 = x1 AND y2 = y1 THEN 0.0 ELSE greatest(0.0, least(1.0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) END AS t FROM (SELECT id, x0 AS px, y0 AS py FROM u), s))"


@query("g10_g11_g23_nearest_segment", f"WITH {_U}, {_S}, {_NEAR}, m AS (SELECT id, min(d) AS distance FROM n GROUP BY 1 HAVING min(d) <= 12) SELECT m.id, round(distance, 6) AS distance, min(sid) AS sid, count(DISTINCT sid) AS ties FROM m JOIN n ON m.id = n.id AND n.d - distance <= 0.001 GROUP BY 1, 2")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = boxes(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return rounded(G.nearest_segment(points, lines(spark, sf_dir), "id", "sid", 12.0, 0.001), "distance")


@query("g12_accepted_radius", f"WITH {_U}, {_S}, {_NEAR}, m AS (SELECT id, min(d) AS distance FROM n GROUP BY 1 HAVING min(d) <= 50) SELECT id % 10 AS grp, round(max(distance), 6) AS farthest, CASE WHEN max(distance) < 2 THEN 2.0 WHEN max(distance) < 5 THEN 5.0 WHEN max(distance) < 50 THEN 50.0 END AS radius FROM m GROUP BY 1")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = boxes(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    near = G.nearest_segment(points, lines(spark, sf_dir), "id", "sid", 50.0).withColumn("grp", F.col("id") % 10)
    return rounded(G.accepted_radius(near, ["grp"], [2.0, 5.0, 50.0]), "farthest")


@query("g13_g14_geodesic", f"WITH {_S}, d AS (SELECT sid, k, x1 + (x2 - x1) * k / 4 AS vx, (y1 + (y2 - y1) * k / 4) / 4 AS vy FROM s, (SELECT unnest(range(5)) AS k)) SELECT sid, round(min(2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(vy - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(vy)) * power(sin(radians(vx - 20.0) / 2), 2))))), 3) AS metres FROM d GROUP BY 1")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = G.densify(lines(spark, sf_dir), 4)
    return d.groupBy("sid").agg(F.round(F.min(G.haversine(F.lit(20.0), F.lit(40.0), F.col("vx"), F.col("vy") / 4)), 3).alias("metres"))


_V = "v AS (SELECT l_suppkey AS poly, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS seq, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"
_E = "e AS (SELECT poly, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY poly ORDER BY seq))"


def polygon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")).cast("long")
    v = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("poly"), seq.alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return G.ring_edges(v, "poly", "seq", "x", "y")


@query("g15_g16_line_chunks", f"WITH {_V}, {_E}, r AS (SELECT *, sum(CASE WHEN abs(x2 - x1) > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY poly ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM e), k AS (SELECT poly, run, row_number() OVER (PARTITION BY poly, run ORDER BY seq) - 1 AS i FROM r WHERE abs(x2 - x1) <= 30) SELECT poly, CAST(run AS VARCHAR) || '-' || CAST(i // 8 AS VARCHAR) AS chunk, count(*) AS edges FROM k GROUP BY 1, 2")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.line_chunks(polygon_edges(spark, sf_dir), "poly", "seq", 8, 30.0).groupBy("poly", "chunk").agg(F.count(F.lit(1)).alias("edges"))


@query("g17_g18_g22_g24_point_in_polygon", f"WITH {_V}, {_E}, p AS (SELECT n_nationkey AS point, n_nationkey * 2 + 0.25 AS px, n_nationkey * 3 + 5.125 AS py FROM nation) SELECT point, poly FROM p JOIN e ON (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (CASE WHEN y2 <> y1 THEN y2 - y1 END) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    points = table(spark, sf_dir, "nation").select(k.alias("point"), (k * 2 + 0.25).alias("px"), (k * 3 + 5.125).alias("py"))
    return G.points_in_polygons(points, polygon_edges(spark, sf_dir), "point", "poly", 10.0)


@query("g19_horn_slope", "WITH c AS (SELECT CAST(p_partkey // 40 AS BIGINT) AS r, p_partkey % 40 AS c, p_retailprice AS v FROM part), n AS (SELECT a.r, a.c, max(CASE WHEN b.r = a.r - 1 AND b.c = a.c - 1 THEN b.v END) AS n00, max(CASE WHEN b.r = a.r - 1 AND b.c = a.c THEN b.v END) AS n01, max(CASE WHEN b.r = a.r - 1 AND b.c = a.c + 1 THEN b.v END) AS n02, max(CASE WHEN b.r = a.r AND b.c = a.c - 1 THEN b.v END) AS n10, max(CASE WHEN b.r = a.r AND b.c = a.c + 1 THEN b.v END) AS n12, max(CASE WHEN b.r = a.r + 1 AND b.c = a.c - 1 THEN b.v END) AS n20, max(CASE WHEN b.r = a.r + 1 AND b.c = a.c THEN b.v END) AS n21, max(CASE WHEN b.r = a.r + 1 AND b.c = a.c + 1 THEN b.v END) AS n22 FROM c a JOIN c b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2) SELECT r, c, round(degrees(atan(sqrt(power(((n02 + 2 * n12 + n22) - (n00 + 2 * n10 + n20)) / 240, 2) + power(((n20 + 2 * n21 + n22) - (n00 + 2 * n01 + n02)) / 240, 2)))), 6) AS slope FROM n")
def g19(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).alias("r"), (F.col("p_partkey") % 40).alias("c"), F.col("p_retailprice").alias("v"))
    return rounded(G.horn_slope(c, [], "r", "c", "v", 30.0, 30.0).drop("v"), "slope")


@query("g20_support", "SELECT p_brand AS zone, count(*) AS cells, CAST(min(p_partkey) AS BIGINT) AS first_cell, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS members FROM part WHERE p_size NOT IN (11, 12) GROUP BY 1")
def g20(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "part").where("p_size not in (11, 12)").groupBy(F.col("p_brand").alias("zone")).agg(F.count(F.lit(1)).alias("cells"), F.min("p_partkey").alias("first_cell"), members.alias("members"))


@query("g25_envelope", "SELECT s_suppkey, round(s_nationkey - (5.0 / (111.320 * cos(radians(least(89.0, abs(s_acctbal / 200) + 5.0 / 110.574))))), 6) AS lon0, round(s_acctbal / 200 - 5.0 / 110.574, 6) AS lat0, round(s_nationkey + (5.0 / (111.320 * cos(radians(least(89.0, abs(s_acctbal / 200) + 5.0 / 110.574))))), 6) AS lon1, round(s_acctbal / 200 + 5.0 / 110.574, 6) AS lat1 FROM supplier")
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.envelope(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 200, F.lit(5.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(v, 6).alias(k) for k, v in e.items()])


@query("g27_probe_gate", f"WITH {_U}, {_S}, {_NEAR}, a AS (SELECT id, min(d) AS near_all, min(d) FILTER (sid % 2 = 0) AS near_half FROM n GROUP BY 1) SELECT id, round(near_all, 6) AS inclusive, round(near_half, 6) AS baseline FROM a WHERE near_all <= 12 AND near_half <= 12 AND NOT near_all < near_half - 0.01")
def g27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes whose nearest segment is not strictly better than the baseline's: two runs of the search, joined."""
    points = boxes(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    near = lambda s, name: G.nearest_segment(points, s, "id", "sid", 12.0).select("id", F.col("distance").alias(name))
    j = near(lines(spark, sf_dir), "inclusive").join(near(lines(spark, sf_dir).where("sid % 2 = 0"), "baseline"), "id")
    return rounded(j.where(~(F.col("inclusive") < F.col("baseline") - 0.01)), "inclusive", "baseline")
