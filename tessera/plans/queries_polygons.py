"""Polygons with slanted sides, notches and holes over the test tables (inventory G, and D38, E12): parts and suppliers place them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import polygons as P
from tessera.operators import windows as W
from tessera.plans.queries_geometry import _ABOX, _A, _NEAR, _S, _U, areas, boxes, lines
from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table

# an outline with a notch, drawn clockwise, and a triangular hole, as offsets from a polygon's corner: (ring, hole, x1, y1, x2, y2)
_OUTLINE = [(0.0, 0.0), (0.0, 4.0), (1.5, 1.5), (3.0, 4.0), (3.5, -0.5)]
_HOLE = [(1.25, 0.25), (1.75, 0.25), (1.5, 1.0)]
SHAPE = [(k, bool(k), *a, *b) for k, ring in enumerate((_OUTLINE, _HOLE)) for a, b in zip(ring, ring[1:] + ring[:1])]
# a zone: a hexagon in a nation's place
_HEX = [(0.0, 6.0), (2.5, 0.0), (8.0, 1.0), (9.5, 8.0), (5.0, 15.0), (1.0, 13.0)]
ZONE = [(0, False, *a, *b) for a, b in zip(_HEX, _HEX[1:] + _HEX[:1])]


def _values(shape) -> str:
    return ", ".join(f"({r}, {h}, {', '.join(map(str, c))})" for r, h, *c in shape).lower()


def placed(df: DataFrame, keys: list[str], x: str, y: str, shape) -> DataFrame:
    """The shape's edges at each row's place."""
    kept = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(h).alias("hole"), *[F.lit(v).alias(n) for v, n in zip(c, ("dx1", "dy1", "dx2", "dy2"))]) for r, h, *c in shape])
    e = df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), F.explode(kept).alias("s")).select(*keys, "__x", "__y", "s.*")
    return e.select(*keys, "ring", "hole", *[(F.col(f"__{n[1]}") + F.col(n)).alias(n[1:]) for n in ("dx1", "dy1", "dx2", "dy2")])


# pieces in SQL: signs from the ring's drawn direction, which the shapes fix (outlines run clockwise, the hole and the zone the other way)
def _pieces_sql(name: str, key: str, source: str, x: str, y: str, shape, signs: dict[int, int]) -> str:
    sign = "CASE ring " + " ".join(f"WHEN {r} THEN {s}" for r, s in signs.items()) + " END"
    return f"{name} AS (SELECT {key}, least({x} + dx1, {x} + dx2) AS x1, CASE WHEN dx1 < dx2 THEN {y} + dy1 ELSE {y} + dy2 END AS y1, greatest({x} + dx1, {x} + dx2) AS x2, CASE WHEN dx1 < dx2 THEN {y} + dy2 ELSE {y} + dy1 END AS y2, {sign} * CASE WHEN dx1 < dx2 THEN 1 ELSE -1 END AS w FROM {source}, (VALUES {_values(shape)}) s(ring, hole, dx1, dy1, dx2, dy2) WHERE dx1 <> dx2)"


_PARTS = _pieces_sql("b", "id", "u", "x0", "y0", SHAPE, {0: 1, 1: 1})
_ZONES = _pieces_sql("z", "aid", "a", "a0", "b0", ZONE, {0: -1})
_SHAPE_AREA, _ZONE_AREA = (abs(sum(s * (x2 - x1) * (y1 + y2) / 2 for (r, _, x1, y1, x2, y2) in shape for s in [1])) for shape in (SHAPE, ZONE))


def part_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a part has eight edges: parts are dealt out before they have any, and what follows by id needs no further shuffle
    return P.pieces(placed(boxes(spark, sf_dir).select("id", "x0", "y0").repartition("id"), ["id"], "x0", "y0", SHAPE), ["id"])


def zone_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pieces(placed(areas(spark, sf_dir), ["aid"], "a0", "b0", ZONE), ["aid"])


_LINE = "{n}.y1 + ({n}.y2 - {n}.y1) * ({x} - {n}.x1) / ({n}.x2 - {n}.x1)"
# every piece with every cell of its polygon's box, the area under it inside the cell by thirds of where it runs
_CELLS = f"""WITH {_U}, {_PARTS}, k AS (SELECT id, min(x1) AS lx, max(x2) AS hx, min(least(y1, y2)) AS ly, max(greatest(y1, y2)) AS hy FROM b GROUP BY 1),
    kx AS (SELECT *, unnest(range(CAST(floor(lx / 2) AS BIGINT), CAST(floor(hx / 2) AS BIGINT) + 1)) AS kx FROM k), c AS (SELECT *, unnest(range(CAST(floor(ly / 2) AS BIGINT), CAST(floor(hy / 2) AS BIGINT) + 1)) AS ky FROM kx),
    e AS (SELECT c.id, kx, ky, w, greatest(b.x1, kx * 2) AS u, least(b.x2, kx * 2 + 2) AS v, b.x1, b.y1, b.x2, b.y2 FROM c JOIN b ON b.id = c.id AND b.x2 > kx * 2 AND b.x1 < kx * 2 + 2),
    h AS (SELECT *, {_LINE.format(n="e", x="u")} - ky * 2 AS p, {_LINE.format(n="e", x="v")} - ky * 2 AS q FROM e),
    g AS (SELECT *, CASE WHEN p = q THEN (v - u) * least(2.0, greatest(0.0, p)) ELSE (v - u) / (q - p) * ((CASE WHEN q <= 0 THEN 0 WHEN q >= 2 THEN 2 * q - 2 ELSE q * q / 2 END) - (CASE WHEN p <= 0 THEN 0 WHEN p >= 2 THEN 2 * p - 2 ELSE p * p / 2 END)) END AS under FROM h)"""


@query("g07_polygon_cells", f"{_CELLS} SELECT id, kx, ky, round(sum(w * under), 5) AS area FROM g GROUP BY 1, 2, 3 HAVING sum(w * under) > 1e-8")
def g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells with a positive overlap of each notched, holed polygon, with the area they share."""
    return rounded(P.cell_areas(part_pieces(spark, sf_dir), ["id"], 2.0), "area", digits=5)


@query("g05_tile_cover", f"{_CELLS}, t AS (SELECT id, kx, ky, sum(w * under) AS area FROM g GROUP BY 1, 2, 3 HAVING sum(w * under) > 1e-8) SELECT id, count(*) AS tiles, round(sum(area), 5) AS covered, round(sum(area) / {_SHAPE_AREA}, 6) AS share FROM t GROUP BY 1")
def g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that cover each polygon, and whether they cover all of it."""
    cells = P.cell_areas(part_pieces(spark, sf_dir), ["id"], 2.0)
    return cells.groupBy("id").agg(F.count(F.lit(1)).alias("tiles"), F.round(F.sum("area"), 5).alias("covered"), F.round(F.sum("area") / _SHAPE_AREA, 6).alias("share"))


@query("d38_tile_overlap_counts", f"{_CELLS}, t AS (SELECT id, kx, ky, sum(w * under) AS area FROM g GROUP BY 1, 2, 3 HAVING sum(w * under) > 1e-8) SELECT kx, ky, count(*) AS polygons, count(*) FILTER (area > 2) AS large, round(sum(area), 4) AS area FROM t GROUP BY 1, 2")
def d38(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many polygons overlap each tile, and with how much."""
    cells = P.cell_areas(part_pieces(spark, sf_dir), ["id"], 2.0)
    return cells.groupBy("kx", "ky").agg(F.count(F.lit(1)).alias("polygons"), F.count_if(F.col("area") > 2).alias("large"), F.round(F.sum("area"), 4).alias("area"))


_RUN = "greatest(b.x1, z.x1) AS u, least(b.x2, z.x2) AS v"
# all pairs of pieces of polygons whose boxes meet; under both, in two parts where the lines cross
_OVERLAY = f"""WITH {_U}, {_A}, {_PARTS}, {_ZONES},
    kb AS (SELECT id, min(x1) AS lx, max(x2) AS hx, min(least(y1, y2)) AS ly, max(greatest(y1, y2)) AS hy FROM b GROUP BY 1), kz AS (SELECT aid, min(x1) AS lx, max(x2) AS hx, min(least(y1, y2)) AS ly, max(greatest(y1, y2)) AS hy FROM z GROUP BY 1),
    m AS (SELECT id, aid FROM kb JOIN kz ON kb.lx < kz.hx AND kz.lx < kb.hx AND kb.ly < kz.hy AND kz.ly < kb.hy),
    e AS (SELECT m.id, m.aid, b.w * z.w AS w, {_RUN}, {_LINE.format(n="b", x="greatest(b.x1, z.x1)")} AS bu, {_LINE.format(n="b", x="least(b.x2, z.x2)")} AS bv, {_LINE.format(n="z", x="greatest(b.x1, z.x1)")} AS zu, {_LINE.format(n="z", x="least(b.x2, z.x2)")} AS zv FROM m JOIN b ON b.id = m.id JOIN z ON z.aid = m.aid AND b.x1 < z.x2 AND z.x1 < b.x2),
    t AS (SELECT *, CASE WHEN (bu - zu) * (bv - zv) < 0 THEN (bu - zu) / ((bu - zu) - (bv - zv)) ELSE 1.0 END AS c FROM e),
    o AS (SELECT id, aid, sum(w * (v - u) * (c * (least(bu, zu) + least(bu + (bv - bu) * c, zu + (zv - zu) * c)) + (1 - c) * (least(bu + (bv - bu) * c, zu + (zv - zu) * c) + least(bv, zv))) / 2) AS area FROM t GROUP BY 1, 2 HAVING sum(w * (v - u) * (c * (least(bu, zu) + least(bu + (bv - bu) * c, zu + (zv - zu) * c)) + (1 - c) * (least(bu + (bv - bu) * c, zu + (zv - zu) * c) + least(bv, zv))) / 2) > 1e-7)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.overlay_areas(part_pieces(spark, sf_dir), zone_pieces(spark, sf_dir), "id", "aid", 5.0, few=True).where("area > 1e-7")


@query("g26_positive_overlap", f"{_OVERLAY} SELECT aid, id, round(area, 5) AS area FROM o")
def g26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons that share any area with a zone."""
    return rounded(overlaps(spark, sf_dir), "area", digits=5)


@query("g02_units_by_overlap_share", f"{_OVERLAY}, s AS (SELECT u.id, coalesce(sum(area), 0) AS area FROM u LEFT JOIN o ON o.id = u.id GROUP BY 1) SELECT id, round(area / {_SHAPE_AREA}, 5) AS share FROM s WHERE area / {_SHAPE_AREA} >= 0.5")
def g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of which the zones hold half or more."""
    parts = boxes(spark, sf_dir).select("id").repartition("id").withColumns({"own": F.lit(_SHAPE_AREA), "special": F.lit(False)})
    return rounded(G.select_by_share(parts, overlaps(spark, sf_dir), "id", "own", 0.5, "special").where("selected").select("id", "share"), "share", digits=5)


@query("g03_units_with_reasons", f"{_OVERLAY}, s AS (SELECT u.id, coalesce(sum(area), 0) / {_SHAPE_AREA} AS share FROM u LEFT JOIN o ON o.id = u.id GROUP BY 1), r AS (SELECT *, CASE WHEN share = 0 THEN 'outside' WHEN id % 11 = 0 THEN 'special_use' WHEN share < 0.5 THEN 'small_share' ELSE 'selected' END AS reason FROM s) SELECT id, round(share, 5) AS share, reason = 'selected' AS selected, reason FROM r")
def g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with the reason why it is in or out."""
    parts = boxes(spark, sf_dir).select("id").repartition("id").withColumns({"own": F.lit(_SHAPE_AREA), "special": F.col("id") % 11 == 0})
    return rounded(G.select_by_share(parts, overlaps(spark, sf_dir), "id", "own", 0.5, "special"), "share", digits=5)


# boxes of suppliers, which overlap each other, in nations' boxes: distinct x cut strips, a running top merges what each strip holds
_FOOT = "f AS (SELECT s_suppkey AS sid, CAST(s_suppkey % 40 AS DOUBLE) AS x0, s_acctbal / 100 + 90 AS y0, s_suppkey % 40 + 2.5 + s_nationkey / 10.0 AS x1, s_acctbal / 100 + 94 AS y1 FROM supplier)"


def _union_sql(source: str, by: str) -> str:
    """Area of the union of boxes (by, x0, y0, x1, y1)."""
    return f"""xs AS (SELECT {by}, x0 AS x FROM {source} UNION SELECT {by}, x1 FROM {source}), st AS (SELECT *, lead(x) OVER (PARTITION BY {by} ORDER BY x) AS t FROM xs),
    sl AS (SELECT st.*, y0, y1, coalesce(max(y1) OVER (PARTITION BY {", ".join("st." + c.strip() for c in by.split(","))}, x ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS reach FROM st JOIN {source} q USING ({by}) WHERE x0 <= x AND x1 >= t),
    un AS (SELECT {by}, sum((t - x) * greatest(0.0, y1 - greatest(y0, reach))) AS area FROM sl GROUP BY ALL)"""


def supplier_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 40
    return s.select(F.col("s_suppkey").alias("sid"), k.cast("double").alias("x0"), (F.col("s_acctbal") / 100 + 90).alias("y0"), (k + 2.5 + F.col("s_nationkey") / 10.0).alias("x1"), (F.col("s_acctbal") / 100 + 94).alias("y1"))


@query("g08_exact_union", f"WITH {_A}, {_FOOT}, c AS (SELECT aid, greatest(x0, a0) AS x0, greatest(y0, b0) AS y0, least(x1, a1) AS x1, least(y1, b1) AS y1 FROM a JOIN f ON x0 < a1 AND a0 < x1 AND y0 < b1 AND b0 < y1), {_union_sql('c', 'aid')} SELECT a.aid, round(coalesce(un.area, 0) / 120, 6) AS share FROM a LEFT JOIN un USING (aid)")
def g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each area that overlapping footprints cover together, exactly."""
    a = P.pieces(P.box_edges(areas(spark, sf_dir), ["aid"], _ABOX), ["aid"])
    f = P.pieces(P.box_edges(supplier_boxes(spark, sf_dir), ["sid"], ("x0", "y0", "x1", "y1")), ["sid"])
    return rounded(P.covered_shares(a, f, "aid", 2.0), "share")


# items: lines with a footprint in the acquisition's area of 10 x 10; two baselines an acquisition
_ITEMS = "i AS (SELECT l_suppkey AS acq, l_linenumber % 2 AS baseline, l_returnflag || l_linestatus AS tile, l_shipdate AS generation, l_orderkey * 10 + l_linenumber AS item, l_quantity / 8 AS x0, l_discount * 60 AS y0, l_quantity / 8 + 2 + l_linenumber AS x1, l_discount * 60 + 3 + l_tax * 20 AS y1 FROM lineitem)"
_BOX = ("x0", "y0", "x1", "y1")


@query(
    "e12_union_cohorts",
    f"""WITH {_ITEMS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY acq, baseline, tile ORDER BY generation DESC, item) AS k FROM i) WHERE k = 1),
    c AS (SELECT acq, baseline, greatest(x0, 0.0) AS x0, greatest(y0, 0.0) AS y0, least(x1, 10.0) AS x1, least(y1, 10.0) AS y1 FROM l WHERE x0 < 10 AND y0 < 10), {_union_sql('c', 'acq, baseline')},
    s AS (SELECT l.acq, l.baseline, round(coalesce(any_value(un.area), 0) / 100, 9) AS coverage, max(generation) AS generation, list_sort(list(item)) AS items FROM l LEFT JOIN un USING (acq, baseline) GROUP BY 1, 2)
    SELECT acq, CAST(baseline AS BIGINT) AS baseline, round(coverage, 6) AS coverage, array_to_string(items, '|') AS items FROM (SELECT *, row_number() OVER (PARTITION BY acq ORDER BY coverage DESC, baseline DESC, generation DESC, items) AS k FROM s) WHERE k = 1""",
)
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each acquisition the baseline whose items cover most of the area together, overlaps counted once."""
    li = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity") / 8, F.col("l_discount") * 60
    items = li.select(F.col("l_suppkey").alias("acq"), (F.col("l_linenumber") % 2).cast("long").alias("baseline"), F.concat("l_returnflag", "l_linestatus").alias("tile"), F.col("l_shipdate").alias("generation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), x.alias("x0"), y.alias("y0"), (x + 2 + F.col("l_linenumber")).alias("x1"), (y + 3 + F.col("l_tax") * 20).alias("y1"))
    area = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0)], "x0 double, y0 double, x1 double, y1 double")
    foot = lambda kept: P.pieces(P.box_edges(kept, ["acq", "baseline", "item"], _BOX), ["acq", "baseline", "item"])
    best = W.union_cohort(items, ["acq"], ["baseline"], "tile", "generation", "item", foot, P.pieces(P.box_edges(area, [], _BOX), []), 5.0)
    return best.select("acq", "baseline", F.round("coverage", 6).alias("coverage"), F.array_join(F.col("items").cast("array<string>"), "|").alias("items"))


_QUAD = [(0.0, 0.0), (0.75, 0.25), (0.5, 1.0), (-0.25, 0.5)]
QUAD = [(0, False, *a, *b) for a, b in zip(_QUAD, _QUAD[1:] + _QUAD[:1])]
_SIDE = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def _gap(p: str, a: str, b: str) -> str:
    t = f"greatest(0.0, least(1.0, (({p}x - {a}x) * ({b}x - {a}x) + ({p}y - {a}y) * ({b}y - {a}y)) / (power({b}x - {a}x, 2) + power({b}y - {a}y, 2))))"
    return f"sqrt(power({p}x - ({a}x + {t} * ({b}x - {a}x)), 2) + power({p}y - ({a}y + {t} * ({b}y - {a}y)), 2))"


_EDGE = f"q AS (SELECT s_suppkey AS id, s_nationkey AS brand, s_suppkey % 60 + dx1 AS ax, s_acctbal / 100 + dy1 AS ay, s_suppkey % 60 + dx2 AS ex, s_acctbal / 100 + dy2 AS ey FROM supplier, (VALUES {_values(QUAD)}) s(ring, hole, dx1, dy1, dx2, dy2))"


@query(
    "g09_edge_buffers",
    f"""WITH {_EDGE}, o AS (SELECT id AS id2, brand AS brand2, ax AS cx, ay AS cy, ex AS dx, ey AS dy FROM q),
    d AS (SELECT brand AS held_block, id2 AS id, min(CASE WHEN {_SIDE('a', 'e', 'c')} * {_SIDE('a', 'e', 'd')} < 0 AND {_SIDE('c', 'd', 'a')} * {_SIDE('c', 'd', 'e')} < 0 THEN 0.0 ELSE least({_gap('a', 'c', 'd')}, {_gap('e', 'c', 'd')}, {_gap('c', 'a', 'e')}, {_gap('d', 'a', 'e')}) END) AS distance FROM q JOIN o ON brand <> brand2 AND abs(ax - cx) < 4 AND abs(ay - cy) < 4 GROUP BY 1, 2)
    SELECT held_block, id, 'buffer_only' AS role, round(distance, 6) AS distance FROM d WHERE distance <= 0.6 UNION ALL SELECT DISTINCT brand, id, 'held_out', 0.0 FROM q""",
)
def g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slanted units of other blocks within the radius of a block's units, edge to edge."""
    at = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("brand"), (F.col("s_suppkey") % 60).cast("double").alias("x"), (F.col("s_acctbal") / 100).alias("y"))
    return rounded(P.buffer_polygons(placed(at, ["id", "brand"], "x", "y", QUAD), "id", "brand", 0.6), "distance")


@query("g12_expanding_search", f"WITH {_U}, {_S}, {_NEAR}, m AS (SELECT id, min(d) AS distance FROM n GROUP BY 1 HAVING min(d) <= 50) SELECT id, round(distance, 6) AS distance, min(sid) AS sid, count(DISTINCT sid) AS ties, CASE WHEN distance <= 2 THEN 2.0 WHEN distance <= 5 THEN 5.0 WHEN distance <= 15 THEN 15.0 ELSE 50.0 END AS radius FROM m JOIN n USING (id) WHERE n.d - distance <= 0 GROUP BY 1, m.distance")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest line, searched in rings: each round only for the points that are still without one."""
    points = boxes(spark, sf_dir).select("id", F.col("x0").alias("px"), F.col("y0").alias("py"))
    return rounded(P.expanding_nearest(points, lines(spark, sf_dir), "id", "sid", [2.0, 5.0, 15.0, 50.0]), "distance")


# areas and small boxes at suppliers' places: every tenth names the wrong area, every eleventh none
_TREE = """b AS (SELECT 'a' || aid AS poly, a0 AS x0, b0 AS y0, a1 AS x1, b1 AS y1, CAST(NULL AS VARCHAR) AS expected FROM a
    UNION ALL SELECT 's' || s_suppkey, s_suppkey % 48 + 0.25, s_acctbal / 100 + 90, s_suppkey % 48 + 0.75, s_acctbal / 100 + 90.5, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 10 = 0 THEN 'a0' ELSE 'a' || CAST(CAST(floor((s_suppkey % 48) / 10) AS BIGINT) + 5 * CAST(floor(s_acctbal / 2000) AS BIGINT) AS VARCHAR) END FROM supplier)"""


def tree_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = areas(spark, sf_dir).select(F.concat(F.lit("a"), "aid").alias("poly"), F.col("a0").alias("x0"), F.col("b0").alias("y0"), F.col("a1").alias("x1"), F.col("b1").alias("y1"), F.lit(None).cast("string").alias("expected"))
    s, k, y = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 48, F.col("s_acctbal") / 100 + 90
    own = F.concat(F.lit("a"), (F.floor(k / 10) + 5 * F.floor(F.col("s_acctbal") / 2000)).cast("string"))
    named = F.when(F.col("s_suppkey") % 11 == 0, None).when(F.col("s_suppkey") % 10 == 0, "a0").otherwise(own)
    inner = s.select(F.concat(F.lit("s"), "s_suppkey").alias("poly"), (k + 0.25).alias("x0"), y.alias("y0"), (k + 0.75).alias("x1"), (y + 0.5).alias("y1"), named.alias("expected"))
    return outer.unionByName(inner)


@query(
    "g18_parent_audit",
    f"""WITH {_A}, {_TREE}, h AS (SELECT c.poly, p.poly AS parent, row_number() OVER (PARTITION BY c.poly ORDER BY (p.x1 - p.x0) * (p.y1 - p.y0), p.poly) AS k, count(*) OVER (PARTITION BY c.poly) AS containers FROM b c JOIN b p ON (c.x0 + c.x1) / 2 > p.x0 AND (c.x0 + c.x1) / 2 < p.x1 AND (c.y0 + c.y1) / 2 > p.y0 AND (c.y0 + c.y1) / 2 < p.y1 AND (p.x1 - p.x0) * (p.y1 - p.y0) > (c.x1 - c.x0) * (c.y1 - c.y0) + 1e-9)
    SELECT b.poly, expected, parent, coalesce(containers, 0) AS containers, CASE WHEN expected IS NOT DISTINCT FROM parent THEN 'ok' WHEN parent IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unnamed' ELSE 'differs' END AS status FROM b LEFT JOIN h ON h.poly = b.poly AND k = 1""",
)
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polygon's parent by its representative point against the parent that it names."""
    b = tree_boxes(spark, sf_dir)
    at = b.select("poly", ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 6).alias("area"), "expected")
    return G.containment_audit(at, P.box_edges(b, ["poly"], ("x0", "y0", "x1", "y1")), "poly", "expected", 5.0)


@query(
    "g24_seed_mapping",
    f"""WITH {_A}, {_TREE}, s AS (SELECT poly AS seed, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py, expected FROM b WHERE poly LIKE 's%'), m AS (SELECT seed, 'a' || aid AS poly FROM s JOIN a ON px > a0 AND px < a1 AND py > b0 AND py < b1),
    h AS (SELECT m.poly, count(DISTINCT s.seed) AS n FROM s LEFT JOIN m USING (seed) GROUP BY 1), e AS (SELECT expected AS poly, count(*) AS n FROM s GROUP BY 1), j AS (SELECT coalesce(h.poly, e.poly) AS poly, coalesce(h.n, 0) AS seeds, coalesce(e.n, 0) AS expected FROM h FULL JOIN e ON h.poly IS NOT DISTINCT FROM e.poly)
    SELECT *, CASE WHEN seeds = expected THEN 'ok' WHEN seeds = 0 THEN 'missing' WHEN expected = 0 THEN 'surplus' ELSE 'differs' END AS status FROM j""",
)
def g24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds in each area against the seeds that name it."""
    seeds = tree_boxes(spark, sf_dir).where("poly like 's%'").select(F.col("poly").alias("seed"), ((F.col("x0") + F.col("x1")) / 2).alias("px"), ((F.col("y0") + F.col("y1")) / 2).alias("py"), "expected")
    zones = P.box_edges(areas(spark, sf_dir).withColumn("poly", F.concat(F.lit("a"), "aid")), ["poly"], _ABOX)
    return G.seed_mapping(seeds, zones, "seed", "poly", "expected", 5.0)


@query(
    "g22_zone_raster",
    f"""WITH {_U}, k AS (SELECT id, x0, y0, unnest(range(CAST(floor(x0) AS BIGINT) - 1, CAST(floor(x0) AS BIGINT) + 5)) AS kx FROM u), c AS (SELECT *, unnest(range(CAST(floor(y0) AS BIGINT) - 2, CAST(floor(y0) AS BIGINT) + 6)) AS ky FROM k),
    e AS (SELECT id, kx, ky, count(*) AS n FROM c, (VALUES {_values(SHAPE)}) s(ring, hole, dx1, dy1, dx2, dy2) WHERE (y0 + dy1 > ky + 0.5) <> (y0 + dy2 > ky + 0.5) AND kx + 0.5 < dx1 + (dx2 - dx1) * (ky + 0.5 - y0 - dy1) / (CASE WHEN dy2 <> dy1 THEN dy2 - dy1 END) + x0 GROUP BY 1, 2, 3)
    SELECT kx, ky, min(id) AS zone, count(*) AS zones FROM e WHERE n % 2 = 1 GROUP BY 1, 2""",
)
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid cells whose centres lie in a polygon: the zone of the least id, and how many claim the cell."""
    edges = placed(boxes(spark, sf_dir), ["id"], "x0", "y0", SHAPE)
    return P.zone_raster(edges, "id", 1.0)


@query("g16_seam_audit", "WITH v AS (SELECT l_suppkey AS poly, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq, l_quantity AS x FROM lineitem), e AS (SELECT poly, seq, x AS x1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2 FROM v WINDOW w AS (PARTITION BY poly ORDER BY seq)) SELECT poly, count(*) AS edges, count(*) FILTER (abs(x2 - x1) > 30) AS seams, count(*) FILTER (x2 - x1 > 30) AS eastward, count(*) FILTER (x1 - x2 > 30) AS westward, count(*) FILTER (x2 - x1 > 30) = count(*) FILTER (x1 - x2 > 30) AS closes FROM e GROUP BY 1")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the edges that jump over the seam; a ring that leaves over it has to come back."""
    from tessera.plans.queries_geometry import polygon_edges

    return G.seam_audit(polygon_edges(spark, sf_dir), "poly", 30.0)


@query("g14_parity_gate", f"WITH {_S}, d AS (SELECT sid, sqrt(power((x1 - 20.0) * cos(radians(40.0)) * 111195.08, 2) + power((y1 / 4 - 40.0) * 111195.08, 2)) AS planar, 2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(y1 / 4 - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(y1 / 4)) * power(sin(radians(x1 - 20.0) / 2), 2)))) AS geodesic FROM s) SELECT sid, round(planar, 2) AS planar, round(geodesic, 2) AS geodesic, abs(planar - geodesic) <= 25000 + 0.01 * geodesic AS passed FROM d")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected distances against geodesic ones: each has to agree within a fixed and a relative tolerance."""
    x, y, metre = F.col("x1"), F.col("y1") / 4, 111195.08
    d = lines(spark, sf_dir).select("sid", F.hypot((x - 20.0) * F.cos(F.radians(F.lit(40.0))) * metre, (y - 40.0) * metre).alias("planar"), G.haversine(F.lit(20.0), F.lit(40.0), x, y).alias("geodesic"))
    return rounded(G.parity_gate(d, "planar", "geodesic", 25000.0, 0.01), "planar", "geodesic", digits=2)
