"""Polygons by edges: hand-computed areas, and random shapes against counting fine points."""

from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import polygons as P
from tessera.operators import windows as W

EDGE = "poly int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double"


def edges(spark, shapes):
    """shapes: (poly, ring, hole, corners)."""
    return spark.createDataFrame([(p, r, h, *map(float, a), *map(float, b)) for p, r, h, c in shapes for a, b in zip(c, c[1:] + c[:1])], EDGE)


NOTCHED = [(0, 0), (0, 4), (2, 2), (4, 4), (4, 0)]  # clockwise, 12 square units
HOLE = [(1, 0.5), (3, 0.5), (3, 1.5), (1, 1.5)]  # 2 square units


def test_cells_of_a_notched_polygon_with_a_hole(spark):
    p = P.pieces(edges(spark, [(1, 0, False, NOTCHED), (1, 1, True, HOLE), (2, 0, False, [(x + 10, y) for x, y in NOTCHED[::-1]])]), ["poly"])
    got = {(r["poly"], r["kx"], r["ky"]): r["area"] for r in P.cell_areas(p, ["poly"], 2.0).collect()}
    assert got == {k: pytest.approx(v) for k, v in {(1, 0, 0): 3.0, (1, 1, 0): 3.0, (1, 0, 1): 2.0, (1, 1, 1): 2.0, (2, 5, 0): 4.0, (2, 6, 0): 4.0, (2, 5, 1): 2.0, (2, 6, 1): 2.0}.items()}
    # a tall box: the cells between its lowest and highest edges have none
    tall = P.pieces(edges(spark, [(3, 0, False, [(0.25, -7.5), (0.75, -7.5), (0.75, 9.5), (0.25, 9.5)])]), ["poly"])
    cells = {r["ky"]: r["area"] for r in P.cell_areas(tall, ["poly"], 1.0).collect()}
    assert cells == {k: pytest.approx(0.25 if k in (-8, 9) else 0.5) for k in range(-8, 10)}


def test_overlay_of_concave_polygons(spark):
    a = P.pieces(edges(spark, [(1, 0, False, NOTCHED), (1, 1, True, HOLE)]), ["poly"])
    shapes = [(1, 0, False, [(1, 1), (3, 1), (3, 5), (1, 5)]), (2, 0, False, [(4, 0), (6, 0), (6, 4), (4, 4)]), (3, 0, False, [(1.2, 0.6), (2.8, 0.6), (2, 1.4)]), (4, 0, False, [(-9, -9), (9, -9), (9, 9), (-9, 9)])]
    b = P.pieces(edges(spark, shapes), ["poly"]).withColumnRenamed("poly", "other")
    got = {r["other"]: r["area"] for r in P.overlay_areas(a, b, "poly", "other", 1.5).collect()}
    # 1: the strip from 1 to 3 above y = 1 is 2 x 1 and a notch of two triangles, less the hole's upper half; 2 touches; 3 lies in the hole; 4 holds all
    assert got == {1: pytest.approx(2 + 1 - 1), 4: pytest.approx(10.0)}


def inside(x, y, rings):
    return sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for r in rings for (a, b), (c, d) in zip(r, r[1:] + r[:1])) % 2 == 1


def test_random_overlays_and_unions_against_points(spark):
    rng = random.Random(8)

    def star(cx, cy):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        return [(cx + math.cos(t) * (d := rng.uniform(0.4, 2)), cy + math.sin(t) * d) for t in turns]

    left = [(i, 0, False, star(rng.uniform(0, 4), rng.uniform(0, 4))) for i in range(4)]
    right = [(i, 0, False, star(rng.uniform(0, 4), rng.uniform(0, 4))) for i in range(4)]
    a, b = P.pieces(edges(spark, left), ["poly"]), P.pieces(edges(spark, right), ["poly"])
    step = 0.02
    points = [((i + 0.5) * step - 2, (j + 0.5) * step - 2) for i in range(400) for j in range(400)]
    in_a, in_b = ([[inside(x, y, [c]) for _, _, _, c in s] for x, y in points] for s in (left, right))
    got = {(r["poly"], r["other"]): r["area"] for r in P.overlay_areas(a, b.withColumnRenamed("poly", "other"), "poly", "other", 1.0).collect()}
    for i in range(4):
        for j in range(4):
            assert got.get((i, j), 0.0) == pytest.approx(step**2 * sum(p[i] and q[j] for p, q in zip(in_a, in_b)), abs=0.03)
    whole = P.union_areas(a.withColumn("g", F.lit(1)), ["g"], 0.7).first()["area"]
    assert whole == pytest.approx(step**2 * sum(map(any, in_a)), abs=0.05)
    share = {r["other"]: r["share"] for r in P.covered_shares(b.withColumnRenamed("poly", "other"), a, "other", 0.7).collect()}
    for j in range(4):
        assert share[j] == pytest.approx(sum(q[j] and any(p) for p, q in zip(in_a, in_b)) / sum(q[j] for q in in_b), abs=0.02)


def test_overlapping_tiles_count_once_in_the_choice_of_a_baseline(spark):
    # baseline 1 has two tiles on the same half, 2 two tiles on different ones that are smaller together
    data = [(7, 1, "a", 1, 10, 0.0, 0.6), (7, 1, "b", 1, 11, 0.0, 0.6), (7, 2, "a", 1, 12, 0.0, 0.5), (7, 2, "b", 1, 13, 0.5, 1.0), (7, 2, "b", 0, 14, 0.0, 0.1)]
    items = spark.createDataFrame([(*r[:5], r[5], 0.0, r[6], 1.0, r[6] - r[5]) for r in data], "acq int, base int, tile string, gen int, item int, x0 double, y0 double, x1 double, y1 double, part double")
    area = P.pieces(P.box_edges(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "x0 double, y0 double, x1 double, y1 double"), [], ("x0", "y0", "x1", "y1")), [])
    foot = lambda kept: P.pieces(P.box_edges(kept, ["acq", "base", "item"], ("x0", "y0", "x1", "y1")), ["acq", "base", "item"])
    best = W.union_cohort(items, ["acq"], ["base"], "tile", "gen", "item", foot, area, 0.3).first()
    assert (best["base"], best["coverage"], best["items"]) == (2, 1.0, [12, 13])
    assert W.cohort(items, ["acq"], ["base"], "tile", "gen", "item", "part").first()["base"] == 1


def test_buffers_reach_from_edge_to_edge(spark):
    far = [(x + 1004.0, y) for x, y in [(0, 0), (4, 1), (2, 5)]]
    shapes = [(1, 0, False, [(0, 0), (4, 0), (4, 4), (0, 4)]), (2, 0, False, far), (3, 0, False, [(x + 0.5, y) for x, y in far]), (4, 0, False, [(1, 1), (2, 1), (2, 2)]), (5, 0, False, [(5, 5.0), (9, 5), (9, 9)])]
    block = F.when(F.col("poly") == 1, "A").otherwise("B")
    got = {(r["held_block"], r["poly"]): (r["role"], r["distance"]) for r in P.buffer_polygons(edges(spark, shapes).withColumn("block", block), "poly", "block", 1000.0).collect()}
    # fixture: 1,000 m apart is near; half a metre more is not; what lies within is at distance 0
    assert got["A", 2] == ("buffer_only", pytest.approx(1000.0)) and ("A", 3) not in got
    assert got["A", 4] == ("buffer_only", 0.0) and got["A", 5][1] == pytest.approx(math.sqrt(2)) and got["A", 1] == ("held_out", 0.0) and got["B", 1] == ("buffer_only", 0.0)


def test_expanding_search_equals_one_search(spark):
    rng = random.Random(2)
    pts = spark.createDataFrame([(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)], "id int, px double, py double")
    seg = spark.createDataFrame([(i, x := rng.uniform(0, 50), y := rng.uniform(0, 50), x + 1, y + rng.uniform(0, 2)) for i in range(12)], "sid int, x1 double, y1 double, x2 double, y2 double")
    want = {r["id"]: (r["distance"], r["sid"]) for r in G.nearest_segment(pts, seg, "id", "sid", 40.0).collect()}
    got = P.expanding_nearest(pts, seg, "id", "sid", [1.0, 4.0, 40.0]).collect()
    assert {r["id"]: (r["distance"], r["sid"]) for r in got} == want
    assert all(r["radius"] == (1.0 if r["distance"] <= 1 else 4.0 if r["distance"] <= 4 else 40.0) for r in got) and len({r["radius"] for r in got}) > 1


def test_ranks_come_from_ranges(spark):
    from tessera.operators.ranking import total_rank

    data = [(i % 7, i % 3, None if i % 11 == 0 else i % 5) for i in range(400)]
    df = spark.createDataFrame(data, "a int, b int, c int")
    out = total_rank(df, ["c", "a"], parts=6)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 401))
    listed = [((r["c"] is not None, r["c"] or 0), r["a"]) for r in sorted(out.collect(), key=lambda r: r["rank"])]
    assert listed == sorted(listed)
    heavy = spark.createDataFrame([(1, 5), (2, 3), (3, 1)], "k int, n long")
    assert [(r["k"], r["rank"]) for r in total_rank(heavy, ["k"], weight="n", parts=2).orderBy("k").collect()] == [(1, 1), (2, 6), (3, 9)]
    assert total_rank(df.limit(0), ["a"]).count() == 0
    assert [r["v"] for r in W.evenly_spaced(spark.range(101).withColumnRenamed("id", "v"), "v", 5).orderBy("v").collect()] == [0, 25, 50, 75, 100]


def joins(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_tile_overlap_counts_send_no_edges_to_the_driver(spark):
    """The turns of all rings were a table that the planner took for small and broadcast."""
    from tessera.plans import registry

    assert joins(registry.queries()["d38_tile_overlap_counts"](spark, "/root/testdata/sf0.001")) == []


def test_tile_cover_sends_no_edges_to_the_driver(spark):
    from tessera.plans import registry

    assert joins(registry.queries()["g05_tile_cover"](spark, "/root/testdata/sf0.001")) == []


def test_polygon_cells_keep_edges_without_a_join_and_leave_out_nameless_ones(spark):
    from tessera.plans import registry

    assert joins(registry.queries()["g07_polygon_cells"](spark, "/root/testdata/sf0.001")) == []
    p = P.pieces(edges(spark, [(1, 0, False, NOTCHED), (None, 0, False, NOTCHED)]), ["poly"])
    assert joins(p) == [] and {r["poly"] for r in p.collect()} == {1}


def sent(df):
    """The parts of a plan that go through the driver to every task."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: re.search(r"[A-Za-z(*]", line).start() if re.search(r"[A-Za-z(*]", line) else 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x, d=depth(line): depth(x) > d, lines[i + 1 :])
            out.append("\n".join(below))
    return out


def test_units_with_reasons_send_only_zones_through_the_driver(spark):
    from tessera.plans import registry

    parts = sent(registry.queries()["g03_units_with_reasons"](spark, "/root/testdata/sf0.001"))
    assert parts and all("nation" in p and "part.parquet" not in p for p in parts)


def test_units_by_share_send_only_zones_through_the_driver(spark):
    from tessera.plans import registry

    parts = sent(registry.queries()["g02_units_by_overlap_share"](spark, "/root/testdata/sf0.001"))
    assert parts and all("nation" in p and "part.parquet" not in p for p in parts)


def test_positive_overlaps_send_only_zones_through_the_driver(spark):
    from tessera.plans import registry

    parts = sent(registry.queries()["g26_positive_overlap"](spark, "/root/testdata/sf0.001"))
    assert parts and all("nation" in p and "part.parquet" not in p for p in parts)


def test_boxes_that_share_several_cells_count_once(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, -2.5, -2.5, 2.5, 2.5)], f"a int, {box}")
    b = spark.createDataFrame([(1, -1.0, -1.0, 9.0, 9.0), (2, 2.5, 0.0, 3.0, 1.0), (3, -9.0, -9.0, -2.0, -2.0)], f"b int, {box}").withColumnsRenamed({c: f"b{c}" for c in ("x0", "y0", "x1", "y1")})
    for few in (False, True):
        got = G.overlapping_boxes(a, b, "a", "b", ("x0", "y0", "x1", "y1"), ("bx0", "by0", "bx1", "by1"), 1.0, few).collect()
        assert sorted((r["b"], r["area"]) for r in got) == [(1, 12.25), (3, 0.25)]


def shuffled(spark, df):
    """Rows that the stages of a query write for others to read."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList()))}
    before = stages()
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def crowd(spark, points=400, segments=300):
    rng = random.Random(5)
    pts = spark.createDataFrame([(i, float(i % 20), float(i // 20 % 4)) for i in range(points)], "id int, px double, py double")
    seg = spark.createDataFrame([(i, x := rng.uniform(0, 20), y := rng.uniform(0, 4), x + 0.2, y + rng.uniform(0, 0.3)) for i in range(segments)], "sid int, x1 double, y1 double, x2 double, y2 double")
    return pts, seg


def test_accepted_radius_shuffles_no_pairs(spark):
    """Every point has every segment within the radius: 120,000 pairs, which were all shuffled."""
    pts, seg = crowd(spark)
    found = G.nearest_segment(pts, seg, "id", "sid", 50.0)
    assert shuffled(spark, G.accepted_radius(found, [], [2.0, 50.0])) < 30_000
    want = {r["id"]: r["distance"] for r in G.nearest_brute(pts, seg, "id").collect()}
    assert {r["id"]: r["distance"] for r in found.collect()} == pytest.approx(want)

def test_ties_reach_beyond_the_radius(spark):
    """As in the SQL of g10_g11_g23_nearest_segment: the radius is for the nearest one, the tolerance for its ties."""
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 100.0), (3, None, 0.0), (4, 0.0, 0.0)], "id int, px double, py double")
    seg = spark.createDataFrame([(7, 11.9995, -1.0, 11.9995, 1.0), (8, -12.0002, -1.0, -12.0002, 1.0), (9, 12.1, 0.0, 12.1, 0.0), (10, None, 0.0, 1.0, 1.0)], "sid int, x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: (r["distance"], r["sid"], r["ties"]) for r in G.nearest_segment(pts, seg, "id", "sid", 12.0, 0.001).collect()}
    assert got == {1: (11.9995, 7, 2), 4: (11.9995, 7, 2)}
    assert G.nearest_segment(pts, seg.limit(0), "id", "sid", 12.0).collect() == []


def test_nearest_of_long_short_and_distant_segments(spark):
    """Cells of many sizes: segments from points to some over all cells, points inside the crowd and far off, at several radii."""
    rng = random.Random(11)
    pts = spark.createDataFrame([(i, rng.uniform(-60, 160), rng.uniform(-60, 160)) for i in range(150)] + [(200 + i, rng.gauss(20, 0.2), rng.gauss(20, 0.2)) for i in range(50)], "id int, px double, py double")
    ends = [(rng.gauss(20, 0.3), rng.gauss(20, 0.3)) for _ in range(150)] + [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(30)]
    seg = [(i, x, y, x + rng.choice([0.0, 1e-9, 0.01, 3.0, 90.0]), y + rng.choice([0.0, -0.02, 2.0, 120.0])) for i, (x, y) in enumerate(ends)]
    segments = spark.createDataFrame(seg, "sid int, x1 double, y1 double, x2 double, y2 double")
    want = {r["id"]: r["distance"] for r in G.nearest_brute(pts, segments, "id").collect()}
    for radius in (0.05, 7.0, 500.0):
        got = {r["id"]: r["distance"] for r in G.nearest_segment(pts, segments, "id", "sid", radius).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items() if v <= radius}


def test_probe_gate_shuffles_no_pairs(spark):
    pts, seg = crowd(spark)
    near = lambda s, name: G.nearest_segment(pts, s, "id", "sid", 12.0).select("id", F.col("distance").alias(name))
    j = near(seg, "inclusive").join(near(seg.where("sid % 2 = 0"), "baseline"), "id")
    assert shuffled(spark, j) < 40_000


def test_expanding_search_keeps_no_rounds_in_memory(spark):
    """Rounds were persisted, and each round's points joined to all earlier ones'."""
    pts, seg = crowd(spark)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = P.expanding_nearest(pts, seg, "id", "sid", [0.1, 1.0, 40.0])
    assert all(r["radius"] == (0.1 if r["distance"] <= 0.1 else 1.0 if r["distance"] <= 1 else 40.0) for r in got.collect())
    assert "InMemory" not in got._jdf.queryExecution().executedPlan().toString() and spark.sparkContext._jsc.getPersistentRDDs().size() == held


def joined(df):
    """Rows that the joins of a query give."""
    df.collect()

    def below(p):
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [] if kind == "ReusedExchangeExec" else [p.children().apply(i) for i in range(p.children().size())]
        return (p.metrics().apply("numOutputRows").value() if "JoinExec" in kind else 0) + sum(map(below, inner))

    return below(df._jdf.queryExecution().executedPlan())


def test_buffers_of_crowded_boxes_take_few_pairs(spark):
    """Two crowded blocks and a thin one: distances as from all pairs, most of them 0 by covered cells."""
    rng = random.Random(4)
    at = [(i, "AB"[i % 2], rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(600)] + [(600 + i, "C", rng.uniform(-5, 14), rng.uniform(-5, 14)) for i in range(40)]
    data = [(i, b, x, y, x + 3.0, y + 4.0) for i, b, x, y in at]
    units = spark.createDataFrame(data, "id int, block string, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for _, a, x0, y0, x1, y1 in data:
        for i, b, u0, v0, u1, v1 in data:
            d = math.hypot(max(0.0, u0 - x1, x0 - u1), max(0.0, v0 - y1, y0 - v1))
            if a != b and d <= 1.5:
                want[a, i] = min(d, want.get((a, i), d))
    out = G.buffer_units(units, "id", "block", ("x0", "y0", "x1", "y1"), 1.5)
    assert joined(out) < 100_000  # 180,000 pairs of A and B alone, each in many cells
    assert {(r["held_block"], r["id"]): r["distance"] for r in out.collect() if r["role"] == "buffer_only"} == {k: pytest.approx(v) for k, v in want.items()}


def test_edge_buffers_send_nothing_through_the_driver(spark):
    """Units' cells, pairs and edges are as many as the suppliers; the planner took them for small by the size of the file."""
    from tessera.plans import registry

    assert sent(registry.queries()["g09_edge_buffers"](spark, "/root/testdata/sf0.001")) == []
