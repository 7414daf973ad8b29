"""Hand-computed cases on literal tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import geometry as G
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import quality as Q
from tessera.operators import resample as R
from tessera.operators import splits as P
from tessera.operators import windows as W
from tessera.operators import zonal as Z

D = dt.date


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_dates_weigh_alike(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1.0, 1.0), (D(2024, 1, 1), 2.0, 2.0), *[(D(2024, 1, 2), float(i), i + 4.0) for i in range(4)]], "day date, y double, p double")
    per_date = M.date_metrics(df, [], "day", "y", "p")
    assert [r["mae"] for r in per_date.orderBy("day").collect()] == [0, 4]
    one = M.macro_metrics(per_date, []).first()
    assert one["mae"] == 2.0 and one["pooled_bias"] == pytest.approx(8 / 3) and one["dates"] == 2 and one["rows"] == 6


def test_constant_truth_has_no_rank_correlation_and_no_r2(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 5.0, float(i)) for i in range(3)], "day date, y double, p double")
    one = M.macro_metrics(M.date_metrics(df, [], "day", "y", "p"), []).first()
    assert one["median_rho"] is None and one["rho_dates"] == 0 and one["r2"] is None


def test_top_share_breaks_ties_by_unit(spark):
    df = spark.createDataFrame([("c", 40.0), ("b", 40.0), ("a", 40.0), ("d", 39.0), ("e", 38.0)], "unit string, v double").withColumn("day", F.lit(1))
    assert rows(W.top_share(df, ["day"], "v", "unit", 0.2).where("hot"), "unit") == [("a",)]


def test_mosaic_prefers_certain_then_distant_then_small_id(spark):
    data = [("z", i, True, u, c, v) for i, (u, c, v) in enumerate([(1.0, 1.0, 10.0), (2.0, 1.0, 20.0), (3.0, 4.0, 30.0)])] + [("a", i, True, u, c, v) for i, (u, c, v) in enumerate([(2.0, 9.0, 11.0), (2.0, 2.0, 21.0), (3.0, 4.0, 31.0)])]
    df = spark.createDataFrame(data, "scene string, px int, valid boolean, uncertainty double, distance double, value double")
    assert rows(W.mosaic(df, ["px"]), "px", "scene", "value") == [(0, "z", 10.0), (1, "a", 21.0), (2, "a", 31.0)]


def test_trailing_windows_stop_before_the_day_and_need_every_day(spark):
    days = [1, 2, 3, 5, 6, 7]
    df = spark.createDataFrame([("u", D(2024, 1, d), float(d)) for d in days], "unit string, day date, v double")
    got = dict(rows(W.trailing(df, "unit", "day", ["v"], [], (1, 3)), "day", "v_mean_3d"))
    assert got[D(2024, 1, 5)] is None and got[D(2024, 1, 3)] is None and got[D(2024, 1, 7)] is None
    full = spark.createDataFrame([("u", D(2024, 1, d), float(d)) for d in range(1, 6)], "unit string, day date, v double")
    assert dict(rows(W.trailing(full, "unit", "day", ["v"], [], (3,)), "day", "v_mean_3d"))[D(2024, 1, 4)] == 2.0
    # a target without a row of its own
    targets = spark.createDataFrame([("u", D(2024, 1, 6))], "unit string, day date")
    assert rows(W.trailing_at(full, targets, "unit", "day", "v", 3), "mean", "complete", "days_present") == [(4.0, True, 3)]


def test_dense_calendar_keeps_missing_days(spark):
    df = spark.createDataFrame([("u", D(2024, 2, 28), 1.0), ("u", D(2024, 3, 1), 2.0)], "unit string, day date, v double")
    assert rows(W.dense_calendar(df, "unit", "day"), "day", "observed") == [(D(2024, 2, 28), True), (D(2024, 2, 29), False), (D(2024, 3, 1), True)]


def test_average_precision_collapses_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, s double").withColumn("k", F.lit(1))
    assert W.average_precision(df, ["k"], "y", "s").first()["ap"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)


def test_spearman_shares_ranks(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0)], "x double, y double").withColumn("k", F.lit(1))
    assert W.spearman(df, ["k"], "x", "y").first()["rho"] == pytest.approx(math.sqrt(3) / 2)


def test_span_sessions_count_from_the_first_row(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    df = spark.createDataFrame([(1, t(0)), (2, t(10)), (3, t(20)), (4, t(35))], "id int, ts timestamp").withColumn("g", F.lit(1))
    assert rows(W.span_sessions(df, ["g"], "ts", "id", 900), "id", "session") == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert rows(W.gap_sessions(df, ["g"], "ts", "id", 900), "id", "session") == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_span_sessions_break_where_scenes_are_not_adjacent(spark):
    t = lambda m, us=0: dt.datetime(2024, 1, 1, 10, m, 0, us)
    scenes = [(1, "A", t(0), "41", "36"), (2, "A", t(1), "41", "37"), (3, "A", t(2), "41", "38"), (4, "A", t(3), "44", "38"), (5, "A", t(4), "x", "38"), (6, "B", t(0), "41", "36"), (7, "B", t(15), "42", "36"), (8, "B", t(15, 1), "41", "36")]
    df = spark.createDataFrame(scenes, "id int, platform string, ts timestamp, path string, row string").withColumn("day", F.when(F.col("id") < 6, "2024-01-01").otherwise("2024-01-02"))
    got = W.span_sessions(df, ["platform", "day"], "ts", "id", 900, "path", "row", "day")
    assert rows(got, "id", "session") == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (6, 1), (7, 1), (8, 2)]
    both = df.where("id in (1, 2, 6)").withColumn("day", F.when(F.col("id") == 2, "2024-01-03").otherwise("2024-01-01"))
    # two platforms on one date make it ambiguous, though each has one group
    assert rows(W.span_sessions(both, ["platform", "day"], "ts", "id", 900, "path", "row", "day"), "id", "ambiguous") == [(1, True), (2, False), (6, True)]


def test_dense_calendar_marks_the_last_day_of_leap_years(spark):
    df = spark.createDataFrame([(1, D(2023, 12, 30), 1.0), (1, D(2024, 12, 30), 2.0)], "unit int, day date, v double")
    dense = W.dense_calendar(df, "unit", "day", whole_years=True)
    assert dense.count() == 365 + 366 and rows(dense.where("leap_gap"), "day") == [(D(2024, 12, 31),)]


def test_merge_intervals_joins_adjacent_days(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 3)), (1, D(2024, 1, 4), D(2024, 1, 5)), (1, D(2024, 1, 7), D(2024, 1, 8))], "g int, a date, b date")
    assert rows(W.merge_intervals(df, ["g"], "a", "b"), "a", "b", "parts") == [(D(2024, 1, 1), D(2024, 1, 5), 2), (D(2024, 1, 7), D(2024, 1, 8), 1)]


def test_select_candidate_prefers_simple_ones_within_tolerance(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 1.0005), ("c", 0, 1.5)], "c string, k int, s double").withColumn("f", F.lit(1))
    assert W.select_candidate(df, ["f"], "c", "k", "s", 0.001, 0.0).first()["c"] == "b"


def test_quartiles_are_not_ntile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "u int, v double").withColumn("g", F.lit(1))
    assert [r["q"] for r in df.withColumn("q", W.quartile("v", "u", ["g"])).orderBy("u").collect()] == [0, 0, 1, 2, 2, 3]


def test_zonal_target_gates_and_keeps_all_units(spark):
    px = spark.createDataFrame([(1, v, ok) for v, ok in [(30.0, True), (32.0, True), (34.0, True), (36.0, True)]] + [(2, v, ok) for v, ok in [(42.0, True), (44.0, True), (46.0, True), (99.0, False)]], "unit int, v double, ok boolean").withColumn("g", F.lit(1))
    out = Z.zonal_target(px, spark.createDataFrame([(1,), (2,), (3,)], "unit int"), ["g"], "unit", "v", "ok", F.lit(True), 0.5, 2)
    assert rows(out.fillna({"median": -1.0, "reason": "-"}), "unit", "median", "reason") == [(1, 33.0, "-"), (2, 44.0, "-"), (3, -1.0, "no_footprint")]


def test_weighted_mean_is_null_unless_every_cell_is_there(spark):
    w = spark.createDataFrame([("u", "a", 0.25), ("u", "b", 0.75)], "unit string, cell string, weight double")
    daily = spark.createDataFrame([("a", 1, 100.0), ("b", 1, 200.0), ("a", 2, 5.0)], "cell string, day int, v double")
    got = {r["day"]: (r["v"], r["v_present"]) for r in Z.weighted_mean(daily, w, "cell", "unit", "day", ["v"]).collect()}
    assert got == {1: (175.0, 2), 2: (None, 1)}


def test_weighted_median_is_the_lower_one(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0), (None, 9.0)], "v double, w double").withColumn("g", F.lit(1))
    assert Z.weighted_median(df, ["g"], "v", "w").first()["median"] == 2.0


def test_trailing_composite_needs_enough_acquisitions(spark):
    acq = spark.createDataFrame([(u, a, 0.7 if u == "b" and a > 2 else 0.9, float(a)) for u in "ab" for a in range(1, 5)], "unit string, acq int, coverage double, v double")
    member = spark.createDataFrame([(1, a, lag) for a, lag in zip(range(1, 5), (60, 30, 11, 1))], "day int, acq int, lag int")
    keys = spark.createDataFrame([(1, "a"), (1, "b")], "day int, unit string")
    out = Z.trailing_composite(acq, member, keys, "day", "unit", "acq", "coverage", ["v"], 0.8, 3)
    assert {r["unit"]: (r["v"], r["qualifying"]) for r in out.collect()} == {"a": (2.5, 4), "b": (None, 2)}


def test_lag_membership_bounds(spark):
    t = spark.createDataFrame([(D(2024, 3, 1),)], "t date")
    a = spark.createDataFrame([(D(2024, 3, 1) - dt.timedelta(days=k),) for k in (-1, 0, 1, 30, 60, 61)], "a date")
    assert rows(J.lag_membership(t, a, "t", "a", 1, 60), "lag") == [(1,), (30,), (60,)]


def test_assembly_keeps_rows_and_rejects_clashes(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "unit string, y int")
    other = spark.createDataFrame([("a", None)], "unit string, x int")
    assert [(r["unit"], r["x"], r["missing_0"]) for r in J.assemble(base, [(other, ["unit"])]).orderBy("unit").collect()] == [("a", None, False), ("b", None, True)]
    with pytest.raises(ValueError, match="already"):
        J.assemble(base, [(base, ["unit"])])


def test_bootstrap_of_a_constant_gain(spark):
    cells = spark.createDataFrame([(d, b, 4, 8.0, 4.0) for d in range(3) for b in range(3)], "day int, block int, n long, baseline_sum double, target_sum double")
    out = R.crossed_bootstrap(cells, "day", "block", 1, 50)
    one = out.first()
    assert (one["low"], one["high"], one["p_better"], one["relative_low"]) == (1.0, 1.0, 1.0, 0.5) and one["used"] + one["empty"] == 50
    assert out.first() == one  # draws repeat


def test_morans_i_on_a_line(spark):
    line = spark.createDataFrame([(i, 0, float(i)) for i in range(1, 5)], "bx int, by_ int, v double").withColumn("g", F.lit(1))
    one = R.morans_i(line, ["g"], "v", permutations=99, seed=1).first()
    assert one["edges"] == 3 and one["moran"] == pytest.approx(1 / 3) and one["expected"] == pytest.approx(-1 / 3) and 0 < one["p"] <= 1


def test_fold_roles_test_each_row_once(spark):
    data = spark.createDataFrame([(u, D(y, 1, 1), y, u) for u in (1, 2, 3) for y in (2020, 2021)], "unit int, day date, yr int, block int")
    near = spark.createDataFrame([("1", 2)], "held_block string, unit int")
    folds = P.fold_table(data, "yr", "block")
    roles = P.fold_roles(data, folds, "yr", "block", near, "unit")
    assert not P.coverage_violations(data, folds, ["unit", "day"], "yr", "block").collect()
    assert roles.where("family <> 'joint' and role = 'purged'").count() == 0 and roles.where("family = 'spatial' and held_block = '1' and unit = 2 and role = 'train'").count() == 2
    assert P.fold_roles(data, folds.where("family = 'spatial'"), "yr", "block").count() == 18
    with pytest.raises(Exception, match="needs a buffer"):
        P.fold_roles(data, folds, "yr", "block").collect()
    joint = {(r["unit"], r["yr"]): r["role"] for r in roles.where("family = 'joint' and held_year = 2020 and held_block = '1'").collect()}
    assert joint == {(1, 2020): "test", (1, 2021): "purged", (2, 2020): "purged", (2, 2021): "purged", (3, 2020): "purged", (3, 2021): "train"}


def test_nearest_indexed_and_brute_agree(spark):
    pts = spark.createDataFrame([(i, float(i * 7 % 13), float(i * 5 % 11)) for i in range(30)], "id int, px double, py double")
    seg = spark.createDataFrame([(i, float(i), float(i * 3 % 10), i + 1.5, float(i * 3 % 10)) for i in range(10)], "sid int, x1 double, y1 double, x2 double, y2 double")
    a = {r["id"]: r["distance"] for r in G.nearest_segment(pts, seg, "id", "sid", 30.0).collect()}
    b = {r["id"]: r["distance"] for r in G.nearest_brute(pts, seg, "id").collect()}
    assert a == pytest.approx(b)


def test_point_in_polygon_and_slope(spark):
    square = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])], "poly int, seq int, x double, y double")
    pts = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 2.0)], "id int, px double, py double")
    assert rows(G.points_in_polygons(pts, G.ring_edges(square, "poly", "seq", "x", "y"), "id", "poly", 1.0), "id") == [(1,)]
    plane = spark.createDataFrame([(r, c, float(c)) for r in range(3) for c in range(3)], "r int, c int, v double")
    got = {(r["r"], r["c"]): r["slope"] for r in G.horn_slope(plane, [], "r", "c", "v", 1.0, 1.0).collect()}
    assert got[(1, 1)] == pytest.approx(45.0) and got[(0, 0)] is None


def test_contract_checks(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 3.0), (None, None, None)], "k int, a double, b double")
    assert rows(Q.duplicate_keys(df, ["k"]), "k") == [(1,)]
    assert [(r["k"], r["missing"]) for r in Q.partly_missing(df, ["k"], ["a", "b"]).collect()] == [(1, 1)]
    assert rows(Q.broken_rules(df.where("k = 1"), ["a"], {"b": F.col("b") > 0}), "a", "rule") == [(1.0, "b")]
    with pytest.raises(Q.ContractError):
        Q.require_empty(Q.duplicate_keys(df, ["k"]), "keys")


def test_fingerprint_ignores_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    same, twice = a.orderBy(F.desc("a")).repartition(3), a.union(a)
    assert Q.fingerprint(a, ["a", "b"]).first() == Q.fingerprint(same, ["a", "b"]).first() != Q.fingerprint(twice, ["a", "b"]).first()
    assert Q.fingerprint(a.limit(0), ["a", "b"]).first()["n"] == 0


def test_scalars(spark):
    one = spark.createDataFrame([("HTTPS://Host.Example/A?x=1#y", "12-E", "11SLT", "04.00", 7)], "url string, id string, tile string, v string, q int")
    r = one.select(S.canonical_url(F.col("url")).alias("u"), S.component_root(F.col("id")).alias("c"), S.utm_epsg(F.col("tile")).alias("e"), S.version_key(F.col("v")).alias("k"), S.bits_clear(F.col("q"), (3,)).alias("b"), S.degree_tile(F.lit(33), F.lit(-119)).alias("t"), S.ratio(F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert (r["u"], r["c"], r["e"], tuple(r["k"]), r["b"], r["t"], r["z"]) == ("https://host.example/A", "12", 32611, (4, 0), True, "N33W119", None)
    year = spark.createDataFrame([(D(2024, 12, 31),), (D(2023, 12, 31),)], "d date")
    s, c, n = S.season_phase(F.col("d"))
    for got in year.select(s.alias("s"), c.alias("c"), n.alias("n")).collect():
        assert got["s"] ** 2 + got["c"] ** 2 == pytest.approx(1) and got["n"] in (365, 366)


def test_ridge_from_sums_agrees_with_a_direct_solution(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i % 4, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "cell int, a double, b double, y double")
    cells = L.gram_cells(df, ["cell"], ["a", "b"], "y").where("cell <> 0").withColumn("fold", F.lit(0))
    got = {r["alpha"]: [r["b_0"], r["b_1"], r["b_2"]] for r in L.ridge_by_fold(cells, ["fold"], ["a", "b"], [0.0, 5.0]).collect()}
    keep = np.arange(200) % 4 != 0
    direct = np.linalg.lstsq(np.c_[np.ones(keep.sum()), x[keep]], y[keep], rcond=None)[0]
    assert got[0.0] == pytest.approx(direct.tolist(), abs=1e-6) and abs(got[5.0][1]) < abs(got[0.0][1])


def test_shares_print_as_their_binary_values_round(spark):
    """0.1513125 is a little less than that, 0.0078125 is itself and halfway: C prints 0.151312 and 0.007812."""
    import random

    from tessera.operators import evidence as E

    rng = random.Random(3)
    values = [0.1513125, 0.1305625, 0.0078125, 0.0234375, 0.0, 1.0, 0.9999995, 0.99999951, 1e-7, 5e-7, 1e-12, 12.3456785, -0.1513125, -0.5] + [rng.randrange(1, 2000) / rng.randrange(1, 2000) for _ in range(500)] + [(2 * rng.randrange(500_000) + 1) / 2e6 for _ in range(500)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", E.six_digits(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [f"{v:.6f}" for v in values]
    areas = spark.createDataFrame([(1, 1, 2421.0), (1, 2, 13579.0)], "unit int, label int, area double")
    assert E.sorted_shares(areas, "unit", "label", "area").first()["shares"] == "2:0.848688|1:0.151312"
