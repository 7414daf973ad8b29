"""Compiled tables: weather features, out-of-fold fragments, medians, sparse bootstraps."""

from __future__ import annotations

import datetime as dt
import random
import statistics

from tessera.operators import compiles as C
from tessera.operators import models as M
from tessera.operators import resample as R

DAY = dt.date(2024, 3, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_a_feature_is_null_unless_every_cell_has_every_day(spark):
    cells = [(c, day(n), v, float(10 * c + n)) for c in (1, 2) for n in range(10) for v in ("a", "b") if (c, n, v) != (2, 4, "b")]
    weights = [("u", 1, 0.25), ("u", 2, 0.75), ("w", 1, 1.0)]
    targets = [("u", day(n)) for n in (0, 3, 5, 8, 10)] + [("w", day(10)), ("none", day(5))]
    out = C.weather_features(
        spark.createDataFrame(cells, "cell int, day date, variable string, value double"), spark.createDataFrame(weights, "unit string, cell int, weight double"), spark.createDataFrame(targets, "unit string, day date"),
        "unit", "cell", "day", "variable", "value", ["a", "b"], (1, 3),
    )
    got = {(r["unit"], (r["day"] - DAY).days): r for r in out.collect()}
    assert len(got) == 7 and got["u", 0]["days_3"] == 0 and got["none", 5]["a_mean_1d"] is None
    assert got["u", 3]["a_mean_3d"] == 0.25 * 11 + 0.75 * 21 and got["u", 3]["complete_3"]
    # the day without b in one cell
    assert got["u", 5]["a_mean_1d"] is not None and got["u", 5]["b_mean_1d"] is None and not got["u", 5]["complete_1"]
    assert got["u", 8]["complete_3"] and got["w", 10]["b_mean_1d"] == 19.0
    audit = {r["window"]: r for r in C.feature_audit(out, (1, 3)).collect()}
    assert (audit[1]["targets"], audit[1]["complete"], audit[3]["complete"], audit[3]["least_days"]) == (7, 4, 4, 0)


def test_a_mean_halfway_between_two_values_goes_up_in_any_order(spark, tmp_path):
    from tessera.plans import registry

    # weights 1, 1 and 30 of 32, taxes 0, 0.01 and 0.03: 0.0284375, but just below it as a sum of doubles
    before = [("A", c, dt.datetime(1999, 5, 1), 1.0, 0.0) for c, n in ((1, 1), (2, 1), (3, 30)) for _ in range(n)]
    held = [("A", 1, dt.datetime(2000, 2, 18), 4.0, 0.0), ("A", 2, dt.datetime(2000, 2, 18), 4.0, 0.01), ("A", 3, dt.datetime(2000, 2, 18), 4.0, 0.03)]
    for i, rows in enumerate((before + held, held[::-1] + before)):
        spark.createDataFrame(rows, "l_returnflag string, l_linenumber int, l_shipdate timestamp, l_quantity double, l_tax double").repartition(1 + 4 * i).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        spark.createDataFrame([(dt.datetime(2000, 2, 19),)], "o_orderdate timestamp").write.parquet(f"{tmp_path}/{i}/orders.parquet")
        out = registry.queries()["d51_frozen_weather_features"](spark, f"{tmp_path}/{i}").collect()
        assert [(r["unit"], r["q_mean_1d"], r["t_mean_1d"], r["days_1"]) for r in out] == [("A", 4.0, 0.028438, 1)]


def test_fragments_name_each_fault(spark):
    rows = [("t", f, m, "c1", k, float(k), k + 0.5) for f in (0, 1) for m in ("a", "b") for k in range(4 * f, 4 * f + 4)]
    expected = spark.createDataFrame([("t", f, k, float(k)) for f in (0, 1) for k in range(4 * f, 4 * f + 4)], "family string, fold int, k int, y double")
    schema = "family string, fold int, model string, candidate string, k int, y double, p double"
    assert C.oof_violations(spark.createDataFrame(rows, schema), expected, ["k"], "y").count() == 0
    bad = [r for r in rows if r[1:5] != (0, "a", "c1", 2)]
    bad += [("t", 0, "b", "c1", 5, 5.0, 5.5), ("t", 1, "a", "c1", 6, 6.0, 6.5)]
    bad = [(*r[:5], 99.0, r[6]) if r[1:5] == (1, "b", "c1", 7) else r for r in bad]
    bad = [(*r[:3], "c2", *r[4:]) if r[1:5] == (0, "b", "c1", 3) else r for r in bad]
    got = {(r["fold"], r["model"], r["k"], r["problem"]) for r in C.oof_violations(spark.createDataFrame(bad, schema), expected, ["k"], "y").collect()}
    assert got == {(0, "a", 2, "missing"), (0, "b", 5, "surplus"), (1, "a", 6, "doubled"), (1, "b", 7, "truth"), (0, "b", None, "candidates")}


def test_exact_medians(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 5, 50, 51, 999, 1000):
        values = [rng.choice([rng.random(), float(rng.randrange(4))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        assert M.exact_median(df, "v").first()["median"] == statistics.median(values)
    filled = M.impute_medians(df.where("v is null"), df, ["v"])
    assert filled.where("v is null").count() == 1


def test_sparse_bootstraps_draw_until_enough_are_not_empty(spark):
    cells = spark.createDataFrame([(d, d, 1, 2.0, 1.0) for d in range(2)], "day int, block int, n int, baseline_sum double, target_sum double")
    few = R.bootstrap_replicates(cells, "day", "block", 3, 40).count()
    assert few < 40
    out = R.crossed_bootstrap(cells, "day", "block", 3, 40, keep=40).first()
    assert out["used"] == 40


def test_summaries_count_undefined_dates(spark):
    per = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, None), ("b", 2.0, None)], "g string, mae double, rho double")
    got = {r["g"]: r.asDict() for r in C.summarise_dates(per, ["g"], ["mae"]).collect()}
    assert got["a"] == {"g": "a", "dates": 2, "mae_mean": 2.0, "mae_median": 2.0, "rho_median": 0.5, "rho_defined": 1, "rho_undefined": 1} and got["b"]["rho_median"] is None
    rows = spark.createDataFrame([(1, "x", 1.0, 2.0), (1, "y", 1.0, 1.0), (2, "x", 1.0, 4.0)], "day int, s string, y double, p double")
    dates, summary = C.sensor_tables(rows, "s", "day", "y", "p")
    assert dates.count() == 3 and {r["s"]: (r["dates"], r["mae"], r["dates_alone"]) for r in summary.collect()} == {"x": (2, 2.0, 1), "y": (1, 0.0, 0)}


def test_out_of_fold_rows_meet_without_a_join(spark):
    """Expected rows were shuffled to their folds and then, with the fragments, to their keys; now lines are dealt out once, before each stands there four times."""
    from tessera.plans import registry

    plan = registry.queries()["d52_oof_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(family" in plan
    assert not any("hashpartitioning(family" in line and "l_orderkey" in line for line in plan.splitlines())
