"""Contracts: a kept one is silent, a missing column is told, and every rule of the planted tables fires."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import contracts as C
from tessera.operators import quality as Q
from tessera.plans import registry

SF = "/root/testdata/sf0.01"
FIRES = {
    "h12_readiness_faults": {"missing_key", "surplus_key", "duplicate_key", "incomplete:static", "partly_missing:weather", "not_finite:c2", "no_value"},
    "h14_acquisition_faults": {"missing_cell", "surplus_cell", "duplicate_key", "items", "identity:platform", "denominator"},
    "h15_lineage_faults": {"missing_membership", "surplus_membership", "unit_set", "duplicate_key", "feature", "count"},
    "h17_target_faults": {"counts", "share", "flag", "reason", "target", "duplicate_key", "summary"},
    "h19_oof_faults": {"null:block", "locked", "truth_not_finite", "duplicate_key", "missing_pair", "surplus_pair", "pair_rows", "several_blocks", "count:rows", "count:blocks"},
    "h22_label_faults": {"label_without_gate", "label_missing", "not_top"},
    "h23_prediction_faults": {"unit_text", "block_text", "day", "truth_not_finite", "pred_not_finite", "locked", "duplicate_key", "several_blocks"},
    "h30_row_group_faults": {"day", "unit_text", "block_text", "duplicate_key", "surplus_year", "missing_year"},
    "h31_training_key_faults": {"unit_text", "day", "locked", "duplicate_key"},
    "d43_checkpoint_faults": {"duplicate_key", "denominator", "roll_up", "contributions"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(FIRES))
def test_every_rule_fires(spark, name):
    assert {r["rule"] for r in registry.queries()[name](spark, SF).select("rule").distinct().collect()} == FIRES[name]


def predictions(spark, **change):
    row = {"unit": "u1", "block": "b1", "day": dt.datetime(2020, 5, 1), "y": 1.0, "p": 2.0} | change
    return spark.createDataFrame([tuple(row.values()), ("u2", "b1", dt.datetime(2020, 5, 1), 1.0, 2.0)], "unit string, block string, day timestamp, y double, p double")


def test_predictions_are_canonical_or_rejected(spark):
    args = ("unit", "block", "day", "y", "p", 2025)
    good = predictions(spark)
    assert C.prediction_faults(good, *args).count() == 0
    out = C.canonical_predictions(good.withColumn("more", F.lit(1)), *args)
    assert out.columns == ["unit", "block", "day", "y", "p"] and out.count() == 2 and dict(out.dtypes)["day"] == "date"
    for change, rule in (({"unit": "u1 "}, "unit_text"), ({"block": ""}, "block_text"), ({"day": dt.datetime(2020, 5, 1, 3)}, "day"), ({"y": float("nan")}, "truth_not_finite"), ({"p": None}, "pred_not_finite"), ({"day": dt.datetime(2025, 1, 1)}, "locked"), ({"unit": "u2"}, "duplicate_key"), ({"unit": "u2", "day": dt.datetime(2020, 5, 2), "block": "b2"}, "several_blocks")):
        bad = predictions(spark, **change)
        assert {r["rule"] for r in C.prediction_faults(bad, *args).collect()} == {rule}
        with pytest.raises(Q.ContractError, match=rule):
            C.canonical_predictions(bad, *args)
    assert [tuple(r) for r in C.prediction_faults(good.drop("p"), *args).collect()] == [("missing_column", "p", 1)]
    assert {r["rule"] for r in C.prediction_faults(good.limit(0), *args).collect()} == {"empty"}
    assert {r["rule"] for r in C.prediction_faults(good.withColumn("y", F.lit(True)), *args).collect()} == {"truth_not_finite"}


def test_columns_and_kinds_come_first(spark):
    df = spark.createDataFrame([(1, 2, 1.0, "x")], "unit int, day int, a double, b string")
    told = lambda **f: {(r["rule"], r["at"]) for r in C.readiness_faults(df, df, ["unit", "day"], f, []).collect()}
    assert told(one=["a"]) == {("surplus_column", "b")} and told(one=["a", "c"], two=["b"]) == {("missing_column", "c")} and told(one=["a", "b"]) == {("not_numeric", "b")}
    assert C.readiness_faults(df.drop("b"), df, ["unit", "day"], {"one": ["a"]}, ["one"]).count() == 0
