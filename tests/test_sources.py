"""Scans, decoders and sinks on small files."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tessera.sources import readers as R
from tessera.sources import writers as W


def test_scan_reads_only_what_is_asked_and_rejects_gaps(spark, tmp_path):
    spark.createDataFrame([(1, float("nan"), "x")], "a int, b double, c string").write.parquet(f"{tmp_path}/t")
    df = R.scan_columns(spark, f"{tmp_path}/t", ["a", "b"])
    assert df.first()["b"] is None and "ReadSchema: struct<a:int,b:double>" in df._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="lacks"):
        R.scan_columns(spark, f"{tmp_path}/t", ["z"])


def test_csv_keeps_zeros_and_splits_lists(spark, tmp_path):
    W.write_report(spark.createDataFrame([("007", "a|b")], "id string, m string"), f"{tmp_path}/r", ["id"])
    assert R.scan_csv(spark, f"{tmp_path}/r", ["id", "m"], ["m"]).first().asDict() == {"id": "007", "m": ["a", "b"]}


def test_weather_arrays_skip_the_last_day_of_leap_years(spark):
    payload = json.dumps({"data": {"year": [2024] * 365, "yday": list(range(1, 366)), "v": [1.0] * 365}})
    daily = R.daily_arrays(spark.createDataFrame([(payload,)], "p string"), "p", ["v"])
    days = {r["day"] for r in daily.collect()}
    assert dt.date(2024, 2, 29) in days and dt.date(2024, 12, 31) not in days and not R.year_violations(daily, []).collect()


def test_items_name_their_fault(spark):
    good = {"id": "i", "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": "5"}, "assets": {"b": {"href": "https://h/b?s=1"}, "a": {"href": "https://h/a"}}}
    bad = good | {"properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": "500"}}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("{}",), (None,)], "p string")
    out = R.item_rows(df, "p", ["datetime"], ["a"]).collect()
    assert [r["reject"] for r in out] == [None, "cloud", "no_id", "no_id"] and out[0]["hrefs"] == {"a": "https://h/a", "b": "https://h/b"}


def test_pages_merge_and_conflict(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "id string, v int")
    items, conflicts = R.merge_pages(df, "id", ["v"])
    assert [tuple(r) for r in items.collect()] == [("a", 1)] and [r["id"] for r in conflicts.collect()] == ["b"]


def test_months_are_clipped(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 20), dt.date(2024, 3, 5))], "a0 date, b0 date")
    assert [(r["a"], r["b"]) for r in R.month_intervals(df, "a0", "b0").orderBy("a").collect()] == [(dt.date(2024, 1, 20), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (dt.date(2024, 3, 1), dt.date(2024, 3, 5))]


def test_partitions_are_replaced_alone(spark, tmp_path):
    W.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "d int, v string"), f"{tmp_path}/p", ["d"])
    W.write_table(spark.createDataFrame([(2, "c")], "d int, v string"), f"{tmp_path}/p", ["d"])
    assert sorted((r["d"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(1, "a"), (2, "c")]
    manifest = spark.createDataFrame([(1,), (3,)], "d int")
    assert [r["d"] for r in W.pending_parts(manifest, spark.read.parquet(f"{tmp_path}/p"), ["d"]).collect()] == [3]


def test_offsets_are_mandatory_from_a_baseline_on(spark):
    def xml(*bands, q="10000"):
        return f"<p><BOA_QUANTIFICATION_VALUE>{q}</BOA_QUANTIFICATION_VALUE>" + "".join(f'<BOA_ADD_OFFSET band_id="{b}">{v}</BOA_ADD_OFFSET>' for b, v in bands) + "</p>"

    rows = [
        ("whole", "04.00", xml(("1", "-1000"), ("0", "-900"))), ("old", "02.14", xml()), ("new", "05.09", xml()), ("part", "02.14", xml(("0", "-900"))), ("text", "04.00", xml(("0", "-900"), ("1", "x"))),
        ("twice", "04.00", xml(("0", "1"), ("0", "2"), ("1", "3"))), ("zero", "04.00", xml(("0", "1"), ("1", "1"), q="0")), ("odd", "N/A", xml()), ("null", "04.00", None),
    ]
    out = R.band_offsets(spark.createDataFrame(rows, "id string, base string, x string"), "x", ["id"], "base", ["0", "1"]).collect()
    got = {}
    for r in out:
        got.setdefault(r["id"], []).append((r["band"], r["offset"], r["reject"]))
    assert got["whole"] == [("0", -900.0, None), ("1", -1000.0, None)] and got["old"] == [("0", 0.0, None), ("1", 0.0, None)]
    assert {k: v[0][2] for k, v in got.items() if v[0][0] is None} == {"new": "missing", "part": "partial", "text": "partial", "twice": "duplicate", "zero": "quantification", "odd": "baseline", "null": "quantification"}


def test_published_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/t"
    W.publish_table(spark.range(5).toDF("a"), path)
    W.publish_table(spark.read.parquet(path).where("a > 2"), path)
    assert sorted(r["a"] for r in spark.read.parquet(path).collect()) == [3, 4]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division"):
        W.publish_table(spark.range(5).selectExpr("1 div (id - 3) AS a"), path)
    assert sorted(r["a"] for r in spark.read.parquet(path).collect()) == [3, 4]


def test_reports_keep_their_order_over_several_files(spark, tmp_path):
    import glob

    W.write_report(spark.range(1000).selectExpr("lpad(cast((id * 37) % 1000 as string), 4, '0') AS id").repartition(7), f"{tmp_path}/r", ["id"])
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/r/part-*.csv")) for x in open(f).read().split()[1:]]
    assert lines == [f"{i:04d}" for i in range(1000)]
