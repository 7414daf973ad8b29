"""A stream of files gives the days that the watermark has passed, equal to the batch result."""

from __future__ import annotations

import datetime as dt

from tessera.streaming.daily import append_daily, daily_panel


def test_stream_equals_batch_for_finished_days(spark, tmp_path):
    schema = "user int, ts timestamp, v double"
    rows = [(u, dt.datetime(2024, 1, d, h), float(u + h)) for d in range(1, 9) for u in (1, 2) for h in (3, 12)]
    for i in range(0, len(rows), 8):
        spark.createDataFrame(rows[i : i + 8], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = append_daily(daily_panel(stream, "user", "ts", "v", "10 days"), f"{tmp_path}/out", f"{tmp_path}/chk").trigger(availableNow=True).start()
    run.awaitTermination(120)
    spark.createDataFrame([(1, dt.datetime(2024, 2, 1), 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = append_daily(daily_panel(stream, "user", "ts", "v", "10 days"), f"{tmp_path}/out", f"{tmp_path}/chk").trigger(availableNow=True).start()
    again.awaitTermination(120)
    got = {(r["user"], r["day"], r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["user"], r["day"], r["n"], r["total"]) for r in daily_panel(spark.createDataFrame(rows, schema), "user", "ts", "v").collect()}
    assert got == want
