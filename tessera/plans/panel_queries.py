"""Queries over the test tables, one or more for each operator family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.plans.registry import query
from tessera.session import table


@query(
    "e03_trailing_windows",
    """
    WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2),
    w AS (SELECT user_id, day,
        CASE WHEN count(v) OVER w3 = 3 THEN sum(v) OVER w3 END AS sum3
        FROM d WINDOW w3 AS (PARTITION BY user_id ORDER BY date_diff('day', DATE '2024-01-01', day) RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING))
    SELECT user_id, day, round(sum3, 6) AS sum3 FROM w
    """,
)
def trailing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.datediff("day", F.lit("2024-01-01"))).rangeBetween(-3, -1)
    return daily.select("user_id", "day", F.round(F.when(F.count("v").over(w) == 3, F.sum("v").over(w)), 6).alias("sum3"))
