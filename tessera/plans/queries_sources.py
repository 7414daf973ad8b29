"""Scans, decoders and sinks over the test tables (inventory A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.queries_metrics import rounded
from tessera.plans.registry import query
from tessera.session import table
from tessera.sources import readers as R
from tessera.sources import writers as W


@query("a01_pruned_scan", "SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem")
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan_columns(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey", "l_shipdate"]).select("l_suppkey", F.to_date("l_shipdate").alias("day")).distinct()


@query("a04_a08_daily_arrays", "SELECT user_id, year(ts) AS year, CAST(dayofyear(ts) AS BIGINT) AS yday, CAST(ts AS DATE) AS day, round(value, 6) AS v, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) * value / 1000, 6) AS energy FROM events")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel JSON arrays to one row a day: each unit's events are first packed into such a payload."""
    k = F.get_json_object("props", "$.k").cast("double")
    packed = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.year("ts").alias("year"), F.dayofyear("ts").alias("yday"), F.col("value").alias("v"), k.alias("k")))).alias("r"))
    fields = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("year", "yday", "v", "k")])
    payload = packed.select("user_id", F.to_json(F.struct(fields.alias("data"))).alias("payload"))
    daily = R.daily_arrays(payload, "payload", ["v", "k"], ["user_id"])
    return rounded(daily.select("user_id", F.col("year").cast("long").alias("year"), F.col("yday").cast("long").alias("yday"), "day", "v", (F.col("k") * F.col("v") / 1000).alias("energy")), "v", "energy")


_ITEM = "to_json(named_struct('id', concat('i', event_id), 'collection', 'c', 'properties', map('datetime', cast(ts as string), 'eo:cloud_cover', cast(value as string)), 'assets', if(event_id % 7 = 0, map('a', named_struct('href', 'https://h/a')), map('b', named_struct('href', concat('https://h/', event_id, '?sig=1#x')), 'a', named_struct('href', 'https://h/a')))))"


@query("a05_a20_a21_item_rows", "SELECT event_id, 'i' || CAST(event_id AS VARCHAR) AS id, round(value, 6) AS cloud, CASE WHEN event_id % 7 = 0 THEN 'asset' WHEN NOT value BETWEEN 0 AND 100 THEN 'cloud' END AS reject, CASE WHEN event_id % 7 <> 0 THEN 'https://h/' || CAST(event_id AS VARCHAR) END AS b_href, CAST(ts AS DATE) AS day FROM events")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "events").select("event_id", F.expr(_ITEM).alias("payload"))
    rows = R.item_rows(items, "payload", ["datetime", "eo:cloud_cover"], ["a", "b"])
    return rows.select("event_id", "id", F.round("cloud", 6).alias("cloud"), "reject", F.col("hrefs")["b"].alias("b_href"), F.to_date("acquired").alias("day"))


@query("a06_a18_eligible_items", "SELECT event_id, CASE event_type WHEN 'click' THEN 'SENSOR-A' WHEN 'view' THEN 'SENSOR-B' END AS platform, 'WRS2-' || lpad(CAST(user_id % 250 AS VARCHAR), 3, '0') || lpad(CAST(event_id % 90 AS VARCHAR), 3, '0') AS unit, CAST(ts - INTERVAL 8 HOUR AS DATE) AS local_day FROM events WHERE event_type IN ('click', 'view') AND ts < TIMESTAMP '2024-03-01' AND month(ts - INTERVAL 8 HOUR) = 1")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.scalars import alias, local_date

    local = local_date(F.col("ts"), "America/Los_Angeles")
    rows = table(spark, sf_dir, "events").withColumns({"platform": alias(F.col("event_type"), {"click": "SENSOR-A", "view": "SENSOR-B"}), "local_day": local})
    rows = rows.where((F.col("ts") < F.lit("2024-03-01").cast("timestamp")) & F.col("platform").isNotNull() & (F.month("local_day") == 1))
    return rows.select("event_id", "platform", F.concat(F.lit("WRS2-"), F.lpad((F.col("user_id") % 250).cast("string"), 3, "0"), F.lpad((F.col("event_id") % 90).cast("string"), 3, "0")).alias("unit"), "local_day")


@query("a07_merge_pages", "SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS variants FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) = 1")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    items, _ = R.merge_pages(li, "key", ["l_partkey"])
    return items.select(F.split("key", "/")[0].cast("long").alias("l_orderkey"), F.split("key", "/")[1].cast("int").alias("l_linenumber"), F.lit(1).cast("long").alias("variants"))


@query(
    "a09_band_offsets",
    """
    WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN 2.0 ELSE 4.0 END AS b, CASE WHEN p_size > 20 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END AS n FROM part),
    r AS (SELECT *, CASE WHEN n = 0 AND b >= 4 THEN 'missing' WHEN n = 1 THEN 'partial' END AS reject FROM p)
    SELECT p_partkey, CAST(p_size + 1 AS DOUBLE) AS quantification, z.band AS band, CASE WHEN n = 0 THEN 0.0 WHEN z.band = '0' THEN -p_size ELSE -1000 END AS "offset", reject FROM r, (SELECT unnest(['0', '1']) AS band) z WHERE reject IS NULL
    UNION ALL SELECT p_partkey, CAST(p_size + 1 AS DOUBLE), NULL, NULL, reject FROM r WHERE reject IS NOT NULL
    """,
)
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product metadata in XML, written from the part table: with both bands, with one, or with none, of an old and a new baseline."""
    xml = F.expr("concat('<p><BOA_QUANTIFICATION_VALUE>', p_size + 1, '</BOA_QUANTIFICATION_VALUE><l>', if(p_size > 10, concat('<BOA_ADD_OFFSET band_id=\"0\">-', p_size, '</BOA_ADD_OFFSET>'), ''), if(p_size > 20, '<BOA_ADD_OFFSET band_id=\"1\">-1000</BOA_ADD_OFFSET>', ''), '</l></p>')")
    parts = table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml"), F.when(F.col("p_partkey") % 3 == 0, "02.00").otherwise("04.00").alias("baseline"))
    return R.band_offsets(parts, "xml", ["p_partkey"], "baseline", ["0", "1"])


@query("a10_decode_cells", "SELECT p_partkey, round(CASE WHEN p_size <> 50 THEN p_size * 0.5 - 3.0 END, 6) AS value, p_size % 3 <> 0 AS id_agrees FROM part")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("cell", F.format_string("x%.3f_y%.3f", (F.col("p_size") + F.when(F.col("p_size") % 3 == 0, 1).otherwise(0)).cast("double"), F.col("p_retailprice")))
    return rounded(R.decode_cells(p, "p_size", "p_size", "p_retailprice", "cell", 0.5, -3.0, 50).select("p_partkey", "value", "id_agrees"), "value")


@query("a11_widen", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, round(max(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 6) AS A, round(max(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 6) AS N, round(max(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS R, count(DISTINCT l_returnflag) = 3 AS complete FROM lineitem GROUP BY 1, 2")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return R.widen(li, ["l_suppkey", "day"], "l_returnflag", "l_quantity", ["A", "N", "R"])


@query("a14_table_record")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.table_record(table(spark, sf_dir, "orders"))


@query("a15_pending_parts", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_linenumber = 1)")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return W.pending_parts(manifest, table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.to_date("l_shipdate").alias("day")), ["day"])


@query("a16_month_intervals", "WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1), m AS (SELECT *, CAST(unnest(generate_series(date_trunc('month', first_day), date_trunc('month', last_day), INTERVAL 1 MONTH)) AS DATE) AS m FROM s) SELECT o_custkey, first_day, last_day, greatest(first_day, m) AS a, least(last_day, last_day(m)) AS b FROM m")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"))
    return R.month_intervals(s, "first_day", "last_day")


@query("a17_export_records", "SELECT o_custkey, '[' || string_agg('{\"o_orderkey\":' || CAST(o_orderkey AS VARCHAR) || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS records FROM orders GROUP BY 1")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.export_records(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"])


@query("a19_source_completeness", "WITH s AS (SELECT year(l_shipdate) AS yr, l_returnflag AS v, count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'A' AND year(l_shipdate) = 1997) GROUP BY 1, 2) SELECT yr, count(*) AS variables, count(*) = 3 AS complete FROM s GROUP BY 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").where("not (l_returnflag = 'A' and year(l_shipdate) = 1997)")
    found = s.groupBy(F.year("l_shipdate").cast("long").alias("yr")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("v"))
    return found.select("yr", F.size("v").cast("long").alias("variables"), (F.col("v") == F.array(*[F.lit(x) for x in "ANR"])).alias("complete"))


@query("a22_axis_days", "SELECT p_partkey, CAST(TIMESTAMP '1980-01-01 12:00:00' + to_hours(CAST(p_size * 36 AS BIGINT)) AS DATE) AS day FROM part")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", R.axis_days(F.col("p_size") * 36, F.lit("1980-01-01 12:00:00").cast("timestamp"), 3600).alias("day"))


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a12_published_table", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published twice at one place: what is read is the second, whole."""
    path = _scratch(spark, "published")
    li = table(spark, sf_dir, "lineitem")
    W.publish_table(li.select("l_returnflag", "l_quantity"), path)
    again = spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"))
    W.publish_table(again, path)
    return spark.read.parquet(path)


@query("a02_a03_a13_csv_round_trip", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS id, s_name AS name, CAST(2 AS BIGINT) AS parts FROM supplier")
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a report and read back as strings, a joined list split again."""
    path = _scratch(spark, "report")
    ids = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    W.write_report(table(spark, sf_dir, "supplier").select(ids.alias("id"), F.col("s_name").alias("name"), F.concat_ws("|", ids, "s_name").alias("members")), path, ["id"])
    back = R.scan_csv(spark, path, ["id", "name", "members"], ["members"])
    return back.select("id", "name", F.size("members").cast("long").alias("parts"))


@query("a14_published_record", "SELECT count(*) AS rows, 's_suppkey,s_name' AS columns, true AS has_bytes FROM supplier")
def a14_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a published table, with the bytes of its files."""
    path = _scratch(spark, "recorded")
    W.publish_table(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return W.table_record(spark.read.parquet(path), path).select("rows", "columns", (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "a15_gated_publication",
    """WITH p AS (SELECT DISTINCT year(l_shipdate) AS yr FROM lineitem), d AS (SELECT count(*) AS n FROM p), r AS (SELECT count(*) AS n FROM lineitem), f AS (SELECT count(*) AS n FROM lineitem WHERE year(l_shipdate) = (SELECT min(yr) FROM p))
    SELECT 1 AS step, 'partial' AS state, (SELECT n FROM d) AS due, CAST(1 AS BIGINT) AS there, CAST(0 AS BIGINT) AS surplus, CAST(0 AS BIGINT) AS published, (SELECT n FROM f) AS partial
    UNION ALL SELECT 2, 'published', (SELECT n FROM d), (SELECT n FROM d), 0, (SELECT n FROM r), 0 UNION ALL SELECT 3, 'surplus', 1, 1, (SELECT n FROM d) - 1, (SELECT n FROM r), 0""",
)
def a15_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by year under a manifest: one year gives a partial table, all years the published one, years beyond the manifest nothing."""
    path = _scratch(spark, "gated")
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("yr"), "l_orderkey", "l_linenumber")
    years = rows.select("yr").distinct()
    first = years.agg(F.min("yr").alias("yr"))

    def held(place: str) -> int:
        p = spark._jvm.org.apache.hadoop.fs.Path(place)
        return spark.read.parquet(place).count() if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else 0

    out = None
    for step, (part, manifest) in enumerate(((rows.join(first, "yr"), years), (rows, years), (rows, first)), 1):
        state = W.publish_when_whole(part, manifest, ["yr"], path).withColumns({"step": F.lit(step), "published": F.lit(held(path)).cast("long"), "partial": F.lit(held(f"{path}.partial")).cast("long")})
        out = state if out is None else out.unionByName(state)
    return out
