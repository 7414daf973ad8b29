"""Scalar expressions over the test tables (inventory B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.registry import query
from tessera.session import table


@query("b01_bit_mask", "SELECT l_orderkey, l_linenumber, (l_linenumber & 191) = 0 AS clear, (l_linenumber & 6) = 0 AS clear_low, (l_linenumber >> 1) & 1 = 1 AS second FROM lineitem")
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.bits_clear(n).alias("clear"), S.bits_clear(n, (1, 2)).alias("clear_low"), S.bit_set(n, 1).alias("second"))


@query("b02_b03_scale_and_plausible", "SELECT p_partkey, round(p_retailprice * 30 * 0.00341802 + (149.0 - 273.15), 9) AS celsius, p_retailprice * 30 * 0.00341802 + (149.0 - 273.15) BETWEEN -30 AND 80 AS ok FROM part")
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.linear(F.col("p_retailprice") * 30)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(c, 9).alias("celsius"), S.plausible(c).alias("ok"))


@query(
    "b04_composite_validity",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, (l_linenumber & 1) = 0 AS footprint, (l_linenumber & 6) = 0 AS clear, l_quantity * 0.01 AS uncertainty, l_extendedprice * 0.0001 AS distance, l_tax FROM lineitem)
    SELECT l_orderkey, l_linenumber, footprint, footprint AND clear AND distance >= 1 AND l_tax <> 0.08 AS valid, footprint AND clear AND distance >= 1 AND l_tax <> 0.08 AND uncertainty <= 0.3 AS valid_strict FROM p
    """,
)
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprint, validity, and validity under an uncertainty bound, as one projection over the pixel table."""
    n = F.col("l_linenumber")
    footprint = S.bits_clear(n, (0,))
    valid = footprint & S.bits_clear(n, (1, 2)) & (F.col("l_extendedprice") * 0.0001 >= 1) & (F.col("l_tax") != 0.08)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", footprint.alias("footprint"), valid.alias("valid"), (valid & (F.col("l_quantity") * 0.01 <= 0.3)).alias("valid_strict"))


@query("b05_land_mask", "SELECT p_partkey, p_size <> 0 AND p_size NOT IN (11, 12, 21) AS land FROM part")
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.in_classes(F.col("p_size"), 0, (11, 12, 21)).alias("land"))


@query(
    "b06_b07_decode_reflectance",
    """
    SELECT p_partkey, round(CASE WHEN p_size NOT IN (0, 50) THEN (p_size + o) / 100.0 END, 6) AS reflectance, round(CASE WHEN p_size NOT IN (0, 50) THEN p_size * 0.01 - 0.1 END, 6) AS scaled
    FROM part JOIN (SELECT r_name AS brand_region, -r_regionkey AS o, r_regionkey AS k FROM region) ON p_partkey % 5 = k
    """,
)
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration is a small dimension of five rows, joined by key."""
    calibration = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), (-F.col("r_regionkey")).alias("o"))
    dn = F.col("p_size")
    return table(spark, sf_dir, "part").join(calibration, F.col("p_partkey") % 5 == F.col("k")).select("p_partkey", F.round(S.decode_counts(dn, F.col("o"), F.lit(100.0), 0, 50), 6).alias("reflectance"), F.round(S.scaled_counts(dn, F.lit(0.01), F.lit(-0.1), 0, 50), 6).alias("scaled"))


@query("b08_b09_clear_and_ratio", "SELECT l_orderkey, l_linenumber, l_linenumber IN (4, 5) AND l_tax IS NOT NULL AS clear, round(CASE WHEN abs(l_discount) >= 0.000001 THEN l_tax / l_discount END, 6) AS tax_ratio FROM lineitem")
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.clear_surface(F.col("l_linenumber"), [F.col("l_tax")]).alias("clear"), F.round(S.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("tax_ratio"))


@query(
    "b10_optical_indices",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS blue, l_tax AS green, l_quantity / 100.0 AS red, l_extendedprice / 100000.0 AS nir, (l_discount + l_tax) AS swir1, l_quantity / 50.0 AS swir2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(nir + red) >= 1e-6 THEN (nir - red) / (nir + red) END, 9) AS ndvi,
      round(CASE WHEN abs(nir + 6.0 * red - 7.5 * blue + 1.0) >= 1e-6 THEN 2.5 * (nir - red) / (nir + 6.0 * red - 7.5 * blue + 1.0) END, 9) AS evi,
      round(CASE WHEN abs(green + nir) >= 1e-6 THEN (green - nir) / (green + nir) END, 9) AS ndwi,
      round(CASE WHEN abs(swir1 + nir) >= 1e-6 THEN (swir1 - nir) / (swir1 + nir) END, 9) AS ndbi,
      round(blue * 0.3 + red * 0.3 + nir * 0.2 + swir1 * 0.1 + swir2 * 0.1, 9) AS albedo FROM b
    """,
)
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    found = S.optical_indices(c("l_discount"), c("l_tax"), c("l_quantity") / 100.0, c("l_extendedprice") / 100000.0, c("l_discount") + c("l_tax"), c("l_quantity") / 50.0, {"blue": 0.3, "red": 0.3, "nir": 0.2, "swir1": 0.1, "swir2": 0.1})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 9).alias(k) for k, v in found.items()])


@query(
    "b11_season_phase",
    """
    WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), y AS (SELECT day, dayofyear(make_date(year(day), 12, 31)) AS n FROM d)
    SELECT day, CAST(n AS BIGINT) AS year_length, round(sin((dayofyear(day) - 1) * 2 * pi() / n), 6) AS phase_sin, round(cos((dayofyear(day) - 1) * 2 * pi() / n), 6) AS phase_cos FROM y
    """,
)
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, n = S.season_phase(F.col("day"))
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", n.cast("long").alias("year_length"), F.round(s, 6).alias("phase_sin"), F.round(c, 6).alias("phase_cos"))


@query("b12_b13_canonical_values", "SELECT event_id, date_trunc('day', ts) = ts AS midnight, event_type = trim(event_type) AND length(event_type) > 0 AS canonical FROM events")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.is_civil_midnight(F.col("ts")).alias("midnight"), S.is_canonical(F.col("event_type")).alias("canonical"))


@query("b14_local_date", "SELECT event_id, CAST(ts - INTERVAL 8 HOUR AS DATE) AS local_day FROM events WHERE ts < TIMESTAMP '2024-03-10'")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-03-10").cast("timestamp")).select("event_id", S.local_date(F.col("ts"), "America/Los_Angeles").alias("local_day"))


@query("b15_utc_bounds", "SELECT DISTINCT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR AS first_utc, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 32 HOUR AS end_utc FROM events WHERE ts < TIMESTAMP '2024-03-09'")
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    first, end = S.utc_bounds(day, day, "America/Los_Angeles")
    return table(spark, sf_dir, "events").where(F.col("ts") < F.lit("2024-03-09").cast("timestamp")).select(day.alias("day"), first.alias("first_utc"), end.alias("end_utc")).distinct()


@query("b16_canonical_url", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS canonical FROM pages")
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_url(F.col("url")).alias("canonical"))


@query(
    "b17_b19_identifiers",
    """
    SELECT p_partkey, regexp_replace(upper(trim(p_brand)), '(#[0-9]+)$', '') AS stem, CASE lower(trim(p_type)) WHEN 'promo' THEN 'P' WHEN 'standard' THEN 'S' END AS platform,
      CAST(printf('%02d', p_size // 10) AS BIGINT) AS major, CAST(printf('%02d', p_size % 10) AS BIGINT) AS minor FROM part
    """,
)
def b17(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = S.version_key(F.format_string("%02d.%02d", F.floor(F.col("p_size") / 10).cast("int"), (F.col("p_size") % 10).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", S.strip_suffix(F.col("p_brand"), r"#\d+").alias("stem"), S.alias(F.col("p_type"), {"promo": "P", "standard": "S"}).alias("platform"), key["major"].cast("long").alias("major"), key["minor"].cast("long").alias("minor"))


@query("b20_eligible", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '1%' AND list_has_all(string_split(o_orderpriority, '-'), ['1'])")
def b20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility: allowed platform, tier, and all required assets among those listed."""
    assets = F.split("o_orderpriority", "-")
    has_all = F.forall(F.array(F.lit("1")), lambda x: F.array_contains(assets, x))
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").startswith("1") & has_all).select("o_orderkey")


@query(
    "b21_b24_codes",
    """
    SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS geoid, 'Unit ' || CAST(s_suppkey AS VARCHAR) AS name, printf('%s%02d%s%03d', CASE WHEN s_nationkey - 12 >= 0 THEN 'N' ELSE 'S' END, abs(s_nationkey - 12), CASE WHEN s_nationkey - 15 >= 0 THEN 'E' ELSE 'W' END, abs(s_nationkey - 15)) AS tile,
      CAST(s_nationkey AS VARCHAR) AS root FROM supplier
    """,
)
def b21(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.zero_pad(F.col("s_suppkey"), 6).alias("geoid"), S.display_name(F.lit(" Unit "), F.col("s_suppkey").cast("string")).alias("name"), S.degree_tile(n - 12, n - 15).alias("tile"), S.component_root(F.concat(n.cast("string"), F.lit("-E"))).alias("root"))


@query(
    "b25_b26_blocks_and_bins",
    """
    SELECT p_partkey, printf('x%+05d_y%+05d', CAST(floor((p_size - 25) / 7.0) AS INT), CAST(floor((p_retailprice - 1500) / 100.0) AS INT)) AS block, CAST(floor((p_size - 25) / 7.0) AS BIGINT) AS bx, CAST(floor((p_retailprice - 1500) / 100.0) AS BIGINT) AS by_,
      CASE WHEN p_size >= 10 AND p_size < 20 THEN '[10.0, 20.0)' WHEN p_size >= 20 AND p_size < 40 THEN '[20.0, 40.0)' WHEN p_size >= 40 THEN '[40.0, inf)' END AS bin FROM part
    """,
)
def b25(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.floor((F.col("p_size") - 25) / 7.0).cast("int"), F.floor((F.col("p_retailprice") - 1500) / 100.0).cast("int")
    blocks = table(spark, sf_dir, "part").select("p_partkey", "p_size", S.block_id(x.cast("double"), y.cast("double"), 1.0).alias("block"))
    bx, by = S.parse_block(F.col("block"))
    return blocks.select("p_partkey", "block", bx.cast("long").alias("bx"), by.cast("long").alias("by_"), S.interval_label(F.col("p_size"), [10.0, 20.0, 40.0]).alias("bin"))


@query(
    "b27_b28_forbidden_names",
    "SELECT column_name AS name FROM (SELECT unnest(['l_orderkey', 'l_quantity', 'l_tax', 'fold_id', 'x_coord', 'target_mean', 'l_discount']) AS column_name FROM (SELECT 1 FROM region LIMIT 1)) WHERE regexp_matches(lower(column_name), '(^|_)(orderkey|fold|coord|target|qa)(_|$)')",
)
def b27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry names that hold a forbidden token; must be empty for a legal registry. The registry rows ride on the region table's first row."""
    names = ["l_orderkey", "l_quantity", "l_tax", "fold_id", "x_coord", "target_mean", "l_discount"]
    registry = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return registry.where(S.has_token(F.col("name"), ["orderkey", "fold", "coord", "target", "qa"]))


@query("b29_b30_registry_projection", "SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_tax, l_returnflag AS audit FROM lineitem")
def b29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, the model matrix in registry order, and the audit column, by role."""
    roles = [("l_orderkey", "key"), ("l_linenumber", "key"), ("l_discount", "model"), ("l_quantity", "model"), ("l_tax", "model"), ("l_returnflag", "audit")]
    pick = lambda role: [n for n, r in roles if r == role]
    return table(spark, sf_dir, "lineitem").select(*pick("key"), *pick("model"), *[F.col(n).alias("audit") for n in pick("audit")])


@query("b31_utm_zone", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey + 1 <= 60 THEN CASE WHEN n_nationkey % 2 = 0 THEN 32600 ELSE 32700 END + n_nationkey + 1 END AS BIGINT) AS epsg FROM nation")
def b31(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    tile = F.format_string("%02d%sAB", (n + 1).cast("int"), F.when(n % 2 == 0, "S").otherwise("H"))
    return table(spark, sf_dir, "nation").select("n_nationkey", S.utm_epsg(tile).cast("long").alias("epsg"))
