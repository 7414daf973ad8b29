"""Scans with fixed schemas. Nothing is inferred: a column that is missing is an error, and NaN becomes null at the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A Parquet scan of these columns alone; the rest is never read. Missing columns raise."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return nan_to_null(df.select(*columns))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def scan_csv(spark: SparkSession, path: str, columns: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """A CSV whose columns are all read as strings, so that identifiers keep their leading zeros; `lists` are split at `|`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return df.withColumns({c: F.split(c, r"\|") for c in lists}) if lists else df


def daily_arrays(df: DataFrame, payload: str, variables: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, year, yday, day, variables): JSON of parallel arrays `{"data": {"year": [], "yday": [], ...}}` as one row a day.

    The day counts from January 1, so a leap year has February 29 and no December 31.
    """
    names = ["year", "yday", *variables]
    body = ", ".join(f"`{n}`: array<double>" for n in names)
    parsed = df.select(*keys, F.from_json(payload, f"struct<data: struct<{body}>>")["data"].alias("__d"))
    rows = parsed.select(*keys, F.explode(F.arrays_zip(*[F.col(f"__d.{n}").alias(n) for n in names])).alias("z")).select(*keys, *[F.col(f"z.{n}").alias(n) for n in names])
    year, yday = F.col("year").cast("int"), F.col("yday").cast("int")
    return rows.withColumns({"year": year, "yday": yday, "day": F.date_add(F.make_date(year, F.lit(1), F.lit(1)), yday - 1)})


def year_violations(daily: DataFrame, keys: Sequence[str], days: int = 365) -> DataFrame:
    """(keys, year, n): years without exactly that many distinct days."""
    return daily.groupBy(*keys, "year").agg(F.countDistinct("yday").alias("n")).where(F.col("n") != days)


ITEM_SCHEMA = "struct<id: string, collection: string, properties: map<string, string>, assets: map<string, struct<href: string>>>"


def item_rows(df: DataFrame, payload: str, required_properties: Sequence[str], required_assets: Sequence[str]) -> DataFrame:
    """(id, acquired, cloud, hrefs, reject): catalogue items from JSON; `reject` names what is wrong, null for a good row.

    Hrefs come without query and fragment, sorted by asset.
    """
    item = F.from_json(payload, ITEM_SCHEMA)
    rows = df.select("*", item.alias("__i"))
    p, a = F.col("__i.properties"), F.col("__i.assets")
    cloud = p["eo:cloud_cover"].try_cast("double")
    acquired = F.try_to_timestamp(p["datetime"])
    lacks = lambda m, names: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: ~F.coalesce(F.array_contains(F.map_keys(m), n), F.lit(False)))
    reject = F.when(F.col("__i.id").isNull(), "no_id").when(lacks(p, required_properties), "property").when(lacks(a, required_assets), "asset").when(acquired.isNull(), "datetime").when(~F.coalesce(cloud.between(0, 100), F.lit(False)), "cloud")
    hrefs = F.transform(F.array_sort(F.map_entries(a)), lambda e: F.struct(e["key"].alias("key"), F.regexp_replace(e["value"]["href"], r"[?#].*$", "").alias("value")))
    return rows.select(*df.columns, F.col("__i.id").alias("id"), acquired.alias("acquired"), cloud.alias("cloud"), F.map_from_entries(hrefs).alias("hrefs"), reject.alias("reject"))


def merge_pages(pages: DataFrame, item_id: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(items, conflicts): one row an id over all pages, and the ids whose repeats differ."""
    content = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    seen = pages.withColumn("__h", content).groupBy(item_id).agg(F.countDistinct("__h").alias("variants"), *[F.first(c).alias(c) for c in columns])
    return seen.where("variants = 1").drop("variants"), seen.where("variants > 1").select(item_id, "variants")


def band_offsets(df: DataFrame, xml: str, keys: Sequence[str], baseline: str, bands: Sequence[str], since: float = 4.0) -> DataFrame:
    """(keys, quantification, band, offset, reject): per-band offsets of product metadata in XML, a row for each of the required bands.

    Products of baseline `since` or later must state an offset for every band; older ones without any have zeros. A product that may not be
    used has one row without a band, and `reject` says why: no quantification value, a baseline that is no number, a band listed twice, some
    required bands without an offset (partial), or none where they are mandatory (missing).
    """
    q = F.xpath_double(xml, F.lit("//BOA_QUANTIFICATION_VALUE"))
    named, values = F.xpath(xml, F.lit("//BOA_ADD_OFFSET/@band_id")), F.xpath(xml, F.lit("//BOA_ADD_OFFSET/text()"))
    required = F.array(*[F.lit(b) for b in bands])
    rows = df.select(*keys, q.alias("quantification"), F.col(baseline).try_cast("double").alias("__b"), named.alias("__named"), F.transform(values, lambda v: v.try_cast("double")).alias("__values"))
    lacks = F.size(F.array_except(required, "__named")) > 0
    broken = (F.size("__named") != F.size("__values")) | F.exists("__values", lambda v: v.isNull())
    reject = (
        F.when(F.isnan("quantification") | (F.col("quantification") <= 0) | F.col("quantification").isNull(), "quantification")
        .when(F.col("__b").isNull(), "baseline")
        .when(F.size(F.array_distinct("__named")) != F.size("__named"), "duplicate")
        .when((F.size("__named") == 0) & (F.col("__b") >= since), "missing")
        .when((F.size("__named") > 0) & (lacks | broken), "partial")
    )
    offset = lambda band: F.when(F.size("__named") == 0, F.lit(0.0)).otherwise(F.element_at("__values", F.array_position("__named", band).cast("int")))
    listed = F.when(F.col("reject").isNull(), F.transform(required, lambda band: F.struct(band.alias("band"), offset(band).alias("offset")))).otherwise(F.array(F.lit(None).cast("struct<band: string, offset: double>")))
    return rows.withColumn("reject", reject).select(*keys, "quantification", F.explode(listed).alias("z"), "reject").select(*keys, "quantification", "z.band", "z.offset", "reject")


def decode_cells(df: DataFrame, raw: str, x: str, y: str, cell_id: str, scale: float, offset: float, nodata: float) -> DataFrame:
    """Adds value (null at nodata) and id_agrees: whether the cell's id is written from its coordinates."""
    return df.withColumns({"value": F.when(F.col(raw) != nodata, F.col(raw) * scale + offset), "id_agrees": F.col(cell_id) == F.format_string("x%.3f_y%.3f", F.col(x).cast("double"), F.col(y).cast("double"))})


def widen(long: DataFrame, keys: Sequence[str], variable: str, value: str, variables: Sequence[str]) -> DataFrame:
    """One row a key with a column a variable, and complete: whether all are there. The variables are listed, so one aggregate does it."""
    wide = long.groupBy(*keys).agg(*[F.max(F.when(F.col(variable) == v, F.col(value))).alias(v) for v in variables], F.countDistinct(variable).alias("__n"))
    return wide.withColumn("complete", F.col("__n") == len(variables)).drop("__n")


def month_intervals(df: DataFrame, first: str, last: str) -> DataFrame:
    """(other columns, a, b): a date range split at month ends."""
    rows = df.withColumn("__m", F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))))
    return rows.select(*df.columns, F.greatest(F.col(first), F.col("__m")).alias("a"), F.least(F.col(last), F.last_day("__m")).alias("b"))


def axis_days(offset: Column, origin: Column, unit_seconds: int) -> Column:
    """Civil day of a numeric time axis: an offset in units since an origin."""
    return F.to_date(F.timestamp_seconds(F.unix_timestamp(origin) + offset * unit_seconds))
