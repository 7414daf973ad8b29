"""Sinks: published tables, report files and their records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.quality import fingerprint


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write as Parquet over what is there; a job that fails may leave nothing (see publish_table). With partitions, only those in df are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def _take_place(spark: SparkSession, fresh: str, path: str) -> None:
    """Give what was written at fresh the name path; what was there goes last, and comes back where the renaming fails."""
    old = f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = files.exists(paths(path))
    if replaced and not files.rename(paths(path), paths(old)):
        raise OSError(f"{path} could not be moved aside")
    if not files.rename(paths(fresh), paths(path)):
        if replaced:
            files.rename(paths(old), paths(path))
        raise OSError(f"{fresh} could not take the place of {path}")
    if replaced:
        files.delete(paths(old), True)


def publish_table(df: DataFrame, path: str) -> None:
    """Publish as Parquet by rename: the table is written whole beside its place and then takes it, so df may read the table it replaces.

    A job that fails leaves the old table as it was. Between two renames there is none for a moment; the old one is deleted last.
    """
    fresh = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    _take_place(df.sparkSession, fresh, path)


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Publish a table as CSV in a stated order, by rename as publish_table: files by ranges of the order, sorted inside, so their names sort as the rows do."""
    fresh = f"{path.rstrip('/')}.next-{uuid.uuid4().hex}"
    df.orderBy(*order).write.option("header", True).csv(fresh)
    _take_place(df.sparkSession, fresh, path)


def published_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength())


def table_record(df: DataFrame, path: str | None = None) -> DataFrame:
    """One row: rows, columns, schema and fingerprint of a table, and the bytes of its files where a path is given."""
    size = F.lit(published_bytes(df.sparkSession, path) if path else None).cast("long")
    return fingerprint(df, df.columns).select(F.col("n").alias("rows"), F.lit(",".join(df.columns)).alias("columns"), F.lit(df.schema.simpleString()).alias("schema"), "sha256", size.alias("bytes"))


def publish_when_whole(parts: DataFrame, manifest: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Publish a table only once every part of its manifest is there; one row (state, due, there, surplus).

    parts: the rows, with keys that name their part. As long as a part is missing the rows go to `<path>.partial` and what is published stays; once
    all are there they take the published place and the partial table goes. Parts that the manifest does not name stop the publication (state
    `surplus`) and write nothing. A manifest without parts publishes nothing.
    """
    spark, partial = parts.sparkSession, f"{path.rstrip('/')}.partial"
    have, due = parts.select(*keys).distinct().withColumn("__have", F.lit(True)), manifest.select(*keys).distinct().withColumn("__due", F.lit(True))
    n = have.join(due, [*keys], "full_outer").agg(F.count("__due").alias("due"), F.count_if(F.col("__due") & F.col("__have")).alias("there"), F.count_if(F.col("__due").isNull()).alias("surplus")).first()
    state = "surplus" if n["surplus"] else "published" if n["due"] and n["there"] == n["due"] else "partial"
    if state == "published":
        publish_table(parts, path)
        place = spark._jvm.org.apache.hadoop.fs.Path(partial)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    elif state == "partial":
        publish_table(parts, partial)
    return spark.createDataFrame([(state, n["due"], n["there"], n["surplus"])], "state string, due long, there long, surplus long")


def pending_parts(manifest: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest rows whose part is not there yet: what a resumed build still has to make."""
    return manifest.join(done.select(*keys).distinct(), [*keys], "left_anti")


def export_records(df: DataFrame, by: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(by, records): one JSON array a group, in order."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(by).agg(F.to_json(rows).alias("records"))
