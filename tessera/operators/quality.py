"""Contract checks that return their violations, so a caller can fail closed, and order-free fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract; the message lists the first violations."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with some examples if there is a violation: the one action that a gate needs."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): keys of more than one row, null keys among them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def locked_rows(df: DataFrame, day: str, first_locked_year: int) -> DataFrame:
    return df.where(F.year(day) >= first_locked_year)


def late_windows(df: DataFrame, window_end: str, day: str) -> DataFrame:
    """Rows whose feature window reaches their target date."""
    return df.where(F.col(window_end) >= F.col(day))


def gate_mismatches(df: DataFrame, value: str, gate: Column) -> DataFrame:
    """Rows whose value is there without the gate, or missing though it passes."""
    return df.where(F.coalesce(gate, F.lit(False)) != F.col(value).isNotNull())


def partly_missing(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, missing): rows in which some, but not all, of a group of columns are null."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return df.select(*keys, missing.alias("missing")).where((F.col("missing") > 0) & (F.col("missing") < len(columns)))


def varying(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, variants): keys for which what should be fixed takes several values."""
    return df.groupBy(key).agg(F.countDistinct(F.struct(*columns)).alias("variants")).where("variants > 1")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, repeated ones counted, that only one side has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def mismatched_values(stored: DataFrame, recomputed: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, column): stored numbers that differ from recomputed ones by more than the tolerance, or stand alone."""
    j = stored.select(*keys, *[F.col(c).alias(f"__s_{c}") for c in columns]).join(recomputed.select(*keys, *[F.col(c).alias(f"__r_{c}") for c in columns]), [*keys], "full_outer")
    bad = lambda c: F.coalesce(F.abs(F.col(f"__s_{c}") - F.col(f"__r_{c}")) > tolerance, ~(F.col(f"__s_{c}").isNull() & F.col(f"__r_{c}").isNull()))
    return j.select(*keys, F.explode(F.filter(F.array(*[F.when(bad(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())).alias("column"))


def broken_rules(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule): every rule that a row does not fulfil, in one pass; a rule that is null counts as broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(broken).alias("rule"))


def incomplete_grid(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of the keys' own values that have no row. The keys' values are dimensions."""
    grid = df.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(df.select(k).distinct())
    return grid.join(df.select(*keys).distinct(), [*keys], "left_anti")


def row_hash(columns: Sequence[str]) -> Column:
    """Hash of a row's values; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _hash_sums() -> list[Column]:
    return [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for i in range(4)]


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n, sha256) that does not depend on row order; two tables with equal rows, repeated ones counted, agree.

    The rows' hashes are added up, in four numbers of 60 bits each, so one pass does it and no hash is shuffled. That tells tables apart
    that differ by chance or mistake; it is no proof against someone who looks for rows with a wanted sum.
    """
    h = df.select(row_hash(columns).alias("h"))
    return h.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *_hash_sums()), 256).alias("sha256"))


def group_fingerprints(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, n, sha256) of each group's set of distinct rows, added up as in fingerprint(); n counts all rows. No group comes together."""
    rows = df.select(*by, row_hash(columns).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("__n"))
    return rows.groupBy(*by).agg(F.sum("__n").alias("n"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *_hash_sums()), 256).alias("sha256"))
