"""What the operators of this subpackage share: scratch tables, hashing and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the polynomial hashes (odd, 64 bits).
BASE = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    return stage_at(df, scratch_path(df.sparkSession, name), codec)


def stage_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """As stage(), at a path. The table stands for its query from now on, so the query's shuffle files go as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        conf.set(key, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def set_aside(df: DataFrame, name: str) -> str:
    """A name for a column of our own that no column of df has."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (an invertible finaliser), so that their order and low bits are as good as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Up to parts - 1 increasing values that cut a column into ranges of like row counts, from a quantile summary over all rows."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(F.expr(f"percentile_approx({column}, array({','.join(map(str, shares))}), 10000)").alias("q")).first()
    return sorted(set(row["q"] or []))


def range_bucket(column: str, bounds: list[int]):
    """The number of bounds at or below a value; nulls fall into bucket 0."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(int(b)) for b in bounds])
    return F.coalesce(F.size(F.filter(array, lambda b: b <= F.col(column))), F.lit(0))


def _local_forest(edges):
    """Per partition: a spanning forest of its edges, each vertex tied to the least vertex of its tree."""
    import pyarrow as pa

    parent: dict = {}

    def root(v):
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = p
        return v

    for batch in edges:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        # what has been gathered is handed on once it is large, so that a task's memory stays bounded
        if len(parent) > 500_000:
            out = [(v, root(v)) for v in parent if root(v) != v]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=batch.schema.field(i).type) for i in (0, 1)], ["a", "b"])
            parent = {}
    out = [(v, root(v)) for v in parent if root(v) != v]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=batch.schema.field(i).type) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame, thin: bool = True, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (a, b): rows (v, component) for each vertex with an edge, component the least vertex.

    Alternates large-star and small-star steps, which shrink the longest path by a constant factor a round; each step is a group
    minimum and a join on the vertex. A hub's edges are aggregated before they are shuffled. Vertices may be of any orderable type. With
    `thin`, each partition's edges are first cut down to a spanning forest; edges that are one already need no Python worker for it.
    """
    edges = edges.select("a", "b").where("a <> b")
    if thin:
        edges = edges.mapInArrow(_local_forest, edges.schema)
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "edges")
    edges = stage_at(edges.distinct(), path)
    # distinct edges by their number and the sum of their hashes: equal where nothing changes any more, from one pass over what was written
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = mark(edges)
    for _ in range(max_rounds):
        # large-star: every neighbour above v, and v itself, go to the least of v and its neighbours
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: of v's neighbours at or below it, all go to the least
        large = large.where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, path = path, scratch_path(spark, "edges")
        after = stage_at(small.where("a <> b").distinct(), path)
        edges, last, seen = after, seen, mark(after)
        discard(spark, before)
        if seen == last:
            break
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v")
    return stars.union(edges.select(F.col("b").alias("v"), F.col("b").alias("component"))).groupBy("v").agg(F.min("component").alias("component"))
