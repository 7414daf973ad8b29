"""Cluster bootstraps, permutation tests and gates. Draws come from hashes, so they repeat anywhere and SQL can follow them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_draw(seed: int, kind: str, n: Column, *ids: Column) -> Column:
    """A number from 0 to n - 1 from the first 32 bits of md5(`seed:kind:id:...`)."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(kind), *[i.cast("string") for i in ids])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), n)


def error_cells(pairs: DataFrame, by: Sequence[str], day: str, block: str, truth: str, baseline: str, target: str) -> DataFrame:
    """(by, day, block, n, baseline_sum, target_sum): the sums that resampling needs; replicates then multiply cells and not rows."""
    e = lambda c: F.sum(F.abs(F.col(c) - F.col(truth)))
    return pairs.groupBy(*by, day, block).agg(F.count(F.lit(1)).alias("n"), e(baseline).alias("baseline_sum"), e(target).alias("target_sum"))


#: Replicates in one array.
CHUNK = 1000


def _multiplicity(cells: DataFrame, by: Sequence[str], column: str, kind: str, seed: int, replicates: int) -> DataFrame:
    """(by, column, chunk, m_kind): how often each cluster is drawn in each replicate of a chunk, as packed 32-bit numbers; a row a cluster and chunk."""
    w = Window.partitionBy(*by)
    dim = cells.select(*by, column).distinct().withColumns({"__i": (F.row_number().over(w.orderBy(column)) - 1).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    texts = [f"__by{i}" for i in range(len(by))]
    one = dim.select(*by, "__n").distinct().withColumns({t: F.col(c).cast("string") for t, c in zip(texts, by, strict=True)})
    one = one.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // CHUNK).cast("long"))))
    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by), "__i long, chunk long", f"m_{kind} binary"])

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                row = part.slice(r, 1)
                n, chunk = row.column("__n")[0].as_py(), row.column("chunk")[0].as_py()
                head = ":".join([str(seed), kind, *(v for t in texts if (v := row.column(t)[0].as_py()) is not None)])
                reps = range(chunk * CHUNK, min(replicates, (chunk + 1) * CHUNK))
                # each cluster's index also names one draw of every replicate, so the draws are as many as the clusters
                m = np.zeros((n, len(reps)), np.int32)
                for at, rep in enumerate(reps):
                    text = f"{head}:{rep}:".encode()
                    m[:, at] = np.bincount([int.from_bytes(hashlib.md5(text + b"%d" % k).digest()[:4], "big") % n for k in range(n)], minlength=n)
                same = [pa.array([row.column(c)[0].as_py()] * n, row.schema.field(c).type) for c in by]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n)), pa.array(np.full(n, chunk)), pa.array([v.tobytes() for v in m], pa.binary())], names=[*by, "__i", "chunk", f"m_{kind}"])

    return one.mapInArrow(draw, schema).join(dim.select(*by, column, "__i"), [*by, "__i"]).drop("__i")


def _vector_sums(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sums of packed doubles, of the same length within a group; an even part of each group's rows at a time."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), *(f"{n} binary" for n in names)])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sums = {n: sum(np.frombuffer(v) for v in part[n]).tobytes() for n in names}
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in by}, **{n: [v] for n, v in sums.items()}})

    parts = df.withColumn("__part", F.pmod(F.xxhash64(*names[:1]), F.lit(32))).groupBy(*by, "__part").applyInPandas(run, schema)
    return parts.groupBy(*by).applyInPandas(run, schema)


def bootstrap_replicates(cells: DataFrame, day: str, block: str, seed: int, replicates: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, baseline, target): dates and blocks drawn with replacement independently; the mean over drawn dates of the date's error over drawn blocks.

    A replicate in which no drawn date has a drawn block is absent. Replicates are arrays: a cell meets a row for each thousand of them, a date's
    blocks are summed as vectors and so are the dates; only the result has a row a replicate.
    """
    by = list(by)
    d = _multiplicity(cells, by, day, "d", seed, replicates)
    b = _multiplicity(cells, by, block, "b", seed, replicates)
    sums = ("n", "baseline_sum", "target_sum")
    plain = cells.select(*by, day, block, *[F.col(c).cast("double").alias(c) for c in sums])
    j = plain.join(b, [*by, block]).join(d, [*by, "chunk", day])
    keys = [*by, "chunk"]
    kinds = ", ".join(f"`{c}` {j.schema[c].dataType.simpleString()}" for c in keys)

    def one_date(part: pd.DataFrame) -> pd.DataFrame:
        m_b = np.array([np.frombuffer(v, np.int32) for v in part["m_b"]], np.float64)
        n, base, target = (part[c].to_numpy() @ m_b for c in sums)
        m = np.where(n > 0, np.frombuffer(part["m_d"].iloc[0], np.int32), 0).astype(float)
        per = np.where(n > 0, n, 1.0)
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in keys}, "m": [m.tobytes()], "b": [(m * base / per).tobytes()], "t": [(m * target / per).tobytes()]})

    dates = j.groupBy(*keys, day).applyInPandas(one_date, f"{kinds}, m binary, b binary, t binary")
    totals = _vector_sums(dates, keys, ["m", "b", "t"])

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.to_dict("records"):
                m, b_sum, t_sum = (np.frombuffer(r[c]) for c in ("m", "b", "t"))
                used = np.flatnonzero(m > 0)
                yield pd.DataFrame({**{c: [r[c]] * len(used) for c in by}, "rep": used + r["chunk"] * CHUNK, "baseline": b_sum[used] / m[used], "target": t_sum[used] / m[used]})

    schema = ", ".join([*(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in by), "rep long, baseline double, target double"])
    return totals.mapInPandas(rows, schema)


def crossed_bootstrap(cells: DataFrame, day: str, block: str, seed: int, replicates: int, level: float = 0.95, by: Sequence[str] = (), least_relative: float = 0.1, keep: int | None = None) -> DataFrame:
    """One row (a group): replicates used and empty, percentile interval of the improvement and of the relative one, and their probabilities.

    With `keep`, replicates are drawn, twice as many each time, until `keep` are not empty, and the first `keep` count: the form for sparse cohorts.
    """
    by = list(by)
    reps = bootstrap_replicates(cells, day, block, seed, replicates, by)
    if keep is not None:
        # draws are named by their number, so more replicates are the same ones and then others
        while replicates < 64 * keep and (short := reps.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]) is not None and short < keep:
            replicates *= 2
            reps = bootstrap_replicates(cells, day, block, seed, replicates, by)
        reps = reps.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("rep"))).where(F.col("__r") <= keep)
    gain, tail = F.col("baseline") - F.col("target"), (1 - level) / 2
    reps = reps.withColumns({"gain": gain, "relative": gain / F.col("baseline")})
    q = lambda c, p: F.percentile(c, F.lit(p))
    return reps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("used"), (F.lit(replicates) - F.count(F.lit(1))).alias("empty"), q("gain", tail).alias("low"), q("gain", 1 - tail).alias("high"),
        q("relative", tail).alias("relative_low"), q("relative", 1 - tail).alias("relative_high"), F.avg((F.col("gain") > 0).cast("double")).alias("p_better"), F.avg((F.col("relative") > least_relative).cast("double")).alias("p_much_better"),
    )


def rook_edges(blocks: DataFrame, by: Sequence[str], x: str = "bx", y: str = "by_") -> DataFrame:
    """(by, x, y, x2, y2): each pair of blocks that share a side, once."""
    b = blocks.select(*by, x, y).distinct()
    other = b.select(*by, F.col(x).alias("x2"), F.col(y).alias("y2"))
    steps = b.select(*by, x, y, F.explode(F.array(F.struct((F.col(x) + 1).alias("x2"), F.col(y).alias("y2")), F.struct(F.col(x).alias("x2"), (F.col(y) + 1).alias("y2")))).alias("s")).select(*by, x, y, "s.*")
    return steps.join(other, [*by, "x2", "y2"])


def morans_i(blocks: DataFrame, by: Sequence[str], value: str, x: str = "bx", y: str = "by_", permutations: int = 0, seed: int = 0) -> DataFrame:
    """(by, n, edges, moran, expected, p): n / (2 E) x 2 sum z_i z_j / sum z^2 over rook edges; null without edges or spread.

    p is two-sided about -1 / (n - 1) with one added to both counts; each permutation deals the values out anew in the order of a hash.
    """
    by = list(by)
    w = Window.partitionBy(*by)
    z = blocks.select(*by, x, y, value).withColumns({"z": F.col(value) - F.avg(value).over(w), "slot": F.row_number().over(w.orderBy(x, y)) - 1})
    reps = z.sparkSession.range(permutations + 1).select((F.col("id")).alias("rep"))
    many = z.crossJoin(reps)
    key = F.when(F.col("rep") == 0, F.format_string("%012d", F.col("slot").cast("long"))).otherwise(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(x).cast("string"), F.col(y).cast("string"))))
    dealt = many.withColumn("to", F.row_number().over(Window.partitionBy(*by, "rep").orderBy(key, x, y)) - 1).select(*by, "rep", F.col("to").alias("slot"), "z")
    places = z.select(*by, "slot", x, y)
    edges = rook_edges(blocks, by, x, y).join(places, [*by, x, y]).select(*by, "x2", "y2", F.col("slot").alias("i")).join(places.select(*by, F.col(x).alias("x2"), F.col(y).alias("y2"), F.col("slot").alias("j")), [*by, "x2", "y2"]).select(*by, "i", "j")
    zi, zj = dealt.select(*by, "rep", F.col("slot").alias("i"), F.col("z").alias("zi")), dealt.select(*by, "rep", F.col("slot").alias("j"), F.col("z").alias("zj"))
    cross = edges.join(zi, [*by, "i"]).join(zj, [*by, "j", "rep"]).groupBy(*by, "rep").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("zi") * F.col("zj")).alias("cross"))
    spread = z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    value_of = F.when((F.col("zz") > 0) & (F.col("edges") > 0), F.col("n") / F.col("edges") * F.col("cross") / F.col("zz"))
    runs = (spread.join(cross, by, "left") if by else spread.crossJoin(cross)).withColumn("i_value", value_of).withColumn("expected", -1.0 / (F.col("n") - 1))
    own = runs.where("rep = 0 or rep is null").select(*by, "n", "edges", F.col("i_value").alias("moran"), "expected")
    if not permutations:
        return own.withColumn("p", F.lit(None).cast("double"))
    far = (runs.where("rep > 0").join(own.select(*by, "moran"), by) if by else runs.where("rep > 0").crossJoin(own.select("moran"))).groupBy(*by).agg(F.count_if(F.abs(F.col("i_value") - F.col("expected")) >= F.abs(F.col("moran") - F.col("expected")) - 1e-12).alias("far"), F.count(F.lit(1)).alias("runs"))
    out = own.join(far, by, "left") if by else own.crossJoin(far)
    return out.withColumn("p", (1.0 + F.col("far")) / (F.col("runs") + 1.0)).drop("far", "runs")


def gates(summary: DataFrame, rules: Sequence[tuple[str, str, str, float, bool]]) -> DataFrame:
    """(gate, observed, threshold, passed, required, all_passed) from a one-row summary; rules: (name, column, `>` or `<`, threshold, required). A null fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("observed"), F.lit(float(t)).alias("threshold"), F.coalesce((F.col(c) > t) if op == ">" else (F.col(c) < t), F.lit(False)).alias("passed"), F.lit(r).alias("required")) for n, c, op, t, r in rules])
    whole = F.forall("g", lambda x: x["passed"] | ~x["required"])
    return summary.select(rows.alias("g")).select(F.explode("g").alias("x"), whole.alias("all_passed")).select("x.*", "all_passed")
