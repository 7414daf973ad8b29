"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row then descends to its leaf. A query walks the tree best bin first: of all branches not yet
taken, the one whose centre is nearest comes next, by a priority queue. How many leaves a query visits is calibrated: for a sample of queries
the true neighbours are found over all rows, and the visits are widened until the leaves visited hold the wanted share of them. Leaves that stand
next to each other in the tree share a bin of bounded size, in which their rows meet the queries that visit any of them; every distance that is
returned is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import stage


@dataclass
class Tree:
    """centres: one row a node, the root first; children: its nodes' numbers, none for a leaf; leaf: a leaf's number, else -1."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """About the squared distances of all rows of a and b, by one matrix product."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), nan=np.inf)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means from seeds chosen by their distance to those before; empty clusters go."""
    seeds = [x[rng.integers(len(x))]]
    far = squared(x, seeds[0][None, :])[:, 0]
    while len(seeds) < k and far.max() > 1e-12 and np.isfinite(far.sum()):
        far = np.maximum(far, 0)
        seeds.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, squared(x, seeds[-1][None, :])[:, 0])
    centres = np.array(seeds)
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        used = np.unique(own)
        centres = np.array([x[own == c].mean(0) for c in used])
    return centres, squared(x, centres).argmin(1)


def fit_tree(x: np.ndarray, branching: int = 16, leaf_rows: int = 24, rounds: int = 6, seed: int = 0) -> Tree:
    """k-means in k-means, until a node holds leaf_rows of the sample or no two points apart."""
    rng = np.random.default_rng(seed)
    centres, children, leaf, leaves = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [np.zeros(0, int)], [-1], 0
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        found, own = _means(x[rows], branching, rounds, rng) if len(rows) > leaf_rows else (None, None)
        parts = [] if found is None else [c for c in range(len(found)) if (own == c).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        children[node] = np.arange(len(centres), len(centres) + len(parts))
        for c in parts:
            todo.append((len(centres), rows[own == c]))
            centres.append(found[c])
            children.append(np.zeros(0, int))
            leaf.append(-1)
    return Tree(np.array(centres), children, np.array(leaf))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row reaches by its nearest child at every node."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
        elif len(rows):
            own = squared(x[rows], tree.centres[tree.children[node]]).argmin(1)
            todo += [(int(c), rows[own == i]) for i, c in enumerate(tree.children[node])]
    return out


def best_bins(tree: Tree, far: np.ndarray, visits: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
    """Leaves in the order in which one query visits them: `visits` of them, and more until they hold `rows` rows. far: its distance to every node."""
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or held < rows):
        node = heapq.heappop(queue)[1]
        while tree.leaf[node] < 0:  # down to the nearest leaf; what is passed waits in the queue
            kids = tree.children[node]
            near = int(far[kids].argmin())
            for i, c in enumerate(kids.tolist()):
                if i != near:
                    heapq.heappush(queue, (float(far[c]), c))
            node = int(kids[near])
        out.append(int(tree.leaf[node]))
        held += int(sizes[out[-1]]) if sizes is not None else 0
    return out


def _one_nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, distance) of the k nearest rows, by all distances."""
    with np.errstate(over="ignore"):
        exact = np.sqrt(((x - query) ** 2).sum(1))
    order = np.lexsort((ids, exact))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]  # each id's nearest row
    return ids[order], exact[order]


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, id, distance) of each query's k nearest rows with another id, ties to the smaller id; of rows with one id the nearest counts.

    A matrix product narrows the rows down by more than its error; distances are then taken from differences. open_: which rows each query may take.
    """
    out = ([], [], [])
    for lo in range(0, len(queries), 256):
        part = queries[lo : lo + 256]
        allowed = ids[None, :] != query_ids[lo : lo + 256, None]
        if open_ is not None:
            allowed &= open_[lo : lo + 256]
        about = squared(part, x)
        slack = ((part * part).sum(1)[:, None] + (x * x).sum(1)[None, :]) * (4.0 * (x.shape[1] + 8) * np.finfo(float).eps)
        plain = np.isfinite(about).all(1) & np.isfinite(slack).all(1)
        bound = np.full(len(part), np.inf)
        if len(ids) > k:
            bound = np.partition(np.where(allowed, about + slack, np.inf), k - 1, axis=1)[:, k - 1]
        at, row = np.nonzero(allowed & (about - slack <= bound[:, None]))
        exact = np.sqrt(((x[row] - part[at]) ** 2).sum(1))
        order = np.lexsort((exact, ids[row], at))
        at, row, exact = at[order], row[order], exact[order]
        fresh = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(ids[row]) != 0)])[: len(at)]  # each id's nearest row
        at, row, exact = at[fresh], row[fresh], exact[fresh]
        order = np.lexsort((ids[row], exact, at))
        at, row, exact = at[order], row[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        # where rows repeat an id, or numbers are too large for the product, all distances are taken
        full = plain & (np.bincount(at, minlength=len(part)) >= np.minimum(k, allowed.sum(1)))
        keep = (place < k) & full[at]
        out[0].append(at[keep] + lo)
        out[1].append(ids[row[keep]])
        out[2].append(exact[keep])
        for i in np.flatnonzero(~full):
            found, d = _one_nearest(part[i], x[allowed[i]], ids[allowed[i]], k)
            out[0].append(np.full(len(found), lo + i))
            out[1].append(found)
            out[2].append(d)
    return tuple(np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(out, (int, np.int64, float), strict=True))


def share_bins(sizes: np.ndarray, block: int) -> np.ndarray:
    """The bin of each leaf: leaves in their order, about `block` rows together."""
    before = np.cumsum(sizes) - sizes
    return np.unique(before // block, return_inverse=True)[1]


def _vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors): of length size, not zero, all components there and finite."""
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    x = pc.cast(column.take(pa.array(right)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return right[good], x[good]


def usable_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, vec as packed doubles, and the vectors' length: that of most vectors, the shorter at a tie."""
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null and size(v) > 0")
    first = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = first["n"] if first else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _vectors(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, "id long, vec binary"), size


def matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, size)


def sampled(vectors: DataFrame, rows: int) -> pd.DataFrame:
    """The rows of least hash, which is a sample of fixed size."""
    return vectors.orderBy(F.xxhash64("id"), "id", "vec").limit(rows).toPandas()


def true_neighbours(rows: DataFrame, queries: pd.DataFrame, size: int, k: int) -> pd.DataFrame:
    """(query row, id, leaf, d) of the k nearest of all rows for a bounded number of queries; each task hands on its own k nearest."""
    q, q_ids = matrix(queries["vec"], size), queries["id"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = pd.DataFrame({"q": [], "id": [], "leaf": [], "d": []}).astype({"q": "int64", "id": "int64", "leaf": "int64", "d": "float64"})
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at, found, d = nearest(q, q_ids, matrix(batch.column(2).to_pylist(), size), ids, k)
            leaf = pd.Series(batch.column(1).to_numpy(), index=ids)
            leaf = leaf[~leaf.index.duplicated()]
            best = pd.concat([best, pd.DataFrame({"q": at, "id": found, "leaf": leaf.loc[found].to_numpy(), "d": d})])
            best = best.sort_values(["q", "d", "id"]).drop_duplicates(["q", "id"]).groupby("q").head(k)
        yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    part = rows.select("id", "leaf", "vec").mapInArrow(run, "q long, id long, leaf long, d double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return part.withColumn("place", place).where(F.col("place") <= k).toPandas()


def calibrated_visits(tree: Tree, queries: np.ndarray, truth: pd.DataFrame, recall: float) -> int:
    """The fewest leaves to visit so that the sampled queries' visits hold the wanted share of their true neighbours."""
    if not len(truth):
        return tree.leaves
    far = squared(queries, tree.centres)
    places = {q: {leaf: i for i, leaf in enumerate(best_bins(tree, far[q], tree.leaves))} for q in truth["q"].unique()}
    needed = np.sort([places[q][leaf] + 1 for q, leaf in zip(truth["q"], truth["leaf"], strict=True)])
    return int(needed[min(len(needed), int(np.ceil(recall * len(needed)))) - 1])


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, recall: float = 0.95, sample_rows: int = 32_768, sample_bytes: int = 32 << 20, leaf_rows: int = 48, calibrate: int = 100, block: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for every row whose id `every` divides, nearest first, ties to the smaller id.

    All rows are indexed. The tree is fitted on at most sample_rows rows of at most sample_bytes, those of least hash, with about leaf_rows
    of them a leaf; `calibrate` queries say how many leaves all visit. A query goes on until its leaves hold k other rows, or all leaves.
    Rows with a null id, and vectors that are null, empty, zero, of another length than most, or hold null or non-finite components, take no part.
    Repeated ids: one query (its least vector), and one neighbour (the nearest); a row with the query's own id is never its neighbour. Vectors
    that are equal are neighbours at distance 0. Other columns are not read. Without queries or candidates there are no rows.
    """
    vectors, size = usable_vectors(rows, key, vector)
    tree = fit_tree(matrix(sampled(vectors, max(1, min(sample_rows, sample_bytes // (8 * size))))["vec"], size), leaf_rows=leaf_rows)
    sent = rows.sparkSession.sparkContext.broadcast(tree)  # no more nodes than twice the sample's rows

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf_of(sent.value, matrix(batch.column(1).to_pylist(), size))), batch.column(1)], names=["id", "leaf", "vec"])

    indexed = stage(vectors.mapInArrow(index, "id long, leaf long, vec binary"), "indexed")
    queries = indexed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    probe = sampled(queries, calibrate)
    visits = calibrated_visits(tree, matrix(probe["vec"], size), true_neighbours(indexed, probe, size, k), recall)
    sizes, rows_of = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").agg(F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        sizes[r["leaf"]], rows_of[r["leaf"]] = r["n"], r["rows"]
    bin_of = share_bins(rows_of, block)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and bin, with the leaves that the query visits there."""
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            far = squared(matrix(batch.column(1).to_pylist(), size), sent.value.centres)
            at, bins, leaves = [], [], []
            for i, f in enumerate(far):
                visited = np.sort(best_bins(sent.value, f, visits, sizes, k + 1))
                own, first = np.unique(bin_of[visited], return_index=True)
                at += [i] * len(own)
                bins += own.tolist()
                leaves += [v.tobytes() for v in np.split(visited, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(bins, pa.int64()), pa.array(leaves, pa.binary()), batch.column(1).take(pa.array(at, pa.int64()))], names=["id", "bin", "leaves", "vec"])

    spark = rows.sparkSession
    bins = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bin_of)], "leaf long, bin long")  # one row a leaf
    asked = stage(queries.repartition("id").mapInArrow(walk, "id long, bin long, leaves binary, vec binary"), "asked")
    # a bin's rows and its queries are dealt out in blocks; every block of rows meets every block of queries
    per_bin = np.bincount(bin_of, weights=rows_of).astype(int)
    counts = {r["bin"]: r["n"] for r in asked.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = spark.createDataFrame([(b, max(1, -(-int(n) // (2 * block))), max(1, -(-counts.get(b, 0) // 1024))) for b, n in enumerate(per_bin)], "bin long, row_blocks long, query_blocks long")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(F.broadcast(deal), "bin").select("bin", all_of("row_blocks").alias("r"), part("query_blocks").alias("q"), "id", "leaves", "vec")
    right = indexed.join(F.broadcast(bins.join(deal, "bin")), "leaf").select("bin", part("row_blocks").alias("r"), all_of("query_blocks").alias("q"), "id", "leaf", "vec")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, leaf = a["id"].to_numpy(), b["leaf"].to_numpy()
        open_ = np.array([np.isin(leaf, np.frombuffer(v, np.int64)) for v in a["leaves"]])
        at, found, d = nearest(matrix(a["vec"], size), ids, matrix(b["vec"], size), b["id"].to_numpy(), k, open_)
        return pd.DataFrame({"query_id": ids[at], "vec_id": found, "score": d})

    cell = ["bin", "r", "q"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, "query_id long, vec_id long, score double")
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest of all embeddings to every hundredth."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
