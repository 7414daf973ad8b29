"""N-gram Jaccard join as a blocked sparse matrix product of document by n-gram incidence.

Which pairs can link at all follows from sizes. With threshold t, a set of n n-grams must share T = ceil(t n) with a partner, so with
p = n - T + 1 the first k n-grams that two linked sets have in common, in any fixed order (here: by hash), lie within the first p + k - 1
of each. A set's region is its first 2 p n-grams, which makes k = p + 1 (or T where the region is the whole set).

Only n-grams in two regions or more count. A set with fewer of them than the least k that a partner of its size can ask for links with
nothing. An n-gram in up to `few` regions ties its sets in pairs, whose counts accumulate; a pair is discarded when its count and the
commoner n-grams both hold can't reach k. Two sets that could reach k by commoner n-grams alone are tied by any of those. What is tied
forms clusters, outside which no link exists. The order and the counts are over all documents, and no pair that could link is left out.

Inside a cluster, sets are cut into blocks by size. A pair of blocks whose sizes are close enough is one task: overlap counts accumulate
over blocks of columns, pairs that can no longer reach the bound are discarded, and a spanning forest of the links found comes out, so a
group of a thousand near copies gives a thousand rows and not a million. What is linked already is not compared again: first each block is
multiplied with itself; then one set of each component so far, its representative, with all others; last, the other sets of a component with
those of other components only. So near copies of one document, however many, meet in a number of tasks that grows as they do.
Components of the links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BASE, components, discard, mix, scratch_path, stage, stage_at

_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Distinct word shingles of whole texts as sorted 64-bit hashes. Words are runs of other bytes than blank and tab to carriage return; A-Z is lower-cased."""

    def __init__(self, width: int = 4, most: int = 1 << 20):
        self.width, self.most = width, most
        self.up, self.down = _powers(BASE, 0), _powers(_INVERSE, 0)

    def sets(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """One array a text, in order; texts are worked through in runs of about `most` bytes."""
        held, size = [], 0
        for t in texts:
            held.append(t or b"")
            size += len(held[-1]) + 1
            if size >= self.most:
                yield from self._run(held, size)
                held, size = [], 0
        if held:
            yield from self._run(held, size)

    def _run(self, texts: list[bytes], size: int) -> Iterator[np.ndarray]:
        if len(self.up) <= size:
            self.up, self.down = _powers(BASE, size), _powers(_INVERSE, size)
        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], dtype=np.uint64)])
        word = mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))
        at = np.searchsorted(start, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        k = self.width
        if len(word) >= k:
            gram = word[: len(word) - k + 1].copy()
            for i in range(1, k):
                gram = gram * BASE + word[i : len(word) - k + 1 + i]
            gram = mix(gram)
        for i in range(len(texts)):
            n = at[i + 1] - at[i]
            if n >= k:
                yield np.unique(gram[at[i] : at[i + 1] - k + 1])
            elif n:
                h = np.uint64(n)
                for w in word[at[i] : at[i + 1]]:
                    h = np.uint64((int(h) * int(BASE) + int(w)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([h]) ^ np.uint64(0x5DEECE66D))
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n, percent: int):
    """n - ceil(percent/100 n) + 1."""
    return n - (percent * n + 99) // 100 + 1


def region_length(n, percent: int):
    """2 p, at most n."""
    return min(n, 2 * prefix_length(n, percent))


def text_sets(docs: DataFrame, width: int, percent: int, text: str = "text", ids: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Per row: the id columns, n (set size), d (fingerprint of the set) and grams: all its hashes packed, or its region's (null where the task has given that set before)."""
    ids = ids if ids is not None else ["doc_id"]
    docs = docs.select(*ids, F.col(text).cast("binary").alias("__t"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids), "n long", "d long", "grams binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        seen: set[int] = set()  # sets whose region this task has given already; bounded
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            n, d, grams = [], [], []
            for s in shingler.sets(batch.column(len(ids)).to_pylist()):
                n.append(len(s))
                d.append(int(mix(np.array([mix(s * BASE).sum(dtype=np.uint64) + np.uint64(len(s))])).astype(np.int64)[0]))
                if whole:
                    grams.append(s.tobytes())
                    continue
                grams.append(None if d[-1] in seen else s[: region_length(len(s), percent)].tobytes())
                if len(seen) < 200_000:
                    seen.add(d[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(grams, pa.binary())], names=[*ids, "n", "d", "grams"])

    return docs.mapInArrow(run, schema)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n, grams) to one row an n-gram, some thousand sets at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            d, n, grams = (batch.column(c).slice(i, 2000) for c in range(3))
            grams = grams.to_pylist()
            size = np.array([len(g) // 8 for g in grams])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(grams), np.int64)), pa.array(np.repeat(d.to_numpy(), size)), pa.array(np.repeat(n.to_numpy(), size).astype(np.int32))], names=["gram", "d", "n"])


def _least_k(n, percent: int):
    """The least k that a partner of a set of n n-grams can ask for: that of a partner with ceil(t n)."""
    size = F.floor((percent * n + 99) / 100)
    p = size - F.floor((percent * size + 99) / 100) + 1
    return F.least(size, 2 * p) - p + 1


#: Sampled sets that must hold an n-gram before it may count as hot.
HOT_LEAST = 50


def hot_grams(sets: DataFrame, few: int, share: float = 0.001, one_in: int = 16) -> list[int]:
    """N-grams in more than about `share` of all regions, by the sets of one in `one_in` fingerprints: there are at most (mean region) / share of them.

    All are in more than `few` regions for certain. They only say how the work is dealt out; what is missing here is counted like any other.
    """
    part = sets.where("n > 0 and grams is not null").where(F.pmod(F.xxhash64("d"), F.lit(one_in)) == 0).select("d", "n", "grams").dropDuplicates(["d"])
    least = max(few, int(share * part.count()))
    counts = part.mapInArrow(_entries, "gram long, d long, n int").groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > max(least, HOT_LEAST))
    return sorted(r["gram"] for r in counts.select("gram").collect())


def candidate_clusters(sets: DataFrame, percent: int, few: int) -> DataFrame:
    """(d, cluster) of every set that may link to a different one."""
    hot = np.array(hot_grams(sets, few), np.int64)
    sent = sets.sparkSession.sparkContext.broadcast(hot)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _entries(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.isin(batch.column(0).to_numpy(), sent.value))], names=["gram", "d", "n", "hot"])

    entries = sets.where("n > 0 and grams is not null").select("d", "n", "grams").mapInArrow(flagged, "gram long, d long, n int, hot boolean")
    # the same set may come from several tasks: it counts once
    by_gram = Window.partitionBy("gram").orderBy("d")
    ranked = entries.where("not hot").withColumns({"again": F.row_number().over(Window.partitionBy("gram", "d").orderBy("n")), "rank": F.dense_rank().over(by_gram)})
    hits = ranked.withColumn("df", F.max("rank").over(Window.partitionBy("gram"))).where("df > 1 and again = 1").select("gram", "d", "n", (F.col("df") > few).alias("common"), "hot")
    if len(hot):
        # a hot n-gram is common, and its sets are dealt out by themselves
        hits = hits.union(entries.where("hot").select("gram", "d", "n", F.lit(True).alias("common"), "hot").dropDuplicates(["gram", "d"]))
    hits_path = scratch_path(sets.sparkSession, "hits")
    hits = stage_at(hits, hits_path)
    stats = hits.groupBy("d").agg(F.count(F.lit(1)).alias("held"), F.count_if("common").alias("common_n"), F.first("n").alias("n"))
    stats = stage(stats.withColumn("k", _least_k(F.col("n"), percent)).where("held >= k").select("d", "common_n", "k", "n"), "stats")
    kept = hits.join(stats.select("d", (F.col("common_n") >= F.col("k")).alias("burdened")), "d")

    columns = kept.where("not common").groupBy("gram").agg(F.sort_array(F.collect_list("d")).alias("ds")).where(F.size("ds") > 1)
    pairs = columns.select(F.explode(F.flatten(F.transform("ds", lambda a, i: F.transform(F.slice("ds", i + 2, F.size("ds")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("shared"))
    side = lambda c: stats.select(F.col("d").alias(c), F.col("common_n").alias(f"common_{c}"), F.col("k").alias(f"k_{c}"), F.col("n").alias(f"n_{c}"))
    # few pairs share more than one or two n-grams: drop those that no bound could keep before the bounds are looked up
    pairs = pairs.join(side("a"), "a").where("shared >= k_a - common_a").join(side("b"), "b")
    pairs = pairs.where("shared >= greatest(k_a, k_b) - least(common_a, common_b)").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")

    heavy = kept.where("common and burdened").select("gram", "d", "hot")
    least = heavy.groupBy("gram", "hot").agg(F.min("d").alias("a"), F.max("d").alias("last")).where("a < last").select("gram", "a", "hot")
    edges = pairs.union(heavy.where("not hot").join(least.where("not hot").select("gram", "a"), "gram").select("a", F.col("d").alias("b")))
    if len(hot):  # there are few hot n-grams, by their bound
        edges = edges.union(heavy.where("hot").join(F.broadcast(least.where("hot").select("gram", "a")), "gram").select("a", F.col("d").alias("b")))
    found = components(edges).select(F.col("v").alias("d"), F.col("component").alias("cluster"))
    discard(sets.sparkSession, hits_path)
    return found


def overlap_links(left: list[np.ndarray], right: list[np.ndarray], percent: int, same: bool, columns: int = 4096) -> np.ndarray:
    """Index pairs (i, j) with percent * union <= 100 * intersection; overlap counts accumulate over blocks of columns.

    A pair is dropped from the bound once its count and what is left of the smaller side can't reach the least overlap its sizes ask for.
    """
    a, b = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    # 100 o >= percent (a + b - o)
    need = -(-percent * (a[:, None] + b[None, :]) // (100 + percent))
    live = np.minimum(a[:, None], b[None, :]) >= need
    if same:
        live = np.triu(live, 1)
    count = np.zeros(live.shape, np.float32)
    if live.any():
        column, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        inverse = inverse.astype(np.int32)
        row = np.concatenate([np.repeat(np.arange(len(left), dtype=np.int32), a), np.repeat(np.arange(len(right), dtype=np.int32), b)])
        side = np.concatenate([np.zeros(a.sum(), bool), np.ones(b.sum(), bool)])
        # only columns that both sides have count
        used = np.zeros(len(column), np.int8)
        used[inverse[~side]] = 1
        used[np.unique(inverse[side])] += 1
        new = np.cumsum(used == 2) - 1
        keep = used[inverse] == 2
        row, side, inverse = row[keep], side[keep], new[inverse[keep]]
        order = np.argsort(inverse, kind="stable")
        row, side, inverse = row[order], side[order], inverse[order]
        rest_a, rest_b = np.bincount(row[~side], minlength=len(left)), np.bincount(row[side], minlength=len(right))
        width = int(inverse[-1]) + 1 if len(inverse) else 0
        for c in range(0, width, columns):
            live &= count + np.minimum(rest_a[:, None], rest_b[None, :]) >= need
            if not live.any():
                break
            lo, hi = np.searchsorted(inverse, [c, c + columns])
            x, y = np.zeros((len(left), columns), np.float32), np.zeros((len(right), columns), np.float32)
            r, s, i = row[lo:hi], side[lo:hi], inverse[lo:hi] - c
            x[r[~s], i[~s]] = 1
            y[r[s], i[s]] = 1
            count += x @ y.T
            rest_a = rest_a - np.bincount(r[~s], minlength=len(left))
            rest_b = rest_b - np.bincount(r[s], minlength=len(right))
    return np.argwhere(live & (count >= need))


def size_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Add `block`: sets of a cluster in the order of their sizes, about `block` at a time; a size that many sets have is dealt out by hash. rows: (d, cluster, n, ...)."""
    counts = rows.groupBy("cluster", "n").agg(F.count(F.lit(1)).alias("__c"))
    smaller = F.sum("__c").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("__before", F.coalesce(smaller, F.lit(0)))
    sub = F.pmod(F.xxhash64("d"), F.ceil(F.col("__c") / block))
    return rows.join(counts, ["cluster", "n"]).withColumn("block", F.floor(F.col("__before") / block) * (1 << 20) + sub).drop("__c", "__before")


def block_pairs(left: DataFrame, right: DataFrame | None, percent: int) -> DataFrame:
    """(d, cluster, i, j, side): every task that a set takes part in. Without right, left's blocks meet each other and themselves.

    left, right: (d, cluster, n, block, component). Blocks whose sizes are too far apart do not meet, nor do two that hold one component.
    """
    sizes = lambda rows: rows.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    a = sizes(left)
    b = a if right is None else sizes(right)
    i, j = a.alias("i"), b.alias("j")
    near = (100 * F.col("i.high") >= percent * F.col("j.low")) & (100 * F.col("j.high") >= percent * F.col("i.low"))
    apart = (F.col("i.c0") != F.col("i.c1")) | (F.col("j.c0") != F.col("j.c1")) | (F.col("i.c0") != F.col("j.c0"))
    meet = (F.col("i.cluster") == F.col("j.cluster")) & near & apart
    pairs = i.join(j, meet & (F.col("i.block") <= F.col("j.block")) if right is None else meet).select(F.col("i.cluster").alias("cluster"), F.col("i.block").alias("i"), F.col("j.block").alias("j"))
    first = left.join(pairs.withColumn("block", F.col("i")), ["cluster", "block"]).select("d", "cluster", "i", "j", F.lit(0).alias("side"))
    other = pairs.withColumn("block", F.col("j"))
    second = (left.join(other.where("i <> j"), ["cluster", "block"]) if right is None else right.join(other, ["cluster", "block"])).select("d", "cluster", "i", "j", F.lit(1).alias("side"))
    return first.union(second)


def block_links(tasks: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), thinned to a spanning forest for each task. tasks: (d, cluster, i, j, side); members: (d, grams)."""

    def product(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["side"] == s].drop_duplicates("d").sort_values("d") for s in (0, 1)]
        same = not len(sides[1])
        grams = [[np.frombuffer(g, np.uint64) for g in s["grams"]] for s in sides]
        left, right = sides[0]["d"].to_numpy(), (sides[0] if same else sides[1])["d"].to_numpy()
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := parent.setdefault(v, v)) != v:
                parent[v] = parent[p]
                v = p
            return v

        for x, y in overlap_links(grams[0], grams[0] if same else grams[1], percent, same):
            a, b = root(int(left[x])), root(int(right[y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
        out = [(root(v), v) for v in list(parent) if root(v) != v]
        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")

    return tasks.join(members, "d").groupBy("cluster", "i", "j").applyInPandas(product, "a long, b long")


def cluster_components(clusters: DataFrame, members: DataFrame, percent: int, block: int) -> DataFrame:
    """(d, component): the components of all links inside clusters. clusters: (d, cluster, n); members: (d, grams)."""
    placed = stage(size_blocks(clusters, block), "blocks")
    own = placed.select("d", "cluster", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))
    # a set is in one block alone, so the forests that come out are stars with the components' least sets in the middle
    stars = block_links(own, members, percent).select(F.col("b").alias("d"), F.col("a").alias("component"))
    found = stage(placed.join(stars, "d", "left").withColumn("component", F.coalesce("component", "d")), "found")
    # a cluster of one block is done
    large = found.groupBy("cluster").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a < b").select("cluster")
    rest = stage(found.join(large, "cluster").drop("block"), "large")
    if rest.isEmpty():
        return found.select("d", "component")

    def merged(rows: DataFrame, links: DataFrame) -> DataFrame:
        """Components after links between them."""
        return rows.join(components(links, thin=False).select(F.col("v").alias("component"), F.col("component").alias("__to")), "component", "left").withColumn("component", F.coalesce("__to", "component")).drop("__to")

    first = rest.where("d = component")
    links = block_links(block_pairs(size_blocks(first, block), None, percent), members, percent)
    rest = stage(merged(rest.withColumn("__other", F.col("d") != F.col("component")), links), "large")
    # sets that were represented, against what is in other components still
    counts = rest.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("__c"), F.count_if("__other").alias("__o"))
    several = counts.groupBy("cluster").agg(F.count(F.lit(1)).alias("parts"), F.sum("__o").alias("others")).where("parts > 1 and others > 0").select("cluster")
    open_ = stage(rest.join(several, "cluster").join(counts, ["cluster", "component"]), "open")
    if not open_.isEmpty():
        # those of large components in blocks of their own, which do not meet each other
        others, plain = open_.where("__other"), ("d", "cluster", "n", "component", "block")
        own = F.xxhash64("component", F.pmod(F.xxhash64("d"), F.ceil(F.col("__o") / block)))
        others = others.where(F.col("__o") >= block).withColumn("block", own).select(*plain).union(size_blocks(others.where(F.col("__o") < block).drop("__c", "__o"), block).select(*plain))
        named = size_blocks(open_.where("not __other").drop("__c", "__o"), block).withColumn("block", -1 - F.col("block")).select(*plain)
        tasks = block_pairs(others, None, percent).union(block_pairs(others, named, percent))
        links = block_links(tasks, members, percent)
        of = open_.select(F.col("d").alias("a"), F.col("component").alias("ca"))
        links = links.join(of, "a").join(of.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        rest = merged(rest, links)
    final = rest.select("d", F.col("component").alias("__to"))
    return found.join(final, "d", "left").select("d", F.coalesce("__to", "component").alias("component"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, few: int = 8, block: int = 128, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_shingles and component_id, the least key that links of percent/100 Jaccard or more reach.

    A null, empty or blank text has an empty set, links with nothing and is its own component. Fewer words than `width` make one shingle.
    Equal sets, rows with the same text among them, are one vertex. A null key takes part in links; a component of null keys alone has a null id.
    A text of any length is one set, whole. Columns other than key and text are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sets_path, members_path = scratch_path(spark, "sets"), scratch_path(spark, "members")
    sets = stage_at(text_sets(docs, width, percent, text, [key]), sets_path)
    sizes = stage(sets.select(key, "n", "d"), "sizes")
    first = sizes.where("n > 0").groupBy("d").agg(F.min(key).alias("first"), F.first("n").alias("n"))
    clusters = stage(candidate_clusters(sets, percent, few).join(first, "d"), "clusters")
    discard(spark, sets_path)
    # one row's text of each clustered set is shingled again, which moves less than keeping all sets whole; the sets grow with the documents, so
    # they are joined in the way that any size takes
    chosen = clusters.select(F.col("d").alias("__d"), F.col("first").alias("__first")).hint("merge")
    again = docs.select(key, text).join(chosen, F.col(key).eqNullSafe(F.col("__first"))).select("__d", text)
    members = stage_at(text_sets(again, width, percent, text, ["__d"], whole=True).where("d = __d").select("d", "grams").dropDuplicates(["d"]), members_path)
    found = cluster_components(clusters.select("d", "cluster", "n"), members, percent, block)
    discard(spark, members_path)
    vertex = first.drop("n").join(found, "d", "left").withColumn("root", F.coalesce("component", "d")).select("d", "root", "first")
    least = vertex.groupBy("root").agg(F.min("first").alias("component_id"))
    named = vertex.join(least, "root").select("d", "component_id")
    full = sizes.where("n > 0").join(named, "d").select(key, F.col("n").alias("n_shingles"), "component_id")
    return full.union(sizes.where("n = 0").select(key, "n", F.col(key).alias("component_id")))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Size of every document's set, and the least doc_id of its component; edge cases as jaccard_components() states them."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
