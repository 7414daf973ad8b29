"""Spelling variants by finite-state composition: the vocabulary's minimised acceptor, a one-edit transducer, and the acceptor again.

Two words one edit apart share either the first half of the shorter one or, read from behind, its other half. So words are dealt out by that
half: it leads from the initial state to the state at which a cell of the composition begins, and the rest of the words of one cell is what
its acceptors read. The transducer copies symbols, makes one edit (another symbol, or one more on the right side) and copies again; a
composed state is a pair of states, and a pair of words is accepted where both states are final. All cells of a piece of a partition share one
minimised acceptor, and their composed states are worked through level by level. Arcs carry the number of words before them, which names the
words that a path accepts. A half that many words share is dealt out in blocks, each block against each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, mix, scratch_path, stage, stage_at

#: Runs of letters; A-Z are lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One in so many (document, run) pairs loses a code point.
ONE_IN = 97


def document_words(text: bytes | None, doc_id) -> Iterator[tuple[str, int]]:
    """(word, times) of one document: its runs, of which some have lost the code point that the pair's crc names."""
    if text is None:
        return
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), start)
        if h % ONE_IN == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, least_length: int, least_count: int, key: str, text: str) -> DataFrame:
    """(word, n): the distinct words of whole texts. Each task counts its own in a table of bounded size."""
    docs = docs.select(key, F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in document_words(t.as_py(), doc_id):
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > 300_000:
                    yield handed()
                    held = {}
        yield handed()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct strings of numbers under several initial symbols.

    start[i]: the state that the i-th initial symbol leads to. A state's arcs are sorted by symbol: lo:hi into symbol, to, and before, the
    number of words of the state that come earlier. A word's number within a state is the sum of `before` along its path.
    """

    def __init__(self, heads: np.ndarray, strings: list[np.ndarray]):
        size = np.array([len(s) for s in strings])
        rows, width = len(strings), int(size.max(initial=0)) + 1
        table = np.full((rows, width), -1, np.int64)
        table[:, 0] = heads
        table[np.repeat(np.arange(rows), size), np.concatenate([np.arange(1, n + 1) for n in size]).astype(int) if rows else []] = np.concatenate(strings) if rows else []
        # a row makes new states from the first column on in which it differs from the row before it
        differ = np.vstack([np.ones((1, width), bool), table[1:] != table[:-1]])
        fresh = (np.maximum.accumulate(differ, axis=1)) & (table >= 0)
        first, parent, symbol, mark, depth_of = [], [], [], [], []
        total, above = 0, None
        for k in range(width):
            r = np.flatnonzero(fresh[:, k])
            at = np.cumsum(fresh[:, k]) - 1 + total
            first.append(r)
            parent.append(above[r] if k else np.full(len(r), -1))
            symbol.append(table[r, k])
            mark.append(size[r] == k)
            depth_of.append((total, total + len(r)))
            total, above = total + len(r), at
        first, parent, symbol, final = (np.concatenate(c) for c in (first, parent, symbol, mark))
        # equal futures, equal states: a state is named by a hash of its future, from the ends back
        name = final.astype(np.uint64) + np.uint64(1)
        low, high = np.where(final, 0, np.iinfo(np.int64).max // 2), np.where(final, 0, -1)
        for lo, hi in reversed(depth_of[1:]):
            kid = np.arange(lo, hi)
            arc = mix(mix(name[kid]) + symbol[kid].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            np.add.at(name, parent[kid], arc)
            np.minimum.at(low, parent[kid], low[kid] + 1)
            np.maximum.at(high, parent[kid], high[kid] + 1)
        _, pick, state = np.unique(mix(name), return_index=True, return_inverse=True)
        self.final, self.low, self.high = final[pick], low[pick], high[pick]
        self.start, self.heads, self.first = state[: depth_of[0][1]], symbol[: depth_of[0][1]], first[: depth_of[0][1]]
        # arcs of one node for each state
        rank = np.full(len(name), -1)
        rank[pick] = np.arange(len(pick))
        kid = np.arange(depth_of[0][1], len(name))
        kid = kid[rank[parent[kid]] >= 0]
        source = rank[parent[kid]]
        order = np.lexsort((symbol[kid], source))
        kid, source = kid[order], source[order]
        self.symbol, self.to, self.before = symbol[kid], state[kid], first[kid] - first[parent[kid]]
        self.lo, self.hi = np.searchsorted(source, np.arange(len(pick))), np.searchsorted(source, np.arange(len(pick)), side="right")
        self.base = int(self.symbol.max(initial=0)) + 1
        self.index = source * self.base + self.symbol

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The arc of each state with each symbol, -1 where there is none."""
        want = state * self.base + symbol
        at = np.minimum(np.searchsorted(self.index, want), len(self.index) - 1)
        return np.where(self.index[at] == want, at, -1) if len(self.index) else np.full(len(want), -1)

    def arcs(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in state, arc) of every arc of every state."""
        n = self.hi[state] - self.lo[state]
        at = np.repeat(np.arange(len(state)), n)
        return at, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.lo[state], n)


def _common_words(a: Acceptor, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, number in p, number in q) of every word that both states of a pair accept: the transducer after its edit."""
    at, x, y, out = np.arange(len(p)), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), []
    while len(at):
        both = a.final[p] & a.final[q]
        out.append((at[both], x[both], y[both]))
        i, arc = a.arcs(p)
        other = a.follow(q[i], a.symbol[arc])
        i, arc, other = i[other >= 0], arc[other >= 0], other[other >= 0]
        at, x, y, p, q = at[i], x[i] + a.before[arc], y[i] + a.before[other], a.to[arc], a.to[other]
        ok = (a.low[p] <= a.high[q]) & (a.low[q] <= a.high[p])
        at, x, y, p, q = at[ok], x[ok], y[ok], p[ok], q[ok]
    return tuple(np.concatenate(c) if out else np.zeros(0, int) for c in (zip(*out, strict=True) if out else ([], [], [])))


def one_edit_pairs(a: Acceptor, left: np.ndarray, right: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, inserted): pairs of a left and a right word, the right one with another symbol or with one more.

    left, right: places in a.start of the two initial states of each cell. Each pair comes once: an edit is made where the words first differ.
    """
    p, q, x, y = a.start[left], a.start[right], a.first[left], a.first[right]
    found: list[tuple] = []
    while len(p):
        after, n = [], a.hi[p] - a.lo[p]
        work = np.cumsum(n * (a.hi[q] - a.lo[q]) + 1)
        for part in np.split(np.arange(len(p)), np.searchsorted(work, np.arange(most, work[-1], most))):
            pp, qq, px, py = p[part], q[part], x[part], y[part]
            # the left word ends and the right one has one more
            i, arc = a.arcs(qq)
            ends = a.final[pp[i]] & a.final[a.to[arc]]
            found.append((px[i[ends]], py[i[ends]] + a.before[arc[ends]], np.ones(ends.sum(), bool)))
            # every arc of the left state with every one of the right
            j, c = a.arcs(pp[i])
            d, i = arc[j], i[j]
            same = a.symbol[c] == a.symbol[d]
            after.append((a.to[c[same]], a.to[d[same]], px[i[same]] + a.before[c[same]], py[i[same]] + a.before[d[same]]))
            c, d, i = c[~same], d[~same], i[~same]
            u, v = a.to[c], a.to[d]
            bx, by = px[i] + a.before[c], py[i] + a.before[d]
            put = (a.low[u] <= a.high[v]) & (a.low[v] <= a.high[u])
            then = a.follow(v, a.symbol[c])
            more = then >= 0
            su, sv = np.concatenate([u[put], u[more]]), np.concatenate([v[put], a.to[then[more]]])
            sx, sy = np.concatenate([bx[put], bx[more]]), np.concatenate([by[put], by[more] + a.before[then[more]]])
            kind = np.repeat([False, True], [put.sum(), more.sum()])
            # composed states that come up again are worked through once
            states, back = np.unique(su * len(a.final) + sv, return_inverse=True)
            at, ox, oy = _common_words(a, states // len(a.final), states % len(a.final))
            order = np.argsort(at, kind="stable")
            at, ox, oy = at[order], ox[order], oy[order]
            lo, hi = np.searchsorted(at, back), np.searchsorted(at, back, side="right")
            n = hi - lo
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append((np.repeat(sx, n) + ox[pick], np.repeat(sy, n) + oy[pick], np.repeat(kind, n)))
        p, q, x, y = (np.concatenate(z) for z in zip(*after, strict=True))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def near_words(rows: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, form, form_n): what each word has of near words in these cells, and the commonest of them.

    rows: (behind, m, half, i, j, side, rest, word, n), sorted by all up to rest.
    """
    cell = rows.groupby(["behind", "m", "half", "i", "j"], sort=False).ngroup().to_numpy()
    a = Acceptor(cell * 2 + rows["side"].to_numpy(), [np.frombuffer(r.encode("utf-32-le"), np.uint32).astype(np.int64) for r in rows["rest"]])
    left, right = np.flatnonzero(a.heads % 2 == 0), np.flatnonzero(a.heads % 2 == 1)
    of, at, back = np.intersect1d(a.heads[left] // 2, a.heads[right] // 2, return_indices=True)
    u, v, more = one_edit_pairs(a, left[at], right[back])
    # pairs that share the first half too were found from the front
    words, m, behind, n = rows["word"].tolist(), rows["m"].to_numpy(), rows["behind"].to_numpy(), rows["n"].to_numpy()
    twice = np.flatnonzero(behind[u] == 1)
    if len(twice):
        front = pd.factorize(np.array([w[: k // 2] for w, k in zip(words, m.tolist(), strict=True)], object))[0]
        drop = np.zeros(len(u), bool)
        drop[twice] = front[u[twice]] == front[v[twice]]
        u, v, more = u[~drop], v[~drop], more[~drop]
    # with another symbol the pair comes again the other way round, with one more it does not
    u, v = np.concatenate([u, v[more]]), np.concatenate([v, u[more]])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[v], -n[v], u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.diff(u, prepend=-1))
    count = np.diff(np.append(first, len(u)))
    return pd.DataFrame({"word": [words[i] for i in u[first]], "n_near": count, "form": [words[i] for i in v[first]], "form_n": n[v[first]]})


_CELLS = ["behind", "m", "half", "i", "j", "side", "rest", "word", "n"]


def composed(words: DataFrame, block: int = 4000, piece: int = 20_000) -> DataFrame:
    """(word, n_near, form, form_n) of every word that is near another; words: (word, n), distinct."""
    size = F.length("word")
    # as the left word it has m code points; as the right one m, or one more
    roles = F.array(*[F.struct(F.lit(b).alias("behind"), (size - less).alias("m"), F.lit(side).alias("side")) for b in (0, 1) for less, side in ((0, 0), (0, 1), (1, 1))])
    rows = words.withColumn("as", F.explode(roles)).select("word", "n", "as.*")
    cut = F.expr("m div 2")
    turned, keep = F.reverse("word"), F.col("m") - cut
    rows = rows.withColumns({"half": F.when(F.col("behind") == 0, F.substring("word", F.lit(1), cut)).otherwise(F.substring(turned, F.lit(1), keep)), "rest": F.when(F.col("behind") == 0, F.substring("word", cut + 1, size)).otherwise(F.substring(turned, keep + 1, size))})
    cells = rows.groupBy("behind", "m", "half").agg(F.count_if(F.col("side") == 0).alias("lefts"), F.count_if(F.col("side") == 1).alias("rights"))
    cells = cells.where("lefts > 0 and rights > 1").select("behind", "m", "half", F.ceil(F.col("rights") / block).cast("int").alias("blocks"))
    rows = rows.join(cells, ["behind", "m", "half"])
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    rows = rows.withColumns({"i": F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))})
    dealt = rows.select(*_CELLS).repartition("behind", "m", "half", "i", "j").sortWithinPartitions(*_CELLS[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])

        def given(part: pd.DataFrame) -> pa.RecordBatch:
            found = near_words(part)
            return pa.RecordBatch.from_arrays([pa.array(found[f.name].tolist(), f.type) for f in kinds], schema=kinds)

        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch.to_pandas()], ignore_index=True) if len(held) else batch.to_pandas()
            if len(held) >= piece:  # all cells but the last are whole
                last = held[_CELLS[:5]].ne(held[_CELLS[:5]].shift()).any(axis=1).to_numpy().nonzero()[0][-1]
                if last:
                    yield given(held.iloc[:last])
                    held = held.iloc[last:].reset_index(drop=True)
        if len(held):
            yield given(held)

    return dealt.mapInArrow(run, "word string, n_near long, form string, form_n long")


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) of every word that has a form: pointers to forms are doubled until none moves. forms: (word, form); no word comes back to itself."""
    spark, path = forms.sparkSession, scratch_path(forms.sparkSession, "roots")
    links = stage_at(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), path)
    for _ in range(max_rounds):
        if links.where("moved").isEmpty():
            break
        before, path = path, scratch_path(spark, "roots")
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stage_at(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), path)
        discard(spark, before)
    else:
        raise RuntimeError("the chains of forms did not end")
    return links.select("word", "root")


def variant_groups(docs: DataFrame, least_length: int = 5, least_count: int = 3, times: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of least_length code points that occurs least_count times or more.

    form is the near word of largest n, ties the first in code-point order, where that n is `times` the word's n or more; else null, as
    is form_n. root follows forms to the last, and is the word itself without one. A null text has no words; a null key reads as empty in
    the crc; repeated rows count as often as they are there; texts and words of any length are taken whole; an empty table gives no rows.
    Other columns are not read.
    """
    if times < 2:
        raise ValueError("with less than twice the count chains of forms need not end")
    words = stage(vocabulary(docs, least_length, least_count, key, text), "vocabulary")
    best = F.min(F.struct((-F.col("form_n")).alias("down"), "form")).alias("best")
    near = composed(words).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.down") >= times * F.col("n"), F.col("best")).alias("best"))
    rows = stage(rows.select("word", "n", "n_near", "best.form", (-F.col("best.down")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its commoner spelling."""
    return variant_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
