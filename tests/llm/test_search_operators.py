"""Importance resampling, nearest neighbours and spelling variants against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, importance, neighbours, spelling

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# --- 11: importance resampling -------------------------------------------------------------------------------------


def plain_buckets(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5):
    """docs: (doc_id, text) rows; what op11's contract says, step by step."""
    held = [(i, *plain_buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in plain_buckets(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in s}
    rows = []
    for i, words, f in held:
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    places = {id(r): k + 1 for k, r in enumerate(drawn[: percent * len(drawn) // 100])}
    return sorted((*r[:4], places.get(id(r), 0)) for r in rows)


def rows_of(df):
    return sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"] or 0) for r in df.collect())


@tables
def test_op11_against_its_contract(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(catalog.queries()["op11_importance"](spark, SF)) == plain_resample(docs, target)


def test_grams_of_odd_texts():
    rng = random.Random(1)
    texts = [None, "", " .,;", "one", "One TWO", "É éİ ＡＢ  x", "\x00a\x00b", "x" * 5000 + " y " + "z" * 70, "".join(rng.choice("ab cé, D") for _ in range(3000))]
    was = importance.MOST
    try:
        for importance.MOST in (was, 7):
            for t, (n, got) in zip(texts, importance.gram_buckets([None if t is None else t.encode() for t in texts], 10_000), strict=True):
                words, want = plain_buckets(t)
                assert n == words and sorted(got.tolist()) == sorted(want) and importance.unpacked(importance.packed(got)).tolist() == sorted(want)
    finally:
        importance.MOST = was


def test_resampling_of_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    data = [(i, " ".join(word() for _ in range(rng.randrange(10, 60)))) for i in range(300)] + [(400, None), (401, ""), (402, "... --"), (403, "way " * 30_000)]
    data += [(7, data[7][1])] * 90  # repeated rows
    target = [data[3][1], None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, weight string, held int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(df, aim, percent=40)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and rows_of(out) == plain_resample(data, target, 40)
    nothing = rows_of(importance.resample(df.where("doc_id = 402"), aim.limit(0)))
    assert nothing[0][1:3] == (0, 0) and nothing[0][4] == 0
    assert importance.resample(df.limit(0), aim).count() == 0
    odd = importance.resample(df.where("doc_id < 30").unionByName(spark.createDataFrame([(None, "a b c", "x", 1)], df.schema)), aim)
    assert odd.where("doc_id is null").first()["n_features"] == 6


# --- 12: nearest neighbours ----------------------------------------------------------------------------------------


def plain_nearest(ids, x, every=100, k=10):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), d[j]) for j in order]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall_of(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in rows}) / max(1, len(rows)) for q, rows in want.items()])


@tables
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op12_recall_and_exact_distances(spark, sf):
    folder = SF.replace("sf0.001", sf)
    held = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = held.vec_id.to_numpy(), np.array(held.embedding.tolist(), np.float64)
    got, want = found_by(catalog.queries()["op12_neighbours"](spark, folder)), plain_nearest(ids, x)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values()) and recall_of(got, want) >= 0.9
    at = {int(i): x[k] for k, i in enumerate(ids)}
    for q, rows in got.items():
        assert rows == sorted(rows, key=lambda r: (r[1], r[0])) and q not in [v for v, _ in rows]
        assert all(abs(d - np.sqrt(((at[v] - at[q]) ** 2).sum())) < 1e-12 for v, d in rows)


def test_tree_leaves_and_order():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 6))
    tree = neighbours.fit_tree(x, leaf_rows=20)
    leaf = neighbours.leaf_of(tree, x)
    assert tree.leaves > 20 and set(leaf) <= set(range(tree.leaves))
    far = neighbours.squared(x[:3], tree.centres)
    for i in range(3):
        order = neighbours.best_bins(tree, far[i], tree.leaves)
        assert sorted(order) == list(range(tree.leaves)) and order[0] == leaf[i]
        assert neighbours.best_bins(tree, far[i], 1, np.full(tree.leaves, 4), 10) == order[:3]
    same = neighbours.fit_tree(np.ones((100, 3)), leaf_rows=5)
    assert same.leaves == 1 and neighbours.fit_tree(np.zeros((0, 3))).leaves == 1


def test_all_leaves_give_the_exact_answer_in_blocks_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(900, 4)).astype(float)  # many ties
    x[:300] = [1, 2, 1, 0]  # a third of the rows alike
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 4), (1003, [1.0, float("nan"), 0.0, 0.0]), (1004, [1.0, None, 0.0, 0.0]), (1005, [float("inf"), 1.0, 1.0, 1.0]), (1006, [1.0] * 3), (None, [1.0] * 4)]
    df = spark.createDataFrame([*rows, *[(i, v, "bad") for i, v in bad], *rows[50:150]], "vec_id long, embedding array<double>, score string")
    good = (x != 0).any(1)
    ids = np.arange(900)[good]
    got = found_by(neighbours.search(df, every=30, recall=1.0, leaf_rows=10, block=64, calibrate=1000))
    want = plain_nearest(ids, x[good], 30)
    assert got == want
    # fewer candidates than asked for, one row alone, none at all
    few = found_by(neighbours.search(df.where("vec_id in (0, 301, 303, 305)"), recall=0.5))
    assert {q: [v for v, _ in r] for q, r in few.items()} == {q: [v for v, _ in r] for q, r in plain_nearest(np.array([0, 301, 303, 305]), x[[0, 301, 303, 305]]).items()}
    assert neighbours.search(df.where("vec_id = 0")).count() == 0 and neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("score = 'bad'")).count() == 0


# --- 13: spelling --------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by = {}
    for w in n:
        for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))):
            by.setdefault(k, set()).add(w)
    near = {w: {v for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for v in by[k] if one_edit(w, v)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n[w], len(near[w]), n.get(form[w], 0)))
    return sorted(out)


def variants_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@tables
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_against_its_contract(spark, sf):
    folder = SF.replace("sf0.001", sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert variants_of(catalog.queries()["op13_spelling"](spark, folder)) == plain_variants(docs)


@pytest.mark.parametrize("block, piece", [(4000, 20_000), (5, 40)])
def test_variants_of_odd_rows(spark, block, piece):
    rng = random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 9))) for _ in range(250)] + ["h" * 5000, "h" * 4999 + "i"]
    chain = [("chains", 3), ("chainsa", 6), ("chainsab", 12), ("chainsabc", 24), ("chainsabcd", 48), ("chainsabcde", 96), ("chainsabcdef", 200)]
    data = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(120)] + [(500, None), (501, ""), (502, "12 !? ×÷ ÀÉ"), (503, "Ünïcode ünïcode ÜNÏCODE"), (504, f"{words[-1]} {words[-2]} " * 3)]
    data += [(600 + i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)] + [(9, "repeated repeatad repeated")] * 5
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in data], "doc_id long, text string, word string, n int")
    was, spelling.composed.__defaults__ = spelling.composed.__defaults__, (block, piece)
    try:
        out = spelling.variant_groups(df)
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and variants_of(out) == plain_variants(data)
        assert spelling.variant_groups(df.limit(0)).count() == 0 and spelling.variant_groups(df.where("doc_id = 502")).count() == 0
    finally:
        spelling.composed.__defaults__ = was
    lone = spelling.variant_groups(df.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    assert lone.count() == len(plain_variants([("", t) for i, t in data if i == 9]))
