"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs inside it.

Features are hashed character n-grams (1 to 4 code points of the lower-cased text, runs of non-letters read as one space), as shares of
all n-grams of the text. A linear decision is then the mean weight over a text's n-grams, so a whole batch of texts is scored with
a few array passes and no text is ever cut.

The decisions only say which learned language is nearest. A text of which too few 3-grams occur in that language's training texts is not
claimed by it; how few is set for each language on its training texts, one half against the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import BASE, mix

#: Languages of one family are hard to tell apart; a language not listed here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sr"),
}
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """One linear decision for each pair of families and each pair of languages within a family."""

    languages: list[str]
    family_of: list[int]  # of each language
    pairs: list[tuple[int, int, int]]  # (family or -1, a, b): a wins where the decision is positive
    weights: np.ndarray  # n-gram ids x decisions
    bias: np.ndarray
    bits: int
    known: np.ndarray  # of each language, the 3-grams of its training texts, as bits
    least: np.ndarray  # of each language, the share of known 3-grams below which a text is not claimed


#: Bits of the hashes of known 3-grams.
KNOWN_BITS = 18


def hashed_grams(text: str, high: int = 4) -> list[np.ndarray]:
    """Hashes of all n-grams of one text, the text set between spaces, for n from 1 to `high`."""
    clean = OTHER.sub(" ", f" {text.lower()} ")
    c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, min(high, len(c)) + 1):
        h = (h[: len(c) - n + 1] * BASE) + c[n - 1 :]
        out.append(mix(h + np.uint64(n)))
    return out


def cut_hash(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int32)


def gram_ids(text: str, bits: int, low: int = 1, high: int = 4) -> np.ndarray:
    """Hashed ids of all n-grams of one text, the text set between spaces; repeated n-grams are repeated."""
    return np.concatenate([cut_hash(g, bits) for g in hashed_grams(text, high)[low - 1 :]])


def known_grams(texts: list[str]) -> tuple[np.ndarray, float]:
    """The 3-grams of one language's texts, as bits, and the least share of them that claims a text.

    That is 0.7 of the share that all but 5 % of the texts reach when each half is held against the 3-grams of the other. A single text sets none.
    """
    rows = [np.unique(cut_hash(hashed_grams(t, 3)[2], KNOWN_BITS), return_counts=True) for t in sorted(set(texts))]
    halves = np.zeros((2, 1 << KNOWN_BITS), bool)
    for i, (ids, _) in enumerate(rows):
        halves[i % 2, ids] = True
    shares = [n[halves[1 - i % 2, ids]].sum() / n.sum() for i, (ids, n) in enumerate(rows)]
    return np.packbits(halves.any(0), bitorder="little"), 0.7 * float(np.quantile(shares, 0.05)) if len(rows) > 1 else 0.0


def svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by accelerated gradient descent; y is 1 or -1, both sides weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    step = 1.0 / (2 * float((share * (x * x).sum(1)).sum()) + l2)
    w, v, t = np.zeros(x.shape[1], x.dtype), np.zeros(x.shape[1], x.dtype), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v + step * (2 * (x.T @ (share * y * slack)) - l2 * v)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    return w[:-1], float(w[-1])


def fit(texts: list[str], langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES, bits: int = 12) -> LanguageModel:
    """Train on a list of labelled texts (those without a letter say nothing and are left out)."""
    known = {lang: f for f, names in families.items() for lang in names}
    rows = [(t, lang) for t, lang in zip(texts, langs, strict=True) if t and lang is not None and LETTER.search(t)]
    names = sorted({lang for _, lang in rows})
    groups = sorted({known.get(lang, lang) for lang in names})
    family_of = [groups.index(known.get(lang, lang)) for lang in names]
    x = np.zeros((len(rows), 1 << bits), np.float32)
    for i, (text, _) in enumerate(rows):
        ids = gram_ids(text, bits)
        x[i] = np.bincount(ids, minlength=1 << bits) / len(ids)
    scale = 1.0 / np.maximum(np.sqrt((x * x).mean(0)), 1e-4) if len(rows) else np.ones(1 << bits)
    x *= scale.astype(np.float32)
    lang = np.array([names.index(v) for _, v in rows], int)
    family = np.array(family_of, int)[lang] if len(rows) else lang
    pairs = [(-1, a, b) for a, b in combinations(range(len(groups)), 2)]
    pairs += [(f, a, b) for f in range(len(groups)) for a, b in combinations([i for i, g in enumerate(family_of) if g == f], 2)]
    weights, bias = np.zeros((1 << bits, len(pairs)), np.float32), np.zeros(len(pairs))
    for k, (f, a, b) in enumerate(pairs):
        side = family if f < 0 else lang
        use = (side == a) | (side == b)
        w, bias[k] = svm(x[use], np.where(side[use] == a, 1, -1).astype(np.float32))
        weights[:, k] = w * scale
    known = [known_grams([t for t, v in rows if v == name]) for name in names]
    return LanguageModel(names, family_of, pairs, weights, bias, bits, np.array([k for k, _ in known]), np.array([b for _, b in known]))


def claimed(model: LanguageModel, lang: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """Whether each text has enough 3-grams known to its language: the language's bound, less one standard deviation of a share of so many."""
    n = np.array([len(g) for g in grams])
    ids = np.concatenate(grams)
    seen = model.known[np.repeat(lang, n), ids >> 3] >> (ids & 7).astype(np.uint8) & 1
    return np.add.reduceat(seen, np.cumsum(n) - n, dtype=np.int64) / n >= model.least[lang] - 0.5 / np.sqrt(n)


def decide(model: LanguageModel, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index and score (0 to 1) of each row of decision values: votes pick the family, then the language within it."""

    def vote(of: int, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the pairs of one level, and the chance of its weakest win; ties go to the larger sum of margins, then the first."""
        won = np.zeros((len(margins), len(members)))
        least = np.full((len(margins), len(members)), np.inf)
        for k, (f, a, b) in enumerate(model.pairs):
            if f == of:
                m, i, j = margins[:, k], members.index(a), members.index(b)
                won[:, i] += (m > 0) + 1e-3 * np.tanh(m)
                won[:, j] += (m <= 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = won.argmax(1)
        return np.array(members)[best], 1 / (1 + np.exp(-4 * np.clip(least[np.arange(len(best)), best], -8, 8)))

    groups = sorted(set(model.family_of))
    family, score = vote(-1, groups)
    lang = np.zeros(len(margins), int)
    for g in groups:
        members = [i for i, f in enumerate(model.family_of) if f == g]
        inside, sure = vote(g, members)
        at = family == g
        lang[at] = inside[at]
        score[at] *= sure[at]
    return lang, score


def predict_texts(model: LanguageModel, texts: list[str | None], most: int = 1_000_000) -> tuple[list[str], list[float], list[bool]]:
    """The nearest language, score, and whether that language claims the text; `und`, 0 and no for a null and a text without a letter.

    Works through about `most` n-grams at once.
    """
    out, scores, own = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
    if not model.languages:
        return out, scores, own
    rows, held, marks, starts, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal rows, held, marks, starts, size
        if not rows:
            return
        ids = np.concatenate(held)
        ends = np.append(starts[1:], size)
        n = (ends - np.array(starts))[:, None]
        sums = np.empty((len(starts), len(model.pairs)))
        for k in range(len(model.pairs)):
            sums[:, k] = np.add.reduceat(np.ascontiguousarray(model.weights[:, k])[ids], starts, dtype=np.float64)
        lang, score = decide(model, sums / n + model.bias) if model.pairs else (np.zeros(len(rows), int), np.ones(len(rows)))
        for i, a, b, c in zip(rows, lang, score, claimed(model, lang, marks), strict=True):
            out[i], scores[i], own[i] = model.languages[a], round(float(b), 9), bool(c)
        rows, held, marks, starts, size = [], [], [], [], 0

    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            grams = hashed_grams(text)
            rows.append(i)
            starts.append(size)
            held.append(np.concatenate([cut_hash(g, model.bits) for g in grams]))
            marks.append(cut_hash(grams[2], KNOWN_BITS))
            size += len(held[-1])
            if size >= most:
                flush()
    flush()
    return out, scores, own


def held_out_column():
    """True for the fourth of the documents that no model learns from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_language_model(docs: DataFrame, per_language: int = 200, families: dict[str, tuple[str, ...]] = FAMILIES) -> LanguageModel:
    """Fit on a bounded sample: about `per_language` (at most twice as many) labelled documents of every language, none held out.

    The sample is drawn by a hash of doc_id, in proportion to each language's count over all documents; the count reads two columns.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out_column())
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    # a row a language, as many as the model has anyway: the texts stay where they are
    drawn = usable.join(F.broadcast(counts), "lang").withColumn("__draw", draw).where(F.col("__draw") <= F.floor(1e6 * per_language / F.col("__n")))
    # a row for each language and place in its own ranking, so that no language takes another's places
    ranked = drawn.withColumn("__rank", F.row_number().over(Window.partitionBy("lang").orderBy("__draw", "doc_id", "text")))
    rows = ranked.where(F.col("__rank") <= 2 * per_language).select("text", "lang").collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], families)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "claimed")) -> DataFrame:
    """Add lang_pred, score and claimed (or as `names` says) to every document, judged by its whole text alone. Columns of these names are replaced.

    lang_pred is the nearest learned language, and claimed says whether the text is like that language's training texts at all. A null text
    and one without a letter have `und`, 0 and false; very long texts are read whole, in slices of n-grams.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lang, score, own = predict_texts(sent.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(own, pa.bool_())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document: the nearest learned one, and whether it claims the text.

    Null and letterless texts give `und` with score 0; empty tables give no rows; repeated rows are judged alike; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "claimed")
