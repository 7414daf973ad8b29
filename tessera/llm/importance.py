"""Importance resampling towards a target distribution, by hashed n-grams and exponential noise.

Separators collapse to one space and a regex with overlapping matches and a boundary lookahead gives the spans of the one to three words that begin
at every word. Each span's CRC is its bucket. What a document holds is kept as sorted buckets, so texts are scanned once; the counts of all
documents and of the target give each bucket's gain, a document's weight is the sum of its gains, and the rows of greatest weight plus noise
are drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stage
from tessera.operators.ranking import total_rank

#: ASCII but digits and letters; A-Z are lower-cased before.
SEPARATORS = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: From every word on: the word, and the next one and two where there are any.
GRAMS = regex.compile(rb" ([^ ]+)(?: ([^ ]+))?(?: ([^ ]+))?(?= )")

#: The table of crc32, which is linear: what one byte changes against a zero byte.
_TABLE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)
#: Pieces of spans of more bytes are hashed one by one.
LONG = 64
#: Matches hashed at once.
MOST = 1 << 17


def carried_on(b: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 carried on from crc over every b[start:end], many at a time."""
    size = end - start
    out = crc.copy()
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(b[start[i] : end[i]], int(crc[i]))
    short = np.where(size > LONG, 0, size)
    order = np.argsort(short, kind="stable")
    order = order[np.searchsorted(short[order], 0, side="right") :]
    short, at, state = short[order], start[order], ~crc[order]
    for k in range(int(short[-1]) if len(short) else 0):
        lo = int(np.searchsorted(short, k, side="right"))  # the spans that have a byte k
        s = state[lo:]
        state[lo:] = _TABLE[(s ^ b[at[lo:] + k]) & 0xFF] ^ (s >> np.uint32(8))
    out[order] = ~state
    return out


def gram_buckets(texts: list[bytes | None], buckets: int) -> list[tuple[int, np.ndarray]]:
    """For each text the number of words, and the bucket of each run of one to three words, repeats included; spans of many texts are hashed together."""
    words, found = [0] * len(texts), [[] for _ in texts]
    held: list[tuple[int, bytes, np.ndarray, np.ndarray]] = []  # text, bytes, starts and ends of its matches
    count = 0

    def flush() -> None:
        nonlocal count
        if held:
            base = np.cumsum([0, *(len(x) for _, x, _, _ in held)])
            b = np.frombuffer(b"".join(x for _, x, _, _ in held), np.uint8)
            start = np.concatenate([s + o for (_, _, s, _), o in zip(held, base)])
            ends = np.concatenate([np.where(e > 0, e + o, 0) for (_, _, _, e), o in zip(held, base)])
            crc, at, out = np.zeros(len(start), np.uint32), start, []
            for k in range(3):  # a span begins with the shorter one
                end = np.maximum(at, ends[:, k])
                crc, at = carried_on(b, at, end, crc), end
                out.append(crc % np.uint32(buckets))
            lo = 0
            for i, _, s, e in held:
                hi = lo + len(s)
                found[i] += [out[k][lo:hi][e[:, k] > 0] for k in range(3)]
                lo = hi
        held.clear()
        count = 0

    for i, text in enumerate(texts):
        line, before = b" " + SEPARATORS.sub(b" ", (text or b"").lower()).strip(b" ") + b" ", 0
        matches = GRAMS.finditer(line, overlapped=True)
        while chunk := [m.end(1, 2, 3) for m in islice(matches, MOST - count)]:
            ends = np.array(chunk, np.int64)
            start = np.concatenate([[before], ends[:-1, 0]]) + 1  # a word begins after the blank that ends the one before it
            low, before = before, int(ends[-1, 0])
            held.append((i, line[low : int(ends.max())], start - low, np.where(ends > 0, ends - low, 0)))
            words[i] += len(chunk)
            count += len(chunk)
            if count >= MOST:
                flush()
    flush()
    return [(n, np.concatenate(f) if f else np.zeros(0, np.uint32)) for n, f in zip(words, found, strict=True)]


def packed(buckets: np.ndarray) -> bytes:
    """Sorted buckets as differences of 16 bits, which pack well."""
    return np.diff(np.sort(buckets).astype(np.int64), prepend=0).astype("<u2").tobytes()


def unpacked(held: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(held, "<u2"), dtype=np.int64)


def gram_features(docs: DataFrame, buckets: int, keys: list[str], text: str = "text") -> DataFrame:
    """Per row: the key columns, n_words, n_features and its packed buckets."""
    if buckets > 1 << 16:
        raise ValueError("at most 65536 buckets")
    docs = docs.select(*keys, F.col(text).cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys), "n_words long", "n_features long", "held binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            rows = gram_buckets(batch.column(len(keys)).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()), pa.array([packed(f) for _, f in rows], pa.binary())], names=[*keys, "n_words", "n_features", "held"])

    return docs.mapInArrow(run, schema)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: each task sums its own, so the driver gets one count a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(unpacked(held.as_py()), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("held").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's share over the source's), each bucket counted once more than it is."""
    size, n, m = len(source), int(source.sum()), int(target.sum())
    one = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(n + size) / (float(s + 1) * float(m + size))))
    return np.array([one(int(s), int(t)) for s, t in zip(source, target, strict=True)], np.int64)


def noise(key: str, seed: int):
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(`seed:key`); a null key reads as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Per row of docs: key, n_features, weight, score and rank, the place among the drawn rows (null where not drawn).

    docs: key and text; target: text; other columns are not read. Of the rows with `least_words` words or more, floor(percent/100 of them) are drawn,
    greatest score first, ties to the smaller key, null keys first. Null and empty texts have no features and weight 0; a text of any length
    is scanned whole. Repeated rows count, and are drawn, as often as they are there. Without a target all shares of the target are alike; an empty table gives no rows.
    """
    features = stage(gram_features(docs, buckets, [key]), "features")
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(gram_features(target, buckets, []), buckets))
    kind = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gains[unpacked(h.as_py())].sum()) for h in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=[key, "n_words", "n_features", "weight"])

    weighed = features.select(key, "n_words", "n_features", "held").mapInArrow(weigh, f"`{key}` {kind}, n_words long, n_features long, weight long")
    scored = weighed.withColumns({"score": (F.col("weight") + noise(key, seed)).cast("long"), "open": F.col("n_words") >= least_words})
    # equal rows are one row that stands for several
    scored = stage(scored.groupBy(key, "n_features", "weight", "score", "open").agg(F.count(F.lit(1)).alias("copies")), "scored")
    drawn = percent * (scored.where("open").agg(F.sum("copies")).first()[0] or 0) // 100
    ranked = total_rank(scored.where("open").withColumn("down", -F.col("score")), ["down", key], "first", "copies").drop("down")
    all_rows = ranked.unionByName(scored.where("not open").withColumn("first", F.lit(None).cast("long")))
    place = F.col("first") + F.col("copy")
    each = all_rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return each.select(key, "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))


def op11_importance(spark, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the texts of the benchmark."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
