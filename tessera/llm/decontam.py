"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits leaves at least m - q + 1 - k q of its q-grams intact, all on diagonals
(text position less item position) at most k from where it begins. So shared q-grams are counted in overlapping diagonal bands, bands
below that count are dropped, and the rest is verified by banded alignment. An item too short for q takes the longest q-grams of which
one at least must stay, so no item is held against a text without a q-gram in common. Texts and items are compared lower-cased with every
white-space character read as a blank; both changes keep positions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.shared import BASE, mix

SPACE = re.compile(r"\s")
BITMAP_BITS = 22
#: Added to diagonals, so that those of items begun before a text stay positive.
_FAR = 1_000_000


def fold(text: str) -> str:
    """Lower case and blanks, one character for one."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return SPACE.sub(" ", low)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of an array of code points, by doubling their length."""
    c = c.astype(np.uint64)
    done, out, length = {1: c}, None, 0
    size, part = 1, c
    while size < q:
        power = np.uint64(pow(int(BASE), size, 1 << 64))
        part = part[: len(part) - size] * power + part[size:] if len(part) > size else part[:0]
        size *= 2
        done[size] = part
    for bit in sorted(done, reverse=True):
        if q & bit:
            piece = done[bit]
            if out is None:
                out, length = piece, bit
            else:
                n = max(0, min(len(out), len(piece) - length))
                out = out[:n] * np.uint64(pow(int(BASE), bit, 1 << 64)) + piece[length : length + n]
                length += bit
    return mix(out[: max(0, len(c) - q + 1)])


@dataclass
class Grams:
    """The q-grams of all items that are sought by one q."""

    q: int
    hashes: np.ndarray  # distinct, sorted
    starts: np.ndarray  # of each hash, into item and pos
    item: np.ndarray
    pos: np.ndarray
    bitmap: np.ndarray


@dataclass
class Items:
    """Benchmark items with tables of their q-grams."""

    ids: list
    texts: list[str]
    budget: np.ndarray  # k of each item
    least: np.ndarray  # shared q-grams asked of a band
    tables: list[Grams]


def build_items(ids: list, texts: list[str | None], q: int = 12, rate: float = 0.07) -> Items:
    texts = [fold(t or "").strip() for t in texts]
    size = np.array([len(t) for t in texts], np.int64)
    budget = np.floor(rate * size).astype(np.int64)
    # k edits cut an item in k + 1 whole parts, the longest of size // (k + 1) characters at least
    own = np.minimum(q, size // (budget + 1))
    least = size - own + 1 - budget * own
    tables = []
    for width in sorted({*own[size > 0].tolist()}):
        hashes, item, pos = [], [], []
        for i in np.flatnonzero((own == width) & (size > 0)).tolist():
            h = gram_hashes(np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32), width)
            hashes.append(h)
            item.append(np.full(len(h), i))
            pos.append(np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        distinct, starts = np.unique(h[order], return_index=True)
        bitmap = np.zeros(1 << BITMAP_BITS, bool)
        bitmap[(distinct >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
        tables.append(Grams(width, distinct, np.append(starts, len(h)), np.concatenate(item)[order], np.concatenate(pos)[order], bitmap))
    return Items(ids, texts, budget, least, tables)


def infix_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of an item to any part of a region, and the end of the first part that has it."""
    col = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, c in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (region != c))
        row = np.concatenate([[i], best])
        row = np.minimum.accumulate(row - col) + col
    end = int(row.argmin())
    return int(row[end]), end


def verify(items: Items, i: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the nearest occurrence of item i in text, the first of the like, begun on a diagonal from low to high; None if it takes more edits than its budget."""
    want, k = items.texts[i], int(items.budget[i])
    a, b = max(0, low - k), min(len(text), high + len(want) + k + 1)
    region = text[a:b]
    if (at := region.find(want)) >= 0:
        return a + at, a + at + len(want), 0
    if not k:
        return None
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    x, y = points(want), points(region)
    edits, end = infix_distance(x, y)
    if edits > k:
        return None
    _, back = infix_distance(x[::-1], y[:end][::-1])
    return a + end - back, a + end, edits


def find_in_texts(items: Items, texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, int, int, int]]:
    """(text index, item index, start, end, edits) of every occurrence found, by text, item and place; about `most` characters at once.

    Of occurrences of one item that overlap in a text, the one of fewest edits stands, then the first.
    """
    held: list[tuple[int, str]] = []
    size = 0
    for n, t in enumerate(texts):
        if t:
            held.append((n, fold(t)))
            size += len(t) + 1
        if held and (size >= most or n == len(texts) - 1):
            yield from _find(items, held)
            held, size = [], 0


def _apart(found: set[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Occurrences that do not overlap another of their item in their text: fewest edits first, then the first place."""
    taken: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, i, start, end, edits in sorted(found, key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
        held = taken.setdefault((n, i), [])
        # those taken are apart from each other, so only the neighbours can overlap
        at = bisect_left(held, (start, end, edits))
        if (at == len(held) or held[at][0] >= end) and (not at or held[at - 1][1] <= start):
            held.insert(at, (start, end, edits))
    return [(n, i, *r) for (n, i), rows in sorted(taken.items()) for r in rows]


def _find(items: Items, held: list[tuple[int, str]]) -> Iterator[tuple[int, int, int, int, int]]:
    found = set()
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in held])])
    # the character between two texts is in no q-gram that could lead to an item across them: verification looks at one text
    c = np.frombuffer("\x00".join(t for _, t in held).encode("utf-32-le", "surrogatepass"), np.uint32)
    for table in items.tables:
        h = gram_hashes(c, table.q)
        at = np.flatnonzero(table.bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        h = h[at]
        slot = np.minimum(np.searchsorted(table.hashes, h), len(table.hashes) - 1)
        same = table.hashes[slot] == h
        at, slot = at[same], slot[same]
        times = table.starts[slot + 1] - table.starts[slot]
        # a q-gram that stands often, in texts and in items, is worked through in pieces, cut between texts
        owners = np.searchsorted(begin, at, side="right") - 1
        for lo, hi in _pieces(times, owners):
            found.update(_bands(items, table, held, begin, at[lo:hi], slot[lo:hi], times[lo:hi]))
    yield from _apart(found)


def _pieces(times: np.ndarray, owners: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of hits of about `most` shared q-grams, whole texts each."""
    if not len(times):
        return
    edges = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), len(owners))
    before = np.concatenate([[0], np.cumsum(times)])
    lo = 0
    for edge in edges[1:].tolist():
        if before[edge] - before[lo] >= most or edge == len(owners):
            yield lo, edge
            lo = edge


def _bands(items: Items, table: Grams, held: list[tuple[int, str]], begin: np.ndarray, at: np.ndarray, slot: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Verified occurrences in the bands that share q-grams enough."""
    each = np.repeat(table.starts[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, diagonal = table.item[each], np.repeat(at, times) - table.pos[each]
    owner = np.repeat(np.searchsorted(begin, at, side="right") - 1, times)
    # overlapping bands: each diagonal is in two, and any k diagonals either side of a start are whole in one
    width = 2 * items.budget[item] + 1
    shifted = diagonal - begin[owner] + _FAR
    key = (owner * (len(items.ids) + 1) + item).astype(np.int64)
    for half in (0, 1):
        band = (shifted + half * width) // (2 * width)
        order = np.lexsort((band, key))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(band[order]) != 0)]))
        count, first = np.diff(np.append(new, len(order))), order[new]
        for j in first[count >= items.least[item[first]]]:
            o, i, w = int(owner[j]), int(item[j]), int(width[j])
            low = int(band[j]) * 2 * w - half * w - _FAR
            if got := verify(items, i, held[o][1], low, low + 2 * w - 1):
                yield held[o][0], i, *got


def item_blocks(benchmark: DataFrame, q: int, rate: float, block: int = 20_000) -> Iterator[Items]:
    """The benchmark in blocks of about 20,000 items, so that no table sent to the executors grows with it."""
    items = benchmark.select("item_id", "text").where(F.length(F.trim("text")) > 0)
    blocks = max(1, -(-items.count() // block))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        yield build_items([r["item_id"] for r in rows], [r["text"] for r in rows], q, rate)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", q: int = 12, rate: float = 0.07) -> DataFrame:
    """(key, item_id, start, end, edits): where a benchmark item occurs in a document with at most rate x its length edits.

    Offsets are code points of the document, end exclusive. Every place is given; of overlapping ones of an item the nearest, then the
    first. Null, empty and blank texts and items match nothing; a text of any length is searched whole; repeated rows are each searched;
    an empty table on either side gives no rows. Other columns are not read, whatever their names.
    """
    kind = benchmark.schema["item_id"].dataType
    schema = T.StructType([docs.schema[key], T.StructField("item_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "end", "edits")]])
    kind = to_arrow_type(kind)
    out = None
    for items in item_blocks(benchmark, q, rate):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(find_in_texts(sent.value, batch.column(1).to_pylist()))
                if rows:
                    owner, item, *places = zip(*rows, strict=True)
                    columns = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array([sent.value.ids[i] for i in item], kind), *[pa.array(v, pa.int64()) for v in places]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "item_id", "start", "end", "edits"])

        part = docs.select(key, text).mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", q: int = 12, rate: float = 0.07) -> DataFrame:
    """The documents in which no benchmark item occurs, whole and with all their columns, whatever their names.

    A document of a null, empty or blank text stays; so do all where the benchmark is empty. Repeated rows are judged alike.
    """
    at = docs.columns.index(text)
    for items in item_blocks(benchmark, q, rate):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for r in find_in_texts(sent.value, batch.column(at).to_pylist()):
                    keep[r[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every place where a benchmark item occurs in a document, over all documents and items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
