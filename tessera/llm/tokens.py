"""Token ids in a binary format: static range asymmetric numeral system (rANS) over shared frequency tables.

One frequency table, counted over all tokens of all documents, serves every block. A block holds whole documents; its ids are dealt out to
interleaved lanes, each a 64-bit rANS state, so coding is a few array operations a step. Every block carries its lanes' final states,
checkpoints of all states on the way (so one block can be decoded from several places at once), and checksums of its payload and its ids;
blocks are independent of each other, so a file decodes in parallel.

The file: a Parquet table of blocks, `part` and `block` in ascending order of doc_id, beside the table of frequencies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Pieces, once_a_worker, tokenizer_path
from tessera.llm.shared import range_bounds, range_bucket, scratch_path, stage

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Slots of the frequency table: 2**PRECISION.
PRECISION = 18
LANES = 2048
BLOCK_TOKENS = 1 << 19
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)
# Fixed value: the pattern by which this kind of tokenizer file splits a text; no token goes over such a piece's end.
BYTE_PIECES = r" ?[{L}]+|'(?:[stmd]|re|ve|ll)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
BLOCK_SCHEMA = "part int, block int, first_token long, doc_ids array<long>, lengths array<long>, n_tokens long, lanes int, states binary, checkpoints binary, payload binary, payload_crc32 long, ids_crc32 long"


# --- tokens -----------------------------------------------------------------------------------------------------------


_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: np.ndarray) -> bytes:
    """Ids for the way between tasks: byte planes under zstd."""
    return _PRESS.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNPRESS.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(key, part, n, ids): each text's ids with the end id, packed. A null text is read as empty.

    Each task adds one row of its own, with n = -1 and the packed occurrences of every id in it, so that no second pass has to count them.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "part", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = once_a_worker(Pieces, path, BYTE_PIECES)
        end = np.array([end_id], "<u4").tobytes()
        total = np.zeros(pieces.tokenizer.get_vocab_size(with_added_tokens=True) + end_id + 1, np.int64)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = [np.frombuffer(pieces.encode(t or "") + end, "<u4") for t in part.column(2).to_pylist()]
                total += np.bincount(np.concatenate(ids), minlength=len(total))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([pack(x) for x in ids], pa.binary())], names=names)
        if key_type is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), pa.array([-1], pa.int32()), pa.array([-1], pa.int64()), pa.array([np.concatenate([seen, total[seen]]).astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select(key, "part", text).mapInArrow(run, f"`{key}` {kind}, part int, n long, ids binary")


# --- frequencies ------------------------------------------------------------------------------------------------------


def count_tokens(tokens: DataFrame) -> dict[int, int]:
    """Occurrences of every id over all documents, from the tasks' own counts; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column(0).to_pylist():
                ids, n = np.frombuffer(v, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    rows = tokens.where("n < 0").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


class Table:
    """Frequencies scaled to 2**precision slots, at least one each, and what coding needs of them."""

    def __init__(self, counts: dict[int, int], precision: int = PRECISION):
        ids = np.array(sorted(counts), np.int64)
        if len(ids) > 1 << precision:
            raise ValueError("more symbols than slots")
        raw = np.array([counts[i] for i in ids.tolist()], np.float64)
        freq = np.maximum(1, np.floor(raw / max(1.0, raw.sum()) * (1 << precision))).astype(np.int64)
        # the rounding's rest is taken from, or given to, the most frequent symbols, ties by id
        order = np.lexsort((ids, -raw))
        over = int(freq.sum()) - (1 << precision)
        while over > 0:
            take = order[freq[order] > 1][:over]
            freq[take] -= 1
            over -= len(take)
        if over < 0 and len(ids):
            freq[order[0]] -= over
        size = int(ids[-1]) + 1 if len(ids) else 1
        self.precision = precision
        self.freq, self.start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[ids] = freq
        self.start[ids] = np.cumsum(freq) - freq
        self.symbol = np.repeat(ids, freq).astype(np.uint32)


# --- blocks -----------------------------------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> tuple[int, bytes, bytes, bytes]:
    """(lanes, states, checkpoints, payload) of one block. Token t is in lane t % lanes, step t // lanes; steps are coded from the last to the first.

    The payload is in the order in which a decoder reads it. A checkpoint is (step, words read before it, all states there).
    """
    lanes = max(1, min(lanes, len(ids) // 64))
    bits = np.uint64(table.precision)
    freq, start = table.freq[ids], table.start[ids]
    limit = freq << (np.uint64(63) - bits)
    x = np.full(lanes, _LOW, np.uint64)
    steps = -(-len(ids) // lanes)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    marks: dict[int, np.ndarray] = {}
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min((s + 1) * lanes, len(ids))
        y, f = x[: b - a], freq[a:b]
        over = y >= limit[a:b]
        words[s] = (y[over] & _MASK32).astype("<u4")
        y = np.where(over, y >> _32, y)
        q = y // f
        x[: b - a] = (q << bits) + (y - q * f) + start[a:b]
        if s and s % every == 0:
            marks[s] = x.copy()
    read = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    points = b"".join(np.array([s, read[s]], "<u8").tobytes() + marks[s].astype("<u8").tobytes() for s in sorted(marks))
    return lanes, x.astype("<u8").tobytes(), points, b"".join(w.tobytes() for w in words)


def decode_span(x: np.ndarray, words: np.ndarray, at: int, tokens: int, table: Table) -> np.ndarray:
    """Decode `tokens` ids from given states, reading words from position `at`."""
    bits, mask = np.uint64(table.precision), np.uint64((1 << table.precision) - 1)
    x, lanes = x.astype(np.uint64), len(x)
    out = np.empty(tokens, np.uint32)
    words = words.astype(np.uint64)
    for a in range(0, tokens, lanes):
        b = min(a + lanes, tokens)
        y = x[: b - a]
        slot = y & mask
        s = table.symbol[slot]
        out[a:b] = s
        y = table.freq[s] * (y >> bits) + slot - table.start[s]
        low = np.flatnonzero(y < _LOW)
        if len(low):
            y[low] = (y[low] << _32) | words[at : at + len(low)]
            at += len(low)
        x[: b - a] = y
    return out


def decode_block(n_tokens: int, lanes: int, states: bytes, payload: bytes, table: Table) -> np.ndarray:
    return decode_span(np.frombuffer(states, "<u8"), np.frombuffer(payload, "<u4"), 0, n_tokens, table)


def decode_from_checkpoint(point: int, n_tokens: int, lanes: int, checkpoints: bytes, payload: bytes, table: Table) -> tuple[int, np.ndarray]:
    """(first token, ids from there to the block's end), begun at a checkpoint: how one block is decoded from several places."""
    size = 16 + 8 * lanes
    step, at = np.frombuffer(checkpoints[point * size : point * size + 16], "<u8").tolist()
    states = np.frombuffer(checkpoints[point * size + 16 : (point + 1) * size], "<u8")
    return step * lanes, decode_span(states, np.frombuffer(payload, "<u4"), at, n_tokens - step * lanes, table)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> Table:
    """Tokenize all documents and write them to `path` (blocks and frequencies) in ascending order of the integer key, nulls first, ties by ids.

    Each text is tokenized and counted once; its ids wait in the shared folder until the counts are complete. Then they are dealt out by ranges of the key.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, key, parts)
    tokens = stage(tokenize(docs.withColumn("part", range_bucket(key, bounds)), tokenizer, key, text, end_id), "ids", codec="uncompressed")
    counts = count_tokens(tokens)
    table = Table(counts)
    sent = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        part, block, first, size = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([i for _, i in held])
            lanes, states, points, payload = encode_block(ids, sent.value)
            row = [part, block, first, [k for k, _ in held], [len(i) for _, i in held], len(ids), lanes, states, points, payload, zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes())]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for k, p, packed in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if held and (p != part or size >= block_tokens):
                    yield close()
                    block, first = (block + 1, first + size) if p == part else (0, 0)
                    held, size = [], 0
                elif p != part:
                    block, first = 0, 0
                part = p
                held.append((k, unpack(packed)))
                size += len(held[-1][1])
        if held:
            yield close()

    dealt = tokens.where("n >= 0").repartition(parts, "part").sortWithinPartitions("part", F.col(key).asc_nulls_first(), "ids")
    dealt.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame(sorted(counts.items()), "id long, n long").coalesce(1).write.parquet(f"{path}/frequencies")
    return table


def read_tokens(spark, path: str, key: str = "doc_id") -> DataFrame:
    """Decode a file's blocks in parallel: (key, start, n_tokens, ids_crc32), start counted in tokens over the whole file. Checks both checksums."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    table = Table({r["id"]: r["n"] for r in spark.read.parquet(f"{path}/frequencies").collect()})
    sent = spark.sparkContext.broadcast(table)
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a part
    offset, total = {}, 0
    for part in sorted(sizes):
        offset[part] = total
        total += sizes[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError("a block's payload is damaged")
                ids = decode_block(row["n_tokens"], row["lanes"], row["states"], row["payload"], sent.value).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["ids_crc32"]:
                    raise ValueError("a block's ids are damaged")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + (offset[row["part"]] + row["first_token"])), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """Encode, write and read back every document's tokens.

    A null or empty text is the end id alone. Rows with equal doc_id follow each other, ordered by their ids; a null doc_id comes first. An
    empty table gives an empty file. Other columns are not read.
    """
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path(TOKENIZER), path)
    return read_tokens(spark, path)
