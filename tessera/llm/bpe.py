"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last characters of a text cuts it into chunks where the content says so, so copies and shared passages give the same
chunks wherever they stand. A chunk is encoded once and its ids, and what they decode to, are used again in every other text that holds it. A
cut may fall inside a word; the ids on both sides of such a join do not count. The window over the join is encoded again, and it grows, chunk
by chunk, until it ends at white space on both sides: no token goes over white space, so there the ids agree exactly with those of the whole
text.

Chunks are kept per Python worker, in two generations: those not met for a whole generation are forgotten, hot ones never. What a new chunk
is made of is looked up piece by piece (the words of the tokenizer's own pattern), and only pieces never met go to the tokenizer's model.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import set_aside

TOKENIZER = "word_bpe_49k.json"
#: No token goes over these, and the tokenizer's normaliser changes nothing across them.
GAP = re.compile(r"[ \t\n\r]")
# Fixed value: the pattern that this kind of tokenizer file splits text by, after NFC, blanks for white space and lower case.
WORD_PIECES = r"[{L}]+|'(?:[stmd]|re|ve|ll)|[{N}]|[^{S}{L}{N}]+"
_WORKER: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def once_a_worker(make, *args):
    """What make(*args) gives, kept for all tasks of a Python worker."""
    if (make, *args) not in _WORKER:
        _WORKER[make, *args] = make(*args)
    return _WORKER[make, *args]


def open_tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def load_tokenizer(path: str):
    """The library's tokenizer, once a worker, without truncation or padding; it runs on the task's own thread."""
    return once_a_worker(open_tokenizer, path)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b if b in plain else next(extra)) for b in range(256)]


BYTE_CHARS = byte_characters()


#: Beyond these code points lie those that some Unicode tables do not know yet.
WIDE = re.compile("[^\x00-\u0377]")


def unassigned() -> np.ndarray:
    """Which code points this Python's Unicode tables do not know."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def known_class(kind: str) -> str:
    """The code points up to U+0377 of a general category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x378) if unicodedata.category(chr(c))[0] == kind)


class Pieces(dict):
    """Ids of pieces of text as little-endian unsigned 32-bit integers; each piece goes to the tokenizer's model once. The table is bounded.

    A piece is a match of the pattern by which the tokenizer itself splits a text ({L}, {N} and {S} stand for letters, numbers and white
    space). Texts with one of its special tokens, or with characters newer than the Unicode tables here (the library's may class them
    otherwise), are `odd` and left to the library whole.
    """

    def __init__(self, path: str, pattern: str, most: int = 1_200_000):
        import regex

        super().__init__()
        self.tokenizer, self.most = load_tokenizer(path), most
        self.model = self.tokenizer.model
        self.few = re.compile(pattern.format(L=known_class("L"), N=known_class("N"), S=r"\t-\r \x85\xa0")).findall
        self.all = regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", S=r"\s")).findall
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search

    def odd(self, text: str) -> bool:
        if self.special(text):
            return True
        if text.isascii() or not WIDE.search(text):
            return False
        return bool(once_a_worker(unassigned)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())

    def split(self, text: str) -> list[str]:
        return (self.few if text.isascii() or not WIDE.search(text) else self.all)(text)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            # the pieces met first are the commonest: the later half goes
            for p in [*islice(reversed(self), self.most // 2)]:
                del self[p]
        ids = self[piece] = array("I", [t.id for t in self.model.tokenize("".join(map(BYTE_CHARS.__getitem__, piece.encode())))]).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text that needs no normaliser."""
        return self.whole(text) if self.odd(text) else b"".join(map(self.__getitem__, self.split(text)))


def cut_points(points: np.ndarray, window: int = 32, bits: int = 9) -> list[int]:
    """Ends of chunks: where a gear hash of the last `window` code points begins with `bits` zeros, so one in 2**bits on average."""
    if len(points) > window:
        h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        size = 1
        while size < window:  # h becomes the sum over `size` code points of their values, shifted left by their distance
            wider = h.copy()
            wider[size:] += h[:-size] << np.uint64(size)
            h, size = wider, 2 * size
        cut = np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1
        return [*cut[(cut >= window) & (cut < len(points))].tolist(), len(points)]
    return [len(points)]


class Decoder(dict):
    """Decodes as the library's decode(ids, skip_special_tokens=False) does for a file without a decoder: tokens joined by blanks.

    As a table: what the packed ids of a piece decode to.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        t = load_tokenizer(path)
        if t.decoder is not None:
            raise ValueError("this file has a decoder of its own")
        self.tokens, self.most = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))], most

    def __missing__(self, ids: bytes) -> str:
        if len(self) >= self.most:
            self.clear()
        text = self[ids] = self.decode(np.frombuffer(ids, "<u4"))
        return text

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def fold(text: str) -> str:
    """What the tokenizer's normaliser makes of a text: NFC, and lower case letter by letter (white space is dropped later anyway)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class ChunkEncoder:
    """Encodes texts as the tokenizer does, and decodes what came out."""

    def __init__(self, path: str, bits: int = 9, most_chunks: int = 8_000):
        self.bits, self.most_chunks = bits, most_chunks
        self.pieces, self.decoder = Pieces(path, WORD_PIECES), Decoder(path)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.reused = self.encoded = self.repaired = 0

    def plain(self, text: str) -> tuple[bytes, str]:
        """Ids of a piece of text that ends at white space, or with the text, on both sides; and what they decode to."""
        if self.pieces.odd(text):
            ids = self.pieces.whole(text)
            return ids, self.decoder.decode(np.frombuffer(ids, "<u4"))
        parts = [*map(self.pieces.__getitem__, self.pieces.split(fold(text)))]
        return b"".join(parts), " ".join(map(self.decoder.__getitem__, parts))

    def chunk(self, text: str) -> tuple[str, bytes | None, str, str]:
        """(text before the first white space, ids and decoded text from there to the last, text after it); ids are None without any."""
        found = self.young.get(text)
        if found is not None:
            self.reused += 1
            return found
        found = self.old.get(text)
        if found is None:
            self.encoded += 1
            first = GAP.search(text)
            if first:
                last = 1 + max(map(text.rfind, " \t\n\r"))
                found = (text[: first.start()], *self.plain(text[first.start() : last]), text[last:])
            else:
                found = (text, None, "", "")
        else:
            self.reused += 1
        if len(self.young) >= self.most_chunks:
            self.old, self.young = self.young, {}
        self.young[text] = found
        return found

    def run(self, text: str | None) -> tuple[bytes, str]:
        """Packed ids of a whole text, and what they decode to."""
        if not text:
            return b"", ""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids: list[bytes] = []
        decoded: list[str] = []

        def add(i: bytes, d: str) -> None:
            if i:
                ids.append(i)
                decoded.append(d)

        window, start = "", 0  # what stands since the last white space
        for end in cut_points(points, bits=self.bits):
            head, inner, words, tail = self.chunk(text[start:end])
            self.repaired += bool(window)
            window, start = window + head, end
            if inner is not None:
                add(*self.plain(window))
                add(inner, words)
                window = tail
        add(*self.plain(window))
        return b"".join(ids), " ".join(decoded)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.run(text)[0], "<u4")


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `ids` (array<int>), the token ids of every document's whole text, and `decoded`, the text that they decode to.

    A null or empty text has no ids and decodes to the empty string; a very long one is encoded whole, chunk by chunk. Equal texts have equal
    values; repeated rows each have theirs. Columns of these two names are replaced, others kept; an empty table gives no rows.
    """
    docs = docs.drop(ids, decoded)
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once_a_worker(ChunkEncoder, path)
        for batch in (b.slice(i, 250) for b in batches for i in range(0, b.num_rows, 250)):
            done = [encoder.run(value.as_py()) for value in batch.column(at)]
            ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i, _ in done])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(i for i, _ in done), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([d for _, d in done], pa.string())], names=[*batch.schema.names, ids, decoded])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_tokens, ids_sha256 (of the decimal ids joined by a blank) and decoded_sha256 to every document.

    Columns of these names are replaced, all others kept, whatever their names. Nulls, empty tables and the like as in encode_texts.
    """
    ids, decoded = set_aside(docs, "ids"), set_aside(docs, "decoded")
    done = encode_texts(docs, path, text, ids, decoded)
    added = {"n_tokens": F.size(ids).cast("long"), "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256), "decoded_sha256": F.sha2(F.col(decoded), 256)}
    return done.select(*[c for c in docs.columns if c not in added], *[v.alias(k) for k, v in added.items()])


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of every document; a null or empty text has no tokens, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, tokenizer_path(TOKENIZER)).drop("text")
