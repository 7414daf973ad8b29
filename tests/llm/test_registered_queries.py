"""The registered text queries themselves, on the smallest tables, against plain forms and the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, catalog, decontam, gif, tokens
from tests.llm.test_text_operators import base_spans, brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])}


def answer(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    return rows, {r["doc_id"]: r for r in rows}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_op3(spark, docs):
    rows, got = answer(spark, "op3_pii")
    assert len(rows) == len(docs) and got.keys() == docs.keys()
    for i, t in docs.items():
        base = base_spans(t)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= set(got[i]["spans"].split(",")) | {""}


def test_op4(spark, docs):
    rows, got = answer(spark, "op4_tokens")
    plain, start = bpe.load_tokenizer(tokens.tokenizer_path(tokens.TOKENIZER)), 0
    assert len(rows) == len(docs)
    for i, t in docs.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op5(spark, docs):
    rows, got = answer(spark, "op5_gif")
    files = {r["doc_id"]: bytes(r["media"]) for r in gif.encode_media(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()}
    assert len(rows) == len(docs)
    for i, t in docs.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        assert files[i][:6] == b"GIF89a" and (r["media_bytes"], r["media_sha256"]) == (len(files[i]), sha(files[i]))
        assert sum(map(int, r["feature"].split("|")[2].split(","))) >= len(payload)


def test_op6(spark, docs):
    rows, got = answer(spark, "op6_bpe")
    plain = bpe.load_tokenizer(bpe.tokenizer_path(bpe.TOKENIZER))
    assert len(rows) == len(docs)
    for i, t in docs.items():
        ids = plain.encode(t, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))


def test_op8(spark, docs):
    rows, got = answer(spark, "op8_jaccard_join")
    names = list(docs)
    sizes, roots = brute_components(list(docs.values()))
    assert len(rows) == len(docs) and {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (n, names[r]) for i, n, r in zip(names, sizes, roots)}


def test_op9(spark, docs):
    """Every item that stands word for word in a text is found there, and what is found is as near as it says."""
    rows, _ = answer(spark, "op9_decontamination")
    items = {r["item_id"]: decontam.fold(r["text"] or "").strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found >= {(d, i) for d, t in docs.items() for i, item in items.items() if item and item in decontam.fold(t)}

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for r in rows:
        item = items[r["item_id"]]
        assert edits(item, decontam.fold(docs[r["doc_id"]])[r["start"] : r["end"]]) == r["edits"] <= int(0.07 * len(item))
