"""The pipeline on the smallest tables against what its stages do one by one, and the SQL twin of the preference query."""

from __future__ import annotations

import html
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, catalog, chat, decontam, language, urls
from tests.llm.test_text_operators import base_spans, brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").reset_index(drop=True)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    _, root = brute_components(docs.text.tolist())
    items = [decontam.fold(t).strip() for t in bench.text]
    keep = [i for i in range(len(docs)) if root[i] == i and not any(t in decontam.fold(docs.text[i]) for t in items)]
    got = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.doc_id.tolist() == docs.doc_id[keep].tolist()
    plain = bpe.load_tokenizer(bpe.tokenizer_path(bpe.TOKENIZER))
    for text, before, n in zip(got.text, docs.text[keep], got.n_tokens):
        assert not base_spans(text) and n == len(plain.encode(text, add_special_tokens=False).ids)
        if not base_spans(before) and "token =" not in before and "AKIA" not in before:
            assert text == before
    assert set(got.columns) >= set(docs.columns)


def test_texts_of_no_learned_language_go_and_all_others_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(4)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    finnish = "Suomen kieli kuuluu uralilaisten kielten itämerensuomalaiseen ryhmään, jonka edustajia puhutaan Itämeren rannoilla ja myös Venäjän puolella."
    russian = "Русский язык является одним из крупнейших языков мира по числу носителей."
    odd = [("odd", t, "en", 900_000 + i) for i, t in enumerate((letters, finnish, russian))]
    more = spark.createDataFrame(odd, "source string, text string, lang string, doc_id long").select(*[F.col(c).cast(docs.schema[c].dataType) if c in ("source", "text", "lang", "doc_id") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    model = language.train_language_model(docs)
    judged = language.identify(docs.unionByName(more), model).select("doc_id", "text", "lang_pred", "claimed").collect()
    letterless = {r["doc_id"] for r in judged if not r["text"] or not language.LETTER.search(r["text"])}
    assert {r["doc_id"] for r in judged if r["lang_pred"] == "und"} == letterless
    assert {r["doc_id"] for r in judged if not r["claimed"]} == {900_000, 900_001, 900_002} | letterless
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(more.withColumn("lang", F.lit(None).cast("string"))), SF)
    assert kept.where("doc_id >= 900000").count() == 0


def test_stages_keep_columns_named_like_their_own_and_take_odd_rows(spark):
    bench = [(1, "a benchmark passage that no other text has at all")]
    names = ["found", "spans", "score", "lang_pred", "kept", "__found", "__score", "start", "ids", "decoded"]
    long = " ".join(f"the weather was rather nice this morning number {i}" for i in range(8000))
    texts = ["the cat sat with that other thing in the morning", None, "", "   ", "the cat sat with that other thing in the morning", "write to a.b@example.org or call +49 30 1234567 now please", bench[0][1], long]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    rows.append(rows[0])
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(rows, schema)
    folder = corpus_pipeline.stage.__globals__["scratch_path"](spark, "clash")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        got = sorted(out.collect(), key=lambda r: r["doc_id"])
        assert (out.columns == docs.columns) if name != "bpe" else set(out.columns) >= set(docs.columns), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names), name
        assert step(spark, docs.limit(0), folder).count() == 0, name
        kept = [r["doc_id"] for r in got]
        if name == "jaccard_join":
            assert kept == [0, 1, 2, 3, 5, 6, 7]
        elif name == "decontamination":
            assert kept == [0, 0, 1, 2, 3, 4, 5, 7]
        elif name == "pii":
            assert kept == [0, 0, *range(1, 8)] and got[6]["text"] == "write to [EMAIL] or call [PHONE] now please" and got[6]["n_chars"] == len(got[6]["text"]) and got[2]["text"] is None and got[-1]["text"] == long
        elif name == "language_id":
            assert not {1, 2, 3} & set(kept) and 7 in kept


def test_preferences_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    want = {tuple(None if v != v else v for v in r) for r in con.sql(f"select chosen_id, prompt_turns, prompt, chosen, chosen_unmasked from ({chat.OP7_SQL})").fetchall()}
    got = catalog.queries()["op7_preferences"](spark, SF)
    assert {(r["chosen_id"], r["prompt_turns"], r["prompt"], r["chosen"], r["chosen_unmasked"]) for r in got.collect()} == want


def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = catalog.queries()["op1_language_id"](spark, SF).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index) and got.score.between(0, 1).all()
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held in got.held_out.items())
    known = {i for i, v in docs.lang.items() if got.held_out[i] and v is not None and docs.text[i] and language.LETTER.search(docs.text[i])}
    assert len(known) > 30 and sum(got.lang_pred[i] == docs.lang[i] for i in known) / len(known) >= 0.97
    assert set(got.lang_pred) <= {*docs.lang.dropna(), "und"}


def test_url_query_against_plain_rules(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = catalog.queries()["op10_url_filter"](spark, SF).toPandas().set_index("page_id")
    weights = urls.train(urls.BLOCKED, urls.ALLOWED)
    assert len(got) == len(pages)
    for page, url in zip(pages.page_id, pages.url):
        _, found, rest = (url or "").partition("://")
        rest = rest if found else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1] if fits else None
        verdict = max(fits)[2] if fits else ("block" if urls.probability(host, path, weights) >= 0.5 else "allow")
        r = got.loc[page]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict), url


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_page_query_against_a_plain_expression(spark, sf):
    """The test pages mark their articles with clean tags, so an expression finds the text."""
    folder = SF.replace("sf0.001", sf)
    pages = spark.read.parquet(f"{folder}/pages.parquet").toPandas()
    got = catalog.queries()["op2_html_extraction"](spark, folder).toPandas().set_index("page_id")
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    for page, source in zip(pages.page_id, pages.html):
        article = re.search(r"<article>(.*?)(?:</article>|$)", source or "", re.S)
        plain = re.sub(r"<div class=\"ad\">.*?</div>|<(script|style|form|aside|nav|footer)\b.*?</\1>|<!--.*?-->", " ", article[1] if article else "", flags=re.S)
        plain = re.sub(r"</?(?:p|h1|br|li|ul|div)\b[^>]*>", " ", plain)
        assert got.text[page] == " ".join(html.unescape(re.sub(r"<[^>]*>", "", plain)).split()), page


def test_every_dealt_operator_is_registered():
    names = list(catalog.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
