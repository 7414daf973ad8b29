"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, chat, decontam, gif, importance, jaccard, language, neighbours, pages, pii, spelling, tokens, urls
from tessera.session import ship_code, small_batches

_QUERIES = [language.op1_language_id, pages.op2_html_extraction, pii.op3_pii, tokens.op4_tokens, gif.op5_gif, bpe.op6_bpe, chat.op7_preferences, jaccard.op8_jaccard_join, decontam.op9_decontamination, urls.op10_url_filter, importance.op11_importance, neighbours.op12_neighbours, spelling.op13_spelling]


def _with_code(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _with_code(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_preferences": chat.OP7_SQL}
