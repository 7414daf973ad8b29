"""The corpus pipeline: documents in, clean tokenized documents out, in five stages.

Each stage works on all that its predecessor kept and is written as Parquet and read again as the next one's documents. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, decontam, jaccard, language, pii
from tessera.llm.shared import set_aside, stage
from tessera.session import ship_code, small_batches


def ready(spark: SparkSession) -> None:
    ship_code(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a learned language; texts without a letter, nulls and texts that no language claims go.

    A text of any length is judged whole; repeated rows are judged alike; an empty table gives none. Other columns stay as they are, those
    that are named like the operator's too; lang and doc_id must be there to learn from.
    """
    ready(spark)
    names = tuple(set_aside(docs, c) for c in ("lang_pred", "score", "claimed"))
    judged = language.identify(docs, language.train_language_model(docs), names=names)
    return judged.where(names[2]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near copies, and one of its repeated rows (the least in all other columns).

    Null, empty and blank texts are near nothing and stay; a text of any length is compared whole; an empty table gives none. Columns
    other than doc_id and text are carried along, whatever their names. Texts are moved once, to their doc_id: the same partitioning serves
    the choice of documents and that of repeated rows.
    """
    ready(spark)
    kept, place = set_aside(docs, "kept"), set_aside(docs, "place")
    found = jaccard.jaccard_components(docs.select("doc_id", "text"))
    firsts = stage(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept)).distinct(), "kept")
    of_id = docs.where("doc_id is not null").join(firsts.where(F.col(kept).isNotNull()), F.col("doc_id") == F.col(kept), "left_semi")
    # a group without any id keeps all its texts; elsewhere documents without an id are no first ones
    nameless = docs.where("doc_id is null")
    if firsts.where(F.col(kept).isNull()).isEmpty():
        nameless = nameless.limit(0)
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]

    def one_each(rows: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy("text", *rest)
        fresh = (F.row_number().over(order) == 1) | ~F.col("text").eqNullSafe(F.lag("text").over(order))
        return rows.withColumn(place, fresh).where(place).select(*docs.columns)

    return one_each(of_id, "doc_id").unionByName(one_each(nameless, "text"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which no benchmark item occurs.

    Null and empty texts stay, and so does everything where the benchmark is empty; long texts are searched whole; all columns are kept.
    """
    ready(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put [KIND] in the place of personal data; n_chars, where there is one, follows the text.

    Null and empty texts stay as they are (and a null's n_chars too); long texts are masked whole; repeated rows alike; an empty table
    gives none. Other columns stay as they are, those that are named like the operator's too.
    """
    ready(spark)
    found, spans = set_aside(docs, "found"), set_aside(docs, "spans")
    candidates = pii.candidates(docs, found=found)
    masked = pii.mask(pii.classify(candidates, pii.fit(candidates, found=found), found=found, spans=spans), spans=spans)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add each document's token count and the digests of its ids and of what they decode to: n_tokens, ids_sha256, decoded_sha256.

    Columns of these names are replaced, all others kept. Null texts are read as empty; an empty table gives no rows.
    """
    ready(spark)
    return bpe.digest(docs, bpe.tokenizer_path(bpe.TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: SQL expresses neither the trained stages nor the tokenizer; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
