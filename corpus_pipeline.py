"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the columns of documents; the last
returns each document's tokens. run() writes every stage's result as Parquet and reads it again. Defined cases are
the operators'; of near duplicates one row stays, whatever ids are missing or repeated, and without an id only if no row has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from weftline.llm.bpe import bpe_encode
from weftline.llm.decontaminate import drop_contaminated
from weftline.llm.jaccard_join import jaccard_components
from weftline.llm.pii_crf import mask_personal_data
from weftline.llm.state import small_batches, written
from weftline.llm.toxicity import drop_toxic, fit_toxicity, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7, by a model of the labels that aren't held out. Null and empty texts are scored as texts without
    words; repeated rows all go or stay; a row without an id is scored, not learned from."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, fit_toxicity(docs.select("doc_id", "text").where(~held_out(3, 1)), labels.where(~held_out(3, 1))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the one with the smallest id (those without one come last), then the first row. Null and empty texts are near
    to nothing and all stay; rows that repeat both id and text are copies."""
    keyed = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("at")))
    found = jaccard_components(keyed.select("at", F.col("doc.text").alias("text")), id_col="at").select(F.col("doc_id").alias("at"), "component_id")
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), "at")
    stays = found.join(keyed.select("at", "doc.doc_id"), "at").groupBy("component_id").agg(F.min(place).alias("place")).select("place.at")
    return keyed.join(stays, "at", "left_semi").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, row by row; null and empty texts, and texts shorter than every item, hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, row by row, with personal data masked by its kind; a null text stays null, and n_chars follows the text."""
    return mask_personal_data(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids, their number and the digests of ids and decoded text; a null text is an empty one."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: Trees, the field and the tokenizer can't be said in SQL: tests/llm holds the stages against brute force.
ORACLE_SQL = None
