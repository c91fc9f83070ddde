"""A training-data pipeline over ``documents``: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, minhash, packing, quality_model, secret_scan
from riskloom.llm.common import materialize
from riskloom.llm.queries import QUALITY_THRESHOLD, quality_training, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; all, where no labels could be learned from.

    Rows are judged one by one by their text, a null text as an empty one, whatever their id.
    """
    model = quality_model.train(docs, quality_training(spark, sf_dir))
    return quality_model.keep_quality(docs, model, QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays, a null one only if there is no other. Rows that repeat id and text become
    one; rows whose text is null or holds no word are in no group and all stay.
    """
    return minhash.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of five words or more; shorter ones stand in too many clean texts.

    Null and empty texts hold none; rows are judged one by one and keep their columns.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), drop_words=decontaminate.MIN_WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and lengths to match.

    A null text stays null, with a null length; a table without lengths gets none.
    """
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences that need no padding; a null text is an empty one, every row a document of its own."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # trained scores and token ids are beyond SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
