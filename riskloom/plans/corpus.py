"""The given tables as corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literal_table
from ..sources.tables import as_corpus
from .seeds import NEAR_MISS_EVERY, SEEDS

PROJECT = "corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts as it is stored.

    A file of one row group is one task. Only where the session says so by
    ``spark.riskloom.inputPartitions``, as a local one does for its few small files, are the rows
    dealt out first.
    """
    rows = table(spark, sf_dir, name)
    parts = spark.conf.get("spark.riskloom.inputPartitions", None)
    return rows.repartition(int(parts)) if parts else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain text files, one scan per source."""
    docs = texts(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return as_corpus(docs, path=path, content=F.col("text"), scan_id=F.col("source"), keep=["doc_id"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as HTML files, one scan per host."""
    df = texts(spark, sf_dir, "pages")
    path = F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".html"))
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return as_corpus(df, path=path, content=F.col("html"), scan_id=host, keep=["page_id"])


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text files, one scan per role."""
    df = texts(spark, sf_dir, "conversations")
    path = F.concat_ws("/", F.lit("talk"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".txt")))
    return as_corpus(df, path=path, content=F.col("text"), scan_id=F.col("role"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a code seed after its text: a history of runs over one project.

    Run ``k`` holds one file per seed and the runs are an hour apart. A seed shows its near
    miss in some runs, so findings appear, stay and go. The seed is looked up in a literal
    array, so the corpus is one narrow projection of the documents.
    """
    return with_seeds(texts(spark, sf_dir, "documents"))


def with_seeds(docs: DataFrame, *keep: Column) -> DataFrame:
    """The seeded corpus of a table or stream of documents."""
    seeds = literal_table(
        [{"name": s.name, "positive": s.positive, "negative": s.negative} for s in SEEDS],
        "array<struct<name:string,positive:string,negative:string>>",
    )
    n = (F.col("doc_id") % len(SEEDS)).cast("int")
    k = F.floor(F.col("doc_id") / len(SEEDS)).cast("long")
    seed = F.get(seeds, n)
    missing = (k * 7 + n) % NEAR_MISS_EVERY == 0
    return as_corpus(
        docs,
        scan_id=F.concat(F.lit("run"), k.cast("string")),
        path=F.concat(F.lit("app/m"), n.cast("string"), F.lit("/"), seed["name"]),
        content=F.concat(F.col("text"), F.lit("\n"), F.when(missing, seed["negative"]).otherwise(seed["positive"])),
        keep=["doc_id", k.alias("run_no"), *keep],
    )


def seeded_scans(files: DataFrame) -> DataFrame:
    """One row per run of the seeded corpus."""
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return files.groupBy("scan_id").agg(
        F.count("*").alias("files_scanned"),
        F.timestamp_add("HOUR", F.max("run_no").cast("int"), start).alias("saved_at"),
    ).select(
        F.lit(PROJECT).alias("project"), "scan_id", F.lit("app").alias("target"), F.lit("").alias("profile"),
        "files_scanned", "saved_at",
    )
