"""Corpus pipeline: toxicity, near duplicates, personal data, mixing and tokens, one stage after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before kept. All but the last return the columns of ``documents``.

Edge cases, in every stage: a null or empty text is a clean document without near copies, personal data,
words or tokens, and stays (the mix takes it with each whole epoch of its source); rows without an id, and unlike
rows under one id, are documents of their own; rows that repeat are near copies, of which one stays; further
columns pass through whatever their names, as helper columns take names that are free; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.llm import bpe, mixing, ngram_join, pii, toxicity
from edgewise.session import delete, shared_dir, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).filter("predicted = 0").select(*docs.columns)


#: Folders of tables that stages have stored; ``run`` deletes those of a stage once its result is written.
FOLDERS: list[str] = []


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` stored with a number of its own for each row, as ids may be null or repeat, and the name of that column."""
    name = "row"
    while name in docs.columns:
        name = "_" + name
    FOLDERS.append(f"{shared_dir(docs.sparkSession)}/rows-{uuid.uuid4().hex}")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), FOLDERS[-1]), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id, of rows with one id the first by a digest of the text.

    Ids say nothing about likeness: rows without an id and unlike rows that share one stay.
    """
    rows, row = numbered(docs)
    classes = ngram_join.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("of"), F.col("class_id").alias("class"))
    ranks = rows.select(F.col(row).alias("of"), F.struct(F.col("doc_id").isNull(), "doc_id", F.md5("text"), F.col(row).alias("of")).alias("rank"))
    kept = classes.join(ranks, "of").groupBy("class").agg(F.min("rank").alias("first")).select(F.col("first.of").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return pii.redact(docs).withColumn("n_chars", length).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix begins them, whole ones only."""
    rows, row = numbered(docs)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "epochs"))
    taken = mixing.mix(rows, whole_documents=True, row_col=row).filter("epochs > 0").select(row, each.alias("each")).select(row)
    return rows.join(taken, row).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding the ids gives the bytes of the text again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode_checked(docs.select("doc_id", "source", "text"), path, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again, and goes once the next one is written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        FOLDERS.clear()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        for path in [*before, *FOLDERS]:
            delete(spark, path)
        before = [f"{folder}/{name}"]
    return docs


#: The toxicity stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None
