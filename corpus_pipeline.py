"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns of
documents; the last returns tokens.  `run` writes each stage's rows as Parquet in the folder that the
cluster shares, so a lost executor never costs more than the stage that it worked on, and removes a
stage's rows when the next are written.

Defined cases.  Columns beside doc_id, text and n_chars pass through all but the last stage whatever
their names are.  A null or empty text has the quality of the share of good labels, is no copy, holds
nothing, and has no tokens.  A row with a null id is kept by the near-duplicate and benchmark stages
(unless the benchmark stage finds an item in it: it has no id to be dropped by) and loses every passage
that another id has.  Rows with one id are one document: both are kept or both go.  An empty table gives
an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm import quality
from fabula.llm._exchange import shared_folder
from fabula.llm.decontaminate import decontaminate
from fabula.llm.minhash import near_duplicates
from fabula.llm.queries import TOKENIZER
from fabula.llm.sentencepiece_wfst import encode
from fabula.llm.substring_dedup import substring_dedup

#: Documents that score less are rejected.
LEAST_QUALITY = 0.5
#: A run of so many words that an earlier document has is removed.
REPEAT_WORDS = 50


def plainly(stage):
    """The stage on documents whose columns beside id, text and length have names that clash with nothing."""

    def on_plain_names(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in ("doc_id", "text", "n_chars") else f"kept_column_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    on_plain_names.__doc__ = stage.__doc__
    return on_plain_names


@plainly
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that look like label 0.  The classifier learns from the stage's own input and the labels table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    return quality.score(docs, model, carry=docs.columns, score_col="quality_score").where(F.col("quality_score") >= LEAST_QUALITY).drop("quality_score")


@plainly
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of documents with 5-word shingle similarity 0.8 or more."""
    later = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(later, F.col("doc_id") == F.col("_later"), "left_anti")


@plainly
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller id has; documents of which nothing is left go."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup(docs, min_words=REPEAT_WORDS, carry=rest, keep_layout=True)
    cut = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*docs.columns)


@plainly
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids."""
    return encode(docs, TOKENIZER, carry=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", tokens),
]

#: SQL cannot express the classifier and the tokenizer; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return docs


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder wherever the session's file systems have it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
