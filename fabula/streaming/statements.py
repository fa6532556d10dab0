"""Statements of a stream of documents, and running counts of role values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fabula.functions.text import pretty
from fabula.operators.counting import count_values
from fabula.operators.statements import lexicon_statements

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("text", "lang", "source")], T.StructField("n_chars", T.LongType())])


def read_documents(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files of documents as they come into a folder."""
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def statement_stream(docs: DataFrame) -> DataFrame:
    """Stateless: the same operator as for tables."""
    return lexicon_statements(docs).withColumn("text", pretty())


def role_count_stream(docs: DataFrame, roles: list[str]) -> DataFrame:
    """Counts of the roles' values so far; use output mode update or complete."""
    return count_values(lexicon_statements(docs), roles)
