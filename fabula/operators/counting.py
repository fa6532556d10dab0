"""Counts of words, role values and entities.  Each is one shuffle of partial counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions import text as X
from fabula.schema import ENTITY_LABELS


def count_words(sents: DataFrame, col: str = "sentence") -> DataFrame:
    return sents.select(F.explode(X.words(F.col(col))).alias("value")).groupBy("value").agg(F.count("*").alias("cnt"))


def count_values(statements: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """Values of the roles, pooled; no roles give an empty table."""
    if not roles:
        return statements.sparkSession.createDataFrame([], "value string, cnt bigint")
    values = F.array(*[F.col(r).cast("string") for r in roles])
    return statements.select(F.explode(values).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("cnt"))


def role_values(statements: DataFrame, role: str, keys: list[str]) -> DataFrame:
    """Keys and value of the statements that have the role."""
    return statements.where(F.col(role).isNotNull()).select(*keys, F.col(role).alias("value"))


def sif_weights(sents: DataFrame, alpha: float = 0.001, col: str = "sentence") -> DataFrame:
    """token, weight = alpha / (alpha + raw count); a token that isn't there weighs 1."""
    return count_words(sents, col).select(F.col("value").alias("token"), (F.lit(alpha) / (F.lit(alpha) + F.col("cnt"))).alias("weight"))


def capitalised_runs(sentence: Column) -> Column:
    """Entities of the built-in annotator: runs of capitalised words."""
    return F.regexp_extract_all(sentence, F.lit("[A-ZÀ-Þ][a-zà-ÿ]+(?: [A-ZÀ-Þ][a-zà-ÿ]+)*"), 0)


def mine_entities(sents: DataFrame, ents: Column | None = None, labels: list[str] = ENTITY_LABELS, cleaned=lambda text: text) -> DataFrame:
    """Counts of cleaned entities.  ents: array<struct<text, label>> of a real annotator; else capitalised runs."""
    if ents is None:
        found = sents.select(F.explode(capitalised_runs(F.col("sentence"))).alias("value"))
    else:
        found = sents.select(F.explode(ents).alias("e")).where(F.col("e.label").isin(labels)).select(F.col("e.text").alias("value"))
    return found.select(cleaned(F.col("value")).alias("value")).groupBy("value").agg(F.count("*").alias("cnt"))


def top_entities(counts: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent, then without the empty one; ties by name."""
    return counts.orderBy(F.desc("cnt"), "value").limit(n).where("value <> ''")
