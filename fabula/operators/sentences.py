"""Documents to sentences, limits and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabula.functions import text as X


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), splitter: Callable | None = None) -> DataFrame:
    """id, kept columns, sent_id (from 0), sentence.  Narrow: no shuffle.

    splitter(texts: list[str]) -> list[list[str]] replaces the built-in rule, by Arrow batches."""
    if splitter is None:
        return docs.select(id_col, *keep, F.posexplode(X.sentences(F.col(text_col))).alias("sent_id", "sentence"))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in [id_col, *keep]}

    def run(frames):
        for f in frames:
            f["sentence"] = splitter(f.pop(text_col).tolist())
            f["sent_id"] = f["sentence"].map(lambda s: list(range(len(s))))
            yield f.explode(["sentence", "sent_id"]).dropna(subset=["sentence"])[[*kinds, "sent_id", "sentence"]]

    return docs.select(*kinds, text_col).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", sent_id int, sentence string")


def replace_sentences(sents: DataFrame, max_chars: int | None = None, max_words: int | None = None) -> DataFrame:
    """Blanks sentences beyond the limits; the number of rows stays."""
    return sents.withColumn("sentence", X.limited(F.col("sentence"), max_chars, max_words))


def batches_fixed(sents: DataFrame, batch_size: int, id_col: str = "doc_id", *, whole: bool = False) -> DataFrame:
    """batch_id: so many sentences of a document each.  whole: all sentences that split_sentences gave are there, so sent_id is their number and nothing is shuffled."""
    if whole:
        return sents.withColumn("batch_id", F.floor(F.col("sent_id") / batch_size).cast("int"))
    return sents.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(id_col).orderBy("sent_id")) - 1) / batch_size).cast("int"))


def batches_by_chars(docs: DataFrame, max_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences with batch_id: filled greedily up to max_chars characters; longer sentences are blank.  Narrow: a fold over each document's sentences."""
    blanked = F.transform(X.sentences(F.col(text_col)), lambda s: X.limited(s, max_chars))
    both = docs.select(id_col, blanked.alias("s")).select(id_col, F.arrays_zip("s", X.batch_numbers(F.col("s"), max_chars).alias("b")).alias("z"))
    return both.select(id_col, F.posexplode("z").alias("sent_id", "z")).select(id_col, "sent_id", F.col("z.s").alias("sentence"), F.col("z.b").alias("batch_id"))
