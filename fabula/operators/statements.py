"""Statements by a closed lexicon of verbs, and cleaning of roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions.tokens import Cleaner, plain_tokens, shortened
from fabula.operators.sentences import split_sentences
from fabula.schema import TEXT_ROLES

#: Forms of "be" and "have"; languages without a list have no statements.
VERBS = {
    "en": ["is", "are", "was", "were", "be", "has", "have"],
    "fr": ["est", "sont", "était", "a", "ont"],
    "de": ["ist", "sind", "war", "waren", "hat", "haben", "wird"],
    "es": ["es", "son", "era", "eran", "está", "ha", "han", "tiene"],
}
NEGATIONS = ["not", "never", "ne", "pas", "nicht", "kein", "nie", "no", "nunca"]
#: A word from its first letter to its last; what has no letter is no word.
_WORD = r"[a-zà-ÿ](?:\S*[a-zà-ÿ])?"


def _among(col: str, listed: list[str]) -> Column:
    return F.transform(col, lambda x: x.isin(listed))


def lexicon_statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", only_triplets: bool = False) -> DataFrame:
    """A heuristic, not a parser: the first listed verb of a sentence splits it into agent and patient.

    Narrow, and fit for streams.  id, sent_id, arg0, verb, neg, mod, arg1, arg2."""
    known = docs.where(F.col(lang_col).isin(list(VERBS)))
    sents = split_sentences(known, id_col, text_col, keep=[lang_col])
    w = F.regexp_extract_all(F.lower("sentence"), F.lit(_WORD), 0)
    at: Column = F.lit(0)
    for lang, verbs in VERBS.items():
        at = F.when(F.col(lang_col) == lang, F.array_position(_among("w", verbs), True)).otherwise(at)
    # An array of its own row by row: Spark would move the filter below the projection, and find all words twice.
    each = sents.select(id_col, "sent_id", lang_col, F.explode_outer(F.array(w)).alias("w"))
    found = each.withColumn("at", at.cast("int")).where("at > 0")
    out = found.select(
        id_col,
        "sent_id",
        F.nullif(F.array_join(F.slice("w", 1, F.col("at") - 1), " "), F.lit("")).alias("arg0"),
        F.get("w", F.col("at") - 1).alias("verb"),
        F.when(F.exists("w", lambda x: x.isin(NEGATIONS)), F.lit(True)).alias("neg"),
        F.lit(None).cast("string").alias("mod"),
        F.nullif(F.array_join(F.slice("w", F.col("at") + 1, F.greatest(F.size("w"), F.lit(1))), " "), F.lit("")).alias("arg1"),
        F.lit(None).cast("string").alias("arg2"),
    )
    return out.where("arg0 is not null and arg1 is not null") if only_triplets else out


def process_roles(statements: DataFrame, cleaner: Cleaner | None = None, max_length: int | None = None, pos_tags: dict[str, list[str]] | None = None, tokens=None) -> DataFrame:
    """tokens: an annotator's function from text to a token array, else the built-in one.  Cleans the text roles (with a list of parts of speech each, if given); roles cleaned away are NULL, all rows stay."""
    cleaner = cleaner or Cleaner()

    def phrase(role: str) -> Column:
        tags = (pos_tags or {}).get(role)
        return cleaner.clean_text(F.col(role)) if tokens is None and tags is None else cleaner.clean((tokens or plain_tokens)(F.col(role)), tags)

    clean = {r: F.nullif(shortened(phrase(r), max_length), F.lit("")).alias(r) for r in TEXT_ROLES if r in statements.columns}
    return statements.select(*[clean.get(c, F.col(c)) for c in statements.columns])
