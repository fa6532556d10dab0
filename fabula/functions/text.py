"""Texts: words, sentences, limits, batches, subset test, printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fabula.schema import ROLES


def words(text: Column) -> Column:
    """Words between white space, as they stand."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Runs up to a group of `.`, `!` or `?`, with white space squeezed; a tail without one counts too."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(r"[^.!?]+[.!?]*"), 0)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def limited(sentence: Column, max_chars: int | None = None, max_words: int | None = None) -> Column:
    """Blank where the sentence has more characters, or else more words, than allowed; None is no limit."""
    for limit in (max_chars, max_words):
        if limit is not None and limit < 0:
            raise ValueError("limits must not be negative")
    out = sentence
    if max_chars is not None:
        out = F.when(F.length(out) > max_chars, F.lit("")).otherwise(out)
    if max_words is not None:
        out = F.when(F.size(words(out)) > max_words, F.lit("")).otherwise(out)
    return out


def batch_numbers(texts: Column, max_chars: int | None = None, batch_size: int | None = None) -> Column:
    """Batch of each text of an array in order: greedily by characters, or so many texts each, or all in one.

    Texts longer than max_chars must be blank before (see `limited`)."""
    if max_chars is not None and batch_size is not None:
        raise ValueError("give max_chars or batch_size, not both")
    if batch_size is not None:
        return F.transform(texts, lambda _, i: F.floor(i / batch_size).cast("int"))
    if max_chars is None:
        return F.transform(texts, lambda _: F.lit(0))
    # The fold keeps where batches begin, and is written out at the end, so that it grows by a number for each batch only.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("run"), F.array(F.lit(0)).alias("begins"))

    def step(acc: Column, text: Column) -> Column:
        full = acc["run"] + F.length(text) > max_chars
        run = F.when(full, F.length(text)).otherwise(acc["run"] + F.length(text))
        begins = F.when(full, F.concat(acc["begins"], F.array(acc["n"]))).otherwise(acc["begins"])
        return F.struct((acc["n"] + 1).alias("n"), run.alias("run"), begins.alias("begins"))

    def written(acc: Column) -> Column:
        ends = lambda b, i: F.coalesce(F.get(acc["begins"], i + 1), acc["n"])
        return F.flatten(F.transform(acc["begins"], lambda b, i: F.array_repeat(i, (ends(b, i) - b).cast("int"))))

    return F.aggregate(texts, start, step, written)


def is_subset(a: Column, b: Column) -> Column:
    """Every element of a is in b; order and repetition don't matter, an empty a is in everything."""
    return F.size(F.array_except(a, b)) == 0


def element(role: Column) -> Column:
    """The role, or the empty string."""
    return F.coalesce(role.cast("string"), F.lit(""))


def pretty(roles: dict[str, Column] | None = None) -> Column:
    """A statement as text: agent, modal, `!` if negated, verb, patient, attribute, by one space."""
    c = roles or {r: F.col(r) for r in ROLES}
    parts = [c["arg0"], c["mod"], F.when(c["neg"], F.lit("!")), c["verb"], c["arg1"], c["arg2"]]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
