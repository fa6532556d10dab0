"""Statements from semantic-role-label parses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.operators.annotate import annotated
from fabula.schema import FILE_NAMES, PARSE, ROLES


def annotate(sents: DataFrame, model: Callable, keys: list[str], max_chars: int | None = None, max_words: int | None = None, batch_size: int = 64) -> DataFrame:
    """keys and parse of each sentence; model(list[str]) -> list of {"words", "verbs": [{"tags"}]}.  See `annotated` for limits and failures."""
    return annotated(sents, model, keys, "parse", PARSE, {"words": [], "verbs": []}, max_chars=max_chars, max_words=max_words, batch_size=batch_size)


@dataclass(frozen=True)
class RoleLabeller:
    """A model with its limits; a call may give others."""

    model: Callable
    max_chars: int | None = None
    max_words: int | None = None
    batch_size: int = 64

    def __call__(self, sents: DataFrame, keys: list[str], **limits) -> DataFrame:
        used = {"max_chars": self.max_chars, "max_words": self.max_words, "batch_size": self.batch_size} | limits
        return annotate(sents, self.model, keys, **used)


def _words_of(parse: Column, tags: Column, name: str) -> Column:
    hits = F.filter(F.arrays_zip(parse["words"].alias("w"), tags.alias("t")), lambda z: F.contains(z["t"], F.lit(name)))
    return F.nullif(F.array_join(F.transform(hits, lambda z: z["w"]), " "), F.lit(""))


def extract_roles(parses: DataFrame, keys: list[str], used_roles: list[str] = ROLES, only_triplets: bool = False) -> DataFrame:
    """One row for each verb frame: a role is the words whose tag holds the role's name, so continuations count.  Narrow."""
    frames = parses.select(*keys, "parse", F.posexplode("parse.verbs").alias("stmt_id", "frame"))
    tags = F.col("frame.tags")
    role = {}
    for r in ROLES:
        if r not in used_roles:
            role[r] = F.lit(None).cast("boolean" if r == "neg" else "string")
        elif r == "neg":
            role[r] = F.when(F.exists(tags, lambda t: F.contains(t, F.lit(FILE_NAMES["neg"]))), F.lit(True))
        else:
            role[r] = _words_of(F.col("parse"), tags, FILE_NAMES[r])
    out = frames.select(*keys, "stmt_id", *[role[r].alias(r) for r in ROLES])
    return out.where("arg0 is not null and verb is not null and (arg1 is not null or arg2 is not null)") if only_triplets else out
