"""Verb normalisation by lexicon tables (verb, pos, candidate); pos is the order of a verb's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A small lexicon of our own; larger ones are tables of the same shape.
SYNONYMS = {"is": ["be", "exist"], "are": ["be", "exist"], "was": ["were", "be"], "has": ["have", "own"], "have": ["has", "own"], "est": ["sont", "était"]}
ANTONYMS = {"is": ["lacks"], "has": ["lacks"], "have": ["lack", "be"], "was": ["is"], "est": ["a"]}


def lexicon(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    """Table of a dictionary; candidates keep their order and repetitions."""
    return spark.createDataFrame([(v, i, c) for v, cs in entries.items() for i, c in enumerate(cs)], "verb string, pos int, candidate string")


def lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    """Such a table from Parquet, or from CSV with a header."""
    found = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    return found.select(F.col("verb").cast("string"), F.col("pos").cast("int"), F.col("candidate").cast("string"))


def wordnet_lexicons(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Synonyms and antonyms of verbs from a WordNet database folder (index.verb and data.verb, format wndb(5)).

    Synonyms are the words of all of a verb's synsets in order; antonyms those that its own words point to.
    The two files are read by the driver (about 4 MB); underscores become spaces."""
    lines = {n: [r[0] for r in spark.read.text(f"{folder}/{n}.verb").collect() if not r[0].startswith("  ")] for n in ("index", "data")}
    words: dict[str, list[str]] = {}
    opposites: dict[tuple[str, int], list[tuple[str, int]]] = {}
    for line in lines["data"]:
        f = line.split(" | ")[0].split()
        n = int(f[3], 16)
        words[f[0]] = [w.replace("_", " ") for w in f[4 : 4 + 2 * n : 2]]
        at = 4 + 2 * n
        for k in range(int(f[at])):
            kind, to, pos, ends = f[at + 1 + 4 * k : at + 5 + 4 * k]
            if kind == "!" and pos == "v":
                opposites.setdefault((f[0], int(ends[:2], 16)), []).append((to, int(ends[2:], 16)))
    same, other = {}, {}
    for line in lines["index"]:
        f = line.split()
        verb, synsets = f[0].replace("_", " "), f[6 + int(f[3]) :]
        same[verb] = [w for s in synsets for w in words[s]]
        other[verb] = [words[to][i - 1] for s in synsets for nth, w in enumerate(words[s], 1) if w.lower() == verb for to, i in opposites.get((s, nth), [])]
    return lexicon(spark, same), lexicon(spark, other)


def most_frequent(candidates: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """key and its candidate of the largest count, the first of equals; candidates never seen don't count."""
    seen = candidates.join(counts, candidates["candidate"] == counts["value"])
    return seen.groupBy(key).agg(F.max_by("candidate", F.struct("cnt", -F.col("pos"))).alias("best"))


def clean_verbs(statements: DataFrame, verb_counts: DataFrame, synonyms: DataFrame, antonyms: DataFrame, suffix: str = "_lowdim") -> DataFrame:
    """Adds verb<suffix> and neg<suffix>: a negated verb becomes its most frequent antonym and loses the
    negation, if it has a counted one; another becomes the most frequent of its synonyms and itself.

    The best candidates are found once for each distinct verb, then joined back (one row a verb)."""
    verbs = statements.select("verb").where("verb is not null").distinct()
    itself = verbs.select("verb", F.lit(2**31 - 1).alias("pos"), F.col("verb").alias("candidate"))
    alike = synonyms.join(verbs, "verb", "left_semi").select("verb", "pos", "candidate").union(itself)
    same = most_frequent(alike, verb_counts, "verb").withColumnRenamed("best", "_same")
    opposite = most_frequent(antonyms.join(verbs, "verb", "left_semi"), verb_counts, "verb").withColumnRenamed("best", "_opposite")
    both = statements.join(same, "verb", "left").join(opposite, "verb", "left")
    turned = F.col("neg").isNotNull() & F.col("_opposite").isNotNull()
    verb = F.when(F.col("neg").isNotNull(), F.coalesce("_opposite", "verb")).otherwise(F.coalesce("_same", "verb"))
    return both.select(*statements.columns, verb.alias(f"verb{suffix}"), F.when(~turned, F.col("neg")).alias(f"neg{suffix}"))
