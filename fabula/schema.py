"""Schemas and fixed names.  A missing value is NULL everywhere; neg is TRUE or NULL."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_ROLES = ["arg0", "verb", "mod", "arg1", "arg2"]
ROLES = ["arg0", "verb", "neg", "mod", "arg1", "arg2"]
#: Role names in files, by column.
FILE_NAMES = {"arg0": "ARG0", "verb": "B-V", "neg": "B-ARGM-NEG", "mod": "B-ARGM-MOD", "arg1": "ARG1", "arg2": "ARG2"}
#: Entity labels that are mined by default.
ENTITY_LABELS = ["PERSON", "NORP", "ORG", "GPE", "EVENT"]

ROLE_TYPES = {r: (T.BooleanType() if r == "neg" else T.StringType()) for r in ROLES}
STATEMENT = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("sent_id", T.IntegerType()), T.StructField("stmt_id", T.IntegerType())]
    + [T.StructField(r, ROLE_TYPES[r]) for r in ROLES]
)
TOKEN = T.StructType(
    [T.StructField("i", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("text", "lower", "lemma", "pos", "dep")]
    + [T.StructField("head", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("ent", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("is_punct", "is_digit")]
    + [T.StructField("anc", T.ArrayType(T.IntegerType()))]
)
PARSE = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("verbs", T.ArrayType(T.StructType([T.StructField("tags", T.ArrayType(T.StringType()))]))),
    ]
)

# Models that are known by name, with language and size of their vectors.
MODELS = {
    "fasttext-wiki-news-subwords-300": ("english", 300),
    "word2vec-google-news-300": ("english", 300),
    "glove-wiki-gigaword-50": ("english", 50),
    "glove-wiki-gigaword-100": ("english", 100),
    "glove-wiki-gigaword-200": ("english", 200),
    "glove-wiki-gigaword-300": ("english", 300),
    "glove-twitter-25": ("english", 25),
    "glove-twitter-50": ("english", 50),
    "glove-twitter-100": ("english", 100),
    "glove-twitter-200": ("english", 200),
    "all-MiniLM-L6-v2": ("english", 384),
    "distiluse-base-multilingual-cased-v2": ("multilingual", 512),
    "whaleloops/phrase-bert": ("english", 768),
    "en_core_web_sm": ("english", 96),
    "en_core_web_md": ("english", 300),
    "en_core_web_lg": ("english", 300),
    "fr_core_news_sm": ("french", 96),
    "fr_core_news_md": ("french", 300),
    "fr_core_news_lg": ("french", 300),
}
