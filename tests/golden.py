"""Sentences parsed by hand, and what the rules give for them."""

from pyspark.sql import DataFrame, SparkSession

# Index, text, part of speech, label, head; then the noun chunks by first token.
_PARSES = {
    "F1": ("Taxes/NOUN/nsubj/1 kill/VERB/ROOT/1 jobs/NOUN/dobj/1 and/CCONJ/cc/1 hinder/VERB/conj/1 innovation/NOUN/dobj/4 ./PUNCT/punct/1", {0: "Taxes", 2: "jobs", 5: "innovation"}),
    "F2": ("Jobs/NOUN/nsubjpass/2 were/AUX/auxpass/2 destroyed/VERB/ROOT/2 by/ADP/agent/2 taxes/NOUN/pobj/3 and/CCONJ/cc/4 tariffs/NOUN/conj/4 ./PUNCT/punct/2", {0: "Jobs", 4: "taxes", 6: "tariffs"}),
    "F3": ("The/DET/det/1 senator/NOUN/nsubj/5 who/PRON/nsubj/3 opposed/VERB/relcl/1 reform/NOUN/dobj/3 won/VERB/ROOT/5 votes/NOUN/dobj/5 ./PUNCT/punct/5", {1: "The senator", 2: "who", 4: "reform", 6: "votes"}),
    "F4": ("We/PRON/nsubj/3 do/AUX/aux/3 not/PART/neg/3 support/VERB/ROOT/3 tariffs/NOUN/dobj/3 ./PUNCT/punct/3", {0: "We", 4: "tariffs"}),
    "F6": ("Taxes/NOUN/nsubj/5 ,/PUNCT/punct/0 tariffs/NOUN/conj/0 and/CCONJ/cc/2 quotas/NOUN/conj/2 kill/VERB/ROOT/5 jobs/NOUN/dobj/5", {0: "Taxes", 2: "tariffs", 4: "quotas", 6: "jobs"}),
}
_PARSES_FR = {
    "F5": ("Le/DET/det/1 gouvernement/NOUN/nsubj/3 ne/ADV/advmod/3 soutient/VERB/ROOT/3 pas/ADV/advmod/3 les/DET/det/6 taxes/NOUN/obj/3", {1: "Le gouvernement", 6: "les taxes"}),
    "F7": ("Les/DET/det/1 taxes/NOUN/nsubj/7 que/PRON/obj/5 le/DET/det/4 gouvernement/NOUN/nsubj/5 soutient/VERB/acl:relcl/1 ne/ADV/advmod/7 tuent/VERB/ROOT/7 pas/ADV/advmod/7 emplois/NOUN/obj/7", {1: "Les taxes", 2: "que", 4: "le gouvernement", 9: "emplois"}),
    "F8": ("Les/DET/det/1 emplois/NOUN/nsubj:pass/3 sont/AUX/aux:pass/3 détruits/VERB/ROOT/3 par/ADP/case/5 taxes/NOUN/obl:agent/3", {1: "Les emplois", 5: "taxes"}),
}
_TOKENS = "i int, text string, pos string, dep string, head int, chunk string, anc array<int>"


def parsed(spark: SparkSession, french: bool = False) -> DataFrame:
    """s, tokens of the fixed sentences."""
    rows = []
    for name, (line, chunks) in (_PARSES_FR if french else _PARSES).items():
        toks = [t.rsplit("/", 3) for t in line.split(" ")]
        up = [int(t[3]) for t in toks]

        def path(i: int, up=up) -> list[int]:
            return [i] if up[i] == i else [i, *path(up[i])]

        rows.append((name, [(i, t[0], t[1], t[2], up[i], chunks.get(i), path(i)) for i, t in enumerate(toks)]))
    return spark.createDataFrame(rows, f"s string, tokens array<struct<{_TOKENS.replace(' ', ':').replace(',:', ', ')}>>")


EN = [
    ("F1", "Taxes", None, "kill", "jobs"), ("F2", "taxes", None, "destroyed", "Jobs"), ("F2", "tariffs", None, "destroyed", "Jobs"), ("F3", "The senator", None, "opposed", "reform"),
    ("F3", "The senator", None, "won", "votes"), ("F4", "We", True, "support", "tariffs"), ("F6", "Taxes", None, "kill", "jobs"), ("F6", "tariffs", None, "kill", "jobs"), ("F6", "quotas", None, "kill", "jobs"),
]
FR = [("F5", "Le gouvernement", True, "soutient", "les taxes"), ("F7", "le gouvernement", None, "soutient", "Les taxes"), ("F7", "Les taxes", True, "tuent", "emplois"), ("F8", "taxes", None, "détruits", "Les emplois")]
SRL = [
    ("R-1", "Taxes do not kill jobs", ["B-ARG0 O B-ARGM-NEG B-V B-ARG1"]),
    ("R-2", "Taxes do not kill jobs", ["O O O B-V B-ARG1"]),
    ("R-3", "They may give us time", ["B-ARG0 B-ARGM-MOD B-V B-ARG2 B-ARG1"]),
    ("R-4", "Reform , he said , failed", ["B-ARG1 O B-ARG0 B-V O C-ARG1"]),
    ("R-5", "", []),
]
