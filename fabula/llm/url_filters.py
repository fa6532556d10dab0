"""URL filter: host and path rules, then a weighted vocabulary.

An Aho-Corasick machine finds all terms of the vocabulary in one pass over the URL; a hit counts where
no letter or digit touches it on either side.  One strict term, or `soft_hits` distinct soft ones,
block a URL for which no rule speaks.  The machine is built from the terms in each worker; they are a
parameter, and don't grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabula.llm._exchange import result_first

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: A URL with one of these is blocked.
STRICT = ("adult", "bets", "casino", "escort", "gambling", "hentai", "malware", "phishing", "pills", "poker", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
#: A URL with two of these is blocked.
SOFT = ("ads", "bet", "bonus", "cheap", "click", "coupon", "discount", "farm", "free", "jackpot", "loan", "nude", "promo", "seo", "track", "tracker", "win", "x")


@dataclass(frozen=True)
class Rule:
    """Speaks for its host and all subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    return host.translate(_LOWER), path


def longest_rule(host: str, path: str, rules: dict[str, list[Rule]]) -> Rule | None:
    """Of the rules (by host) that fit, the longest; of equals the one with the longer host."""
    best, at = None, 0
    while host:
        for rule in rules.get(host[at:], ()):
            if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                best = rule
        at = host.find(".", at) + 1
        if at == 0:
            return best
    return None


def terms_in(url: str, machine) -> set[str]:
    """Terms of the vocabulary in a lower-cased URL, with no letter or digit beside them."""
    found = set()
    for end, term in machine.iter(url):
        begin = end - len(term)
        if (begin < 0 or url[begin] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            found.add(term)
    return found


def _judged(rules: list[Rule], strict: frozenset, soft: frozenset, soft_hits: int):
    def judged(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term in strict | soft:
            machine.add_word(term, term)
        machine.make_automaton()
        by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            by_host.setdefault(rule.host, []).append(rule)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url in batch["url"].to_pylist():
                host, path = split_url(url)
                rule = longest_rule(host, path, by_host)
                hits = terms_in((url or "").translate(_LOWER), machine) if len(machine) else set()
                hard, mild = sorted(hits & strict), sorted(hits & soft)
                verdict = rule.verdict if rule else "block" if hard or len(mild) >= soft_hits else "allow"
                for o, x in zip(out, (host, path, rule.name if rule else None, verdict, hard, mild), strict=True):
                    o.append(x)
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], [*batch.schema.names[:-1], "host", "path", "rule", "verdict", "strict_terms", "soft_terms"])

    return judged


def url_filter(
    df: DataFrame, url_col: str = "url", *, rules: list[Rule] = (), strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_hits: int = 2, carry: list[str] = ("page_id",)
) -> DataFrame:
    """The carried columns, host, path, rule, verdict ("allow" or "block"), strict_terms and soft_terms found.

    Terms are compared with A-Z lower-cased, and count in the whole URL.  A null URL, or one without
    "://", has an empty host and path, fits no rule and is judged by its terms alone (a null: allow).
    A carried column with the name of a result column is left out.
    """
    carry = result_first(carry, ["host", "path", "rule", "verdict", "strict_terms", "soft_terms"])
    names = [f"c{i}" for i in range(len(carry))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{url_col}`").cast("string").alias("url"))
    schema = T.StructType(
        [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, carry, strict=True)]
        + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
        + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("strict_terms", "soft_terms")]
    )
    lower = lambda terms: frozenset(t.translate(_LOWER) for t in terms if t)
    out = rows.mapInArrow(_judged(list(rules), lower(strict), lower(soft), soft_hits), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], *out.columns[len(names) :])
