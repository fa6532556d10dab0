"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative; one linear scan finds
the contiguous region of the largest sum.  All weights are learned from labelled pages.  A word's is the
share of main text among the words in elements with its features (names such as nav or footer, classes,
ids, roles): the least of the elements around it, 1 where nothing is known.  A tag's is learned by a
structured perceptron: where the best region is not the labelled one, the tags that only one of the two
has are moved.  Inside an element whose share is below LEAST_SHARE tags cost nothing, so that an advert
in the middle of an article doesn't break it, and the region is read without its words.

The names below are where the shares start before any page is seen; they weigh as much as a few pages.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm._exchange import bounded_batches, result_first

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style title textarea noscript template iframe svg math object canvas noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that start as seldom main text.
LEAVE = RAW | frozenset("nav aside footer header form button select option datalist fieldset dialog menu menuitem head audio video map input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words in class or id names of elements that start as seldom main text.
LEAVE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond discussion share sharing social "
    "related recommended recommendations footer header masthead pagination pager toolbar login signin signup search widget skip".split()
)
#: Words that may stand beside those in a name; others (has-sidebar, search-results, social-science) make it another thing's name.
BESIDE = frozenset(
    "site page main global top bottom left right inner outer primary secondary mobile desktop list box block bar area section wrapper wrap container group item items "
    "link links post posts article articles story stories entry button buttons icon icons form thread slot unit panel content text title message".split()
)
#: Parts of tables cost little until learned otherwise, so that a table of short cells doesn't break the text around it.
TABLE = frozenset("table caption colgroup col thead tbody tfoot tr th td".split())
#: Main text seldom crosses these.
BORDER = frozenset("article main body html frameset".split())
#: Share below which an element's words are left out.
LEAST_SHARE = 0.5
#: Where shares start: of the names above, and of others; and how many pages that counts for.
SELDOM, USUAL, START_PAGES = 0.02, 1.0, 5
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def tokens(page: str) -> list[tuple]:
    """("text", raw), ("open", name, attributes) and ("close", name); the contents of raw elements are left out."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(("text", page[at:]))
            break
        if m.start() > at:
            out.append(("text", page[at : m.start()]))
        at = m.end()
        if m[2]:
            name = m[2].lower()
            if m[1]:
                out.append(("close", name))
            else:
                out.append(("open", name, m[3]))
                if name in RAW and not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
                    at = end.start() if end else n
    return out


def _leave_name(token: str) -> bool:
    parts = {w.lower() for w in _NAME_PART.findall(token)}
    return not parts.isdisjoint(LEAVE_NAMES) and parts <= LEAVE_NAMES | BESIDE


def features(name: str, attributes: str) -> list[tuple[str, bool]]:
    """What a word's weight may depend on in an element around it, and whether it starts as seldom main text.

    Only names that say what an element is for count (nav, footer, ...), not those of its shape (div, ul, td, ...)."""
    out = [(name, True)] if name in LEAVE else []
    if not attributes or name in ("html", "body", "article", "main"):
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            out += [("." + token, _leave_name(token)) for token in value.split()]
        elif key == "role":
            out.append(("role=" + value.lower(), value.lower() in ROLES))
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append(("hidden", True))
    return out


@dataclass
class Weights:
    """Of tags, by name with "/" before closing ones; 0 at most.  `other` is for names not learned.  Shares of main text by feature."""

    tag: dict[str, float] = field(default_factory=dict)
    other: float = -2.0
    share: dict[str, float] = field(default_factory=dict)

    def of(self, token: tuple, share: float) -> float:
        if token[0] == "text":
            return share * len(token[1].split())
        return 0.0 if share < LEAST_SHARE else self.tag.get(_tag(token), self.start(token[1]))

    def start(self, name: str) -> float:
        return -0.5 if name in INLINE else -0.1 if name in TABLE else -10.0 if name in BORDER else self.other

    def scores(self, page: list[tuple], shares: list[float]) -> list[float]:
        return [self.of(t, s) for t, s in zip(page, shares, strict=True)]

    def shares_of(self, found: list[tuple[str, bool]]) -> float:
        return min((self.share.get(f, SELDOM if seldom else USUAL) for f, seldom in found), default=1.0)


def _tag(token: tuple) -> str:
    return token[1] if token[0] == "open" else "/" + token[1]


def elements(page: list[tuple]) -> list[tuple[int, ...]]:
    """For each token the elements around it (its own included), as the places of their opening tags."""
    out: list[tuple[int, ...]] = []
    stack: list[str] = []
    around: tuple[int, ...] = ()
    for i, token in enumerate(page):
        if token[0] == "open":
            name = token[1]
            if name in _CLOSES_P and stack and stack[-1] == "p":
                stack.pop()
                around = around[:-1]
            if name == "li":
                at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j] in ("li", "ul", "ol", "menu")), -1)
                if at >= 0 and stack[at] == "li":
                    del stack[at:]
                    around = around[:at]
            if name not in VOID:
                stack.append(name)
                around = (*around, i)
        out.append(around)
        if token[0] == "close":
            at = next((j for j in range(len(stack) - 1, -1, -1) if stack[j] == token[1]), -1)
            if at >= 0:
                del stack[at:]
                around = around[:at]
    return out


def shares(page: list[tuple], weights: Weights) -> list[float]:
    """For each token the least share among the elements around it.

    Elements around the page's only article or main element count as main text, and if no word of the
    page would remain, class and id names do not count."""
    around = elements(page)
    only = [i for name in ("article", "main") if sum(t[:2] == ("open", name) for t in page) == 1 for i, t in enumerate(page) if t[:2] == ("open", name)]
    kept = {e for i in only for e in around[i]}
    found = {i: features(t[1], t[2]) for i, t in enumerate(page) if t[0] == "open" and t[1] not in VOID and (i not in kept or i in only)}
    out = _least(around, found, weights)
    if any(s < LEAST_SHARE for s in out) and not any(t[0] == "text" and s >= LEAST_SHARE and t[1].split() for t, s in zip(page, out, strict=True)):
        out = _least(around, {i: [f for f in fs if f[0][0] != "."] for i, fs in found.items()}, weights)
    return out


def _least(around: list[tuple[int, ...]], found: dict[int, list], weights: Weights) -> list[float]:
    own = {i: weights.shares_of(fs) for i, fs in found.items() if fs}
    cache: dict[tuple[int, ...], float] = {(): 1.0}
    out = []
    for places in around:
        if places not in cache:
            cache[places] = min((own[i] for i in places if i in own), default=1.0)
        out.append(cache[places])
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First of the shortest ranges [a, b) with the largest positive sum; (0, 0) if none is positive."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def labelled_region(page: list[tuple], shares: list[float]) -> tuple[int, int] | None:
    """Region of the words in a page's only article or main element; None if there are several or none, or no words."""
    for name in ("article", "main"):
        opens = [i for i, t in enumerate(page) if t[:2] == ("open", name)]
        closes = [i for i, t in enumerate(page) if t == ("close", name)]
        if len(opens) == 1 and len(closes) == 1 and opens[0] < closes[0]:
            texts = [i for i in range(opens[0], closes[0]) if page[i][0] == "text" and shares[i] >= LEAST_SHARE and page[i][1].split()]
            return (texts[0], texts[-1] + 1) if texts else None
    return None


def learn_shares(pages: list[list[tuple]]) -> dict[str, float]:
    """Of each feature: over the labelled pages that have it, the mean share of its words that are main text.

    What starts as seldom main text can only get rarer: a label is a whole element, adverts in it included."""
    start = Weights()
    inside: dict[str, float] = {}
    seen: dict[str, int] = {}
    seldom: dict[str, bool] = {}
    for page in pages:
        region = labelled_region(page, shares(page, start))
        if region is None:
            continue
        words: dict[str, list[int]] = {}
        for i, (token, places) in enumerate(zip(page, elements(page), strict=True)):
            if token[0] == "text":
                n = len(token[1].split())
                for f, rare in {f for e in places for f in features(page[e][1], page[e][2])}:
                    seldom[f] = rare
                    count = words.setdefault(f, [0, 0])
                    count[region[0] <= i < region[1]] += n
        for f, (out, within) in words.items():
            if out + within and not (seldom[f] and within):
                seen[f] = seen.get(f, 0) + 1
                inside[f] = inside.get(f, 0.0) + within / (out + within)
    return {f: (inside[f] + (SELDOM if seldom[f] else USUAL) * START_PAGES) / (n + START_PAGES) for f, n in seen.items()}


def learn(pages: list[str], rounds: int = 12, step: float = 1.0, least: float = -30.0) -> Weights:
    """Shares, then tags by a structured perceptron; their weights stay between `least` and a little under 0.

    Each page is tried with its own scores, and for a margin once more with labelled texts that count as
    0.7 words, whatever their length, so that a run of one-word blocks holds together."""
    found = [*map(tokens, pages)]
    weights = Weights(share=learn_shares(found))
    known = [(t, s, r) for t in found if (r := labelled_region(t, s := shares(t, weights))) is not None]
    for _ in range(rounds):
        wrong = 0
        for page, share, (a, b) in known:
            for margin in (False, True):
                scores = weights.scores(page, share)
                if margin:
                    scores[a:b] = [0.7 * w if t[0] == "text" and s > 0 else s for t, s, w in zip(page[a:b], scores[a:b], share[a:b], strict=True)]
                c, d = best_region(scores)
                if (a, b) == (c, d) or margin and (d <= a or b <= c):
                    continue
                wrong += 1
                change: dict[str, float] = {}
                for i in {*range(a, b)} ^ {*range(c, d)}:
                    if page[i][0] != "text" and share[i] >= LEAST_SHARE:
                        name = _tag(page[i])
                        change[name] = change.get(name, 0.0) + (step if a <= i < b else -step)
                for name, x in change.items():
                    x = max(-4 * step, min(4 * step, x))
                    weights.tag[name] = min(-0.1, max(least, weights.tag.get(name, weights.start(name.lstrip("/"))) + x))
        if not wrong:
            break
    return weights


def blocks(page: list[tuple], shares: list[float], region: tuple[int, int]) -> list[str]:
    """Texts of the blocks inside the region, without the elements that are seldom main text."""
    out, piece = [], []
    for i, token in enumerate(page):
        if token[0] == "text":
            if region[0] <= i < region[1] and shares[i] >= LEAST_SHARE:
                piece.append(token[1])
        elif token[1] == "br":
            piece.append(" ")
        elif token[1] not in INLINE:
            out.append(" ".join(html.unescape("".join(piece)).split()))
            piece = []
    out.append(" ".join(html.unescape("".join(piece)).split()))
    return [x for x in out if x]


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the main text, joined by an empty line; empty if the page has none."""
    seq = tokens(page)
    share = shares(seq, weights)
    return "\n\n".join(blocks(seq, share, best_region(weights.scores(seq, share))))


def fit(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", *, sample: int = 300) -> Weights:
    """Learns from at most `sample` pages (whose ids hash lowest; of rows with one id the least html) that mark their main text by one article or main element."""
    ids = pages.select(F.col(f"`{id_col}`").alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).join(F.broadcast(ids), "id")
    found = rows.groupBy("id").agg(F.min(F.coalesce("html", F.lit(""))).alias("html")).collect()
    return learn([r["html"] for r in sorted(found, key=lambda r: r["id"])])


def _extracted(weights: Weights, columns: int):
    def extracted(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(page or "", weights) for page in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:columns], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*part.schema.names[:columns], "text", "n_chars"])

    return extracted


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", *, carry: list[str] = ("page_id", "url")) -> DataFrame:
    """The carried columns, text and n_chars (code points) of each page.

    A null or empty page, and one without words, has an empty text.  Unclosed elements end with their
    parents, an unfinished tag at the end of a page is left out, pages of any length are read whole.  Of
    regions of equal weight the first of the shortest is read; a carried column named text or n_chars is left out."""
    bounded_batches(pages)
    carry = result_first(carry, ["text", "n_chars"])
    names = [f"c{i}" for i in range(len(carry))]
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{html_col}`").cast("string").alias("html"))
    schema = ", ".join([*(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True)), "text string", "n_chars long"])
    out = rows.mapInArrow(_extracted(weights, len(names)), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "text", "n_chars")
