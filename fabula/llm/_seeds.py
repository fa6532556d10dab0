"""Winnowed seeds of a text, and the rounds that find which of them documents share.

A window is `span` consecutive units (words or bytes) of one document.  Its seed is the place of the
smallest hash among the `k`-grams inside it, the leftmost of equals; so windows of equal content have
seeds of equal content in equal places.  A zone is a run of windows with one seed.  Content is only
worth comparing where the seed's k-gram occurs in two documents; two message rounds find those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fabula.llm import _exchange as X
from fabula.llm import _grams as G

#: Of a zone (its key) the windows that go, as bits.
VERDICT = np.dtype([("key", "<u8"), ("bits", "<u8")])
_PLACE = np.uint64((1 << 24) - 1)
#: A seed that more chunks than this have is hot, or one of which more chunks than the second number have so many zones.
HOT_CHUNKS, HOT_MANY, MANY_ZONES = 4096, 16, 256
_MARKS = np.uint64(3)


@dataclass(frozen=True)
class Shape:
    """Unit ("words" or "bytes"), window length and seed length in units."""

    unit: str
    span: int
    k: int

    @property
    def seed_shifts(self) -> list[int]:
        return list(range(self.k)) if self.unit == "words" else _byte_shifts(self.k)

    @property
    def span_shifts(self) -> list[int]:
        return list(range(self.span)) if self.unit == "words" else _byte_shifts(self.span)


def _byte_shifts(n: int) -> list[int]:
    """Places of 8-byte loads that cover n bytes."""
    return [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]


@dataclass
class Zones:
    """Of some documents: unit hashes, first unit of each document, and the zones by seed, first and last window."""

    unit: np.ndarray
    first: np.ndarray
    spans: tuple[np.ndarray, np.ndarray] | None
    seed: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray
    hash: np.ndarray  # of the seed's k-gram

    def take(self, keep: np.ndarray) -> Zones:
        return Zones(self.unit, self.first, self.spans, self.seed[keep], self.lo[keep], self.hi[keep], self.doc[keep], self.hash[keep])

    def keys(self, shape: Shape) -> np.ndarray:
        """A hash of the zone's content and extent: first and last window overlap, so they hold all of it."""
        a = G.multilinear_at(self.unit, self.lo, shape.span_shifts, 64)
        b = G.multilinear_at(self.unit, self.hi, shape.span_shifts, 64)
        return G.mix(a * np.uint64(3) + b * np.uint64(5) + (self.hi - self.lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def release(self, shape: Shape) -> np.ndarray:
        """The keys; the unit hashes (8 bytes a unit) go, for callers that hold many zones."""
        keys = self.keys(shape)
        self.unit = self.unit[:0].copy()
        return keys


def zones(buf: np.ndarray, off: np.ndarray, shape: Shape) -> Zones:
    spans = None
    if shape.unit == "words":
        starts, ends, doc = G.words(buf, off)
        spans = (starts, ends)
        unit, n = G.word_hashes(buf, starts, ends), len(starts)
        first = np.searchsorted(doc, np.arange(len(off)))
    else:
        n, first = len(buf), off
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        unit = np.ndarray((max(0, n - 7),), dtype="<u8", buffer=np.ascontiguousarray(buf), strides=(1,)).astype(G.U64) if n >= 8 else np.empty(0, G.U64)
    empty = np.empty(0, np.int64)
    windows = n - shape.span + 1
    if windows <= 0:
        return Zones(unit, first, spans, empty, empty, empty, empty, np.empty(0, G.U64))
    grams = G.multilinear(unit, n - shape.k + 1, shape.seed_shifts, 0)
    if n > int(_PLACE):
        place = _long_minima(grams, shape.span - shape.k + 1)
    else:
        place = (G.sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=G.U64), shape.span - shape.k + 1) & _PLACE).astype(np.int64)
    valid = doc[:windows] == doc[shape.span - 1 :]
    change = np.empty(windows, bool)
    change[0] = True
    change[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
    lo = np.flatnonzero(valid & change)
    ends_here = np.empty(windows, bool)
    ends_here[-1] = True
    ends_here[:-1] = change[1:] | ~valid[1:]
    hi = np.flatnonzero(valid & ends_here)
    seed = place[lo]
    return Zones(unit, first, spans, seed, lo, hi, doc[lo], grams[seed])


def _long_minima(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the minima for a document beyond 2**24 units, in overlapping pieces."""
    out, step = [], 1 << 22
    for a in range(0, len(grams) - w + 1, step):
        part = grams[a : a + step + w - 1]
        out.append((G.sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=G.U64), w) & _PLACE).astype(np.int64) + a)
    return np.concatenate(out)


def each_slice(table: pa.Table, shape: Shape):
    """(first document, last document, bytes, offsets, zones) for the slices of a chunk."""
    buf, off = G.text_buffer(table["text"])
    for a, b in G.slices(off, X.SLICE_BYTES):
        part, at = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        yield a, b, part, at, zones(part, at, shape)


def _announce(shape: Shape, buckets: int):
    def announce(key, table):
        """Each distinct seed of the chunk, with marks in the lowest bits: that two ids have it, and that many zones do."""
        ids = X.ids_of(table)
        hashes, owners = [], []
        for a, _, _, _, z in each_slice(table, shape):
            hashes.append(z.hash)
            owners.append(ids[a + z.doc])
        h, owner = np.concatenate([*hashes, np.empty(0, G.U64)]), np.concatenate([*owners, np.empty(0, np.int64)])
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        start = np.flatnonzero(np.r_[True, (h[1:] ^ h[:-1]) > _MARKS]) if len(h) else np.empty(0, np.int64)
        if len(start) == 0:
            return X.messages([], 0, [])
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        many = np.diff(np.r_[start, len(h)]) >= MANY_ZONES
        body = (h[start] & ~_MARKS) | several | many.astype(np.uint64) << np.uint64(1)
        order, parts = X.split_by(_bucket(body, buckets))
        body = body[order]
        return X.messages([k for k, _, _ in parts], key[0].as_py(), [body[a:b].tobytes() for _, a, b in parts])

    return X.tidied(announce)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _match(hot_chunks: int):
    def match(key, table):
        return _matched(key, table, hot_chunks)

    return match


def _matched(key, table, hot_chunks: int):
    """Tells each chunk which of its seeds another chunk, or a second document of its own, has as well; hot ones have the lowest bit set."""
    bodies = [np.frombuffer(x, dtype=G.U64) for x in table["body"].to_pylist()]
    if not bodies:
        return X.messages([], 0, [])
    h = np.concatenate(bodies)
    lens = np.array([len(x) for x in bodies])
    seed = h & ~_MARKS
    order = np.argsort(seed)
    start = np.flatnonzero(np.r_[True, seed[order][1:] != seed[order][:-1]])
    count = np.diff(np.r_[start, len(h)])
    shared = (count > 1) | np.maximum.reduceat((h & np.uint64(1))[order], start).astype(bool)
    flag = np.empty(len(h), bool)
    flag[order] = np.repeat(shared, count)
    marked = np.empty_like(seed)
    many = np.add.reduceat((h >> np.uint64(1) & np.uint64(1))[order], start)
    hot = (count > hot_chunks) | (many > min(hot_chunks, HOT_MANY))
    marked[order] = seed[order] | np.repeat(hot, count).astype(np.uint64)
    at = np.r_[0, np.cumsum(lens)]
    back = [(int(c), marked[a:b][flag[a:b]].tobytes()) for c, a, b in zip(table["src"].to_pylist(), at[:-1], at[1:], strict=True)]
    back = [(c, x) for c, x in back if x]
    return X.messages([c for c, _ in back], key[0].as_py(), [x for _, x in back])


def shared_seeds(chunks: DataFrame, shape: Shape, buckets: int, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """Messages to the chunks: the seeds of theirs that a second document has, with a mark on hot ones."""
    return chunks.groupBy("chunk").applyInArrow(_announce(shape, buckets), X.MESSAGE).groupBy("dest").applyInArrow(_match(hot_chunks), X.MESSAGE)


def known(table: pa.Table) -> np.ndarray:
    """The seeds in messages from shared_seeds, sorted."""
    return np.sort(_marked(table) & ~np.uint64(1))


def hot(table: pa.Table) -> np.ndarray:
    """Those of them that very many chunks have, sorted."""
    found = _marked(table)
    return np.sort(found[found & np.uint64(1) == 1] & ~np.uint64(1))


def _marked(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, G.U64), *[np.frombuffer(x, dtype=G.U64) for x in table["body"].to_pylist()]])


def among(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = h & ~_MARKS
    if len(seeds) == 0:
        return np.zeros(len(h), bool)
    at = np.searchsorted(seeds, h)
    at[at == len(seeds)] = 0
    return seeds[at] == h


def distinct(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One place of each distinct key, in order of the keys; the key of each; the smallest owner of each."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    start = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    least = np.minimum.reduceat(owner[order], start) if len(start) else np.empty(0, np.int64)
    return order[start], sorted_keys[start], least


def flagged(z: Zones, keys: np.ndarray, owner: np.ndarray, verdict_keys: np.ndarray, verdict_bits: np.ndarray, local_keys: np.ndarray, local_least: np.ndarray) -> np.ndarray:
    """Windows (places of first units) that a document with a smaller id has too.

    A zone whose content a smaller id in the same chunk has too goes whole; for the smallest holder
    in the chunk the buckets' verdict says which windows go."""
    lens = z.hi - z.lo + 1
    places = G.expand(z.lo, lens)
    nth = places - np.repeat(z.lo, lens)
    later = owner > local_least[np.searchsorted(local_keys, keys)] if len(keys) else np.zeros(0, bool)
    bits = np.zeros(len(keys), np.uint64)
    if len(verdict_keys) and len(keys):
        at = np.searchsorted(verdict_keys, keys)
        at[at == len(verdict_keys)] = 0
        hit = verdict_keys[at] == keys
        bits[hit] = verdict_bits[at[hit]]
    bits[later] = np.uint64(2**64 - 1)
    return places[(np.repeat(bits, lens) >> nth.astype(np.uint64)) & np.uint64(1) == 1]


def one_each(verdict: np.ndarray) -> np.ndarray:
    """The verdicts in order of their keys, those of one key joined."""
    verdict = verdict[np.argsort(verdict["key"], kind="stable")]
    if len(verdict) == 0:
        return verdict
    start = np.flatnonzero(np.r_[True, verdict["key"][1:] != verdict["key"][:-1]])
    out = verdict[start]
    out["bits"] = np.bitwise_or.reduceat(verdict["bits"], start)
    return out


def covered(windows: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of n units some window covers."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, windows, 1)
    np.subtract.at(mark, np.minimum(windows + span, n), 1)
    return np.cumsum(mark[:-1]) > 0
