"""Substring dedup by seed and extend.

Documents meet on winnowed anchors (5-word seeds for the 13-word default).  Around each anchor that
two documents share, the match is extended to both sides: every window of `min_words` words that
holds the anchor is compared, for each number of words left of it, by anchor and window hash
(2 x 64 bits).  Windows that a smaller id has too are joined to maximal repeats, which are removed.

Cost at scale: the text is shuffled once (its exchange serves all three rounds).  Anchors are about
a fifth of the words, sent as 8 bytes and distinct in a chunk; windows are sent only around shared
anchors, distinct in a chunk.  No pairs of documents are made, so a group of a million copies costs
what a million other documents cost.  An anchor of very many chunks, or very many places in
several, such as a common phrase in ever other surroundings, is hot: its windows go to buckets one by one, by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabula.llm import _exchange as X
from fabula.llm import _grams as G
from fabula.llm import _seeds as S

#: What a message about zones holds of each: seed hash, smallest id, number of windows.
_ZONE = np.dtype([("seed", "<u8"), ("id", "<i8"), ("n", "<i4")])
#: What it holds of each window about a hot seed: window, seed, key of the zone, smallest id, place in the zone.
_SINGLE = np.dtype([("window", "<u8"), ("seed", "<u8"), ("key", "<u8"), ("id", "<i8"), ("nth", "u1")])


def shape_for(min_words: int) -> S.Shape:
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    return S.Shape("words", min_words, max(1, min_words - 63, min(min_words - 1, round(0.38 * min_words))))


def substring_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 13,
    *,
    carry: list[str] = (),
    keep_layout: bool = False,
    chunk_bytes: int = X.CHUNK_BYTES,
    hot_chunks: int = S.HOT_CHUNKS,
) -> DataFrame:
    """Removes each word in a run of `min_words` words that also starts in a document with a smaller id.

    Returns id, n_words, n_removed, kept_text, spans (start and length in words of the maximal
    repeats removed), and the carried columns.  Words are maximal runs of bytes other than 0x20 and
    0x09-0x0D.  kept_text joins the kept words by one space; with keep_layout it keeps the text's own
    white space, and a text that loses nothing is returned as it was (null stays null).

    Defined cases: a null or empty text has no words; rows with equal ids are one document's for the
    comparison ("smaller" is strict), so they don't remove each other's words; a null id is larger
    than every other and not smaller than another null.  Texts of any length are taken whole.  A
    carried column with the name of a result column is left out.
    """
    shape = shape_for(min_words)
    carry = X.result_first(carry, [id_col, "n_words", "n_removed", "kept_text", "spans"])
    n = X.chunk_count(df, text_col, chunk_bytes)
    chunks = X.in_chunks(df, id_col, text_col, n, carry)
    shared = S.shared_seeds(chunks, shape, n, hot_chunks)
    asked = chunks.groupBy("chunk").cogroup(shared.groupBy("dest")).applyInArrow(_extend(shape, n), X.MESSAGE)
    verdicts = asked.groupBy("dest").applyInArrow(_judge(shape), X.MESSAGE)
    carried = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carry)]
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("len", T.LongType())]))),
            *carried,
        ]
    )
    done = chunks.groupBy("chunk").cogroup(verdicts.groupBy("dest")).applyInArrow(_remove(shape, keep_layout, len(carried)), schema)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_text", "spans", *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def _extend(shape: S.Shape, buckets: int):
    def extend(key, table, replies):
        """Sends, for each distinct zone about a shared seed, the hashes of all its windows."""
        if table.num_rows == 0:
            return X.messages([], 0, [])
        seeds, hot, ids = S.known(replies), S.hot(replies), X.ids_of(table)
        keys, owners, found = [np.empty(0, G.U64)], [np.empty(0, np.int64)], []
        for a, _, _, _, z in S.each_slice(table, shape):
            z = z.take(S.among(z.hash, seeds))
            keys.append(z.keys(shape))
            owners.append(ids[a + z.doc])
            lens = z.hi - z.lo + 1
            found.append((z.hash, lens, G.multilinear_at(z.unit, G.expand(z.lo, lens), shape.span_shifts, 64)))
        at, zone_keys, least = S.distinct(np.concatenate(keys), np.concatenate(owners))
        if len(at) == 0:
            return X.messages([], 0, [])
        seed, lens, window = (np.concatenate(x) for x in zip(*found, strict=True))
        zone = np.empty(len(at), _ZONE)
        zone["seed"], zone["id"], zone["n"] = seed[at], least, lens[at]
        begin = (np.cumsum(lens) - lens)[at]
        alone = S.among(zone["seed"], hot)
        single, single_parts = _singles(zone[alone], zone_keys[alone], begin[alone], window, buckets)
        zone, begin = zone[~alone], begin[~alone]
        order, parts = X.split_by(S._bucket(zone["seed"], buckets))
        zone, begin = zone[order], begin[order]
        whole, apart = ({k: (a, b) for k, a, b in p} for p in (parts, single_parts))
        dest, bodies = sorted(whole.keys() | apart.keys()), []
        for k in dest:
            (a, b), (c, d) = whole.get(k, (0, 0)), apart.get(k, (0, 0))
            windows = window[G.expand(begin[a:b], zone["n"][a:b].astype(np.int64))]
            bodies.append(np.array([b - a, d - c], np.int64).tobytes() + zone[a:b].tobytes() + single[c:d].tobytes() + windows.tobytes())
        return X.messages(dest, key[0].as_py(), bodies)

    return X.tidied(extend)


def _singles(zone: np.ndarray, keys: np.ndarray, begin: np.ndarray, window: np.ndarray, buckets: int) -> tuple[np.ndarray, list]:
    """The windows of the zones one by one, in order of their buckets, and the buckets' parts."""
    lens = zone["n"].astype(np.int64)
    places = G.expand(begin, lens)
    out = np.empty(len(places), _SINGLE)
    out["window"], out["nth"] = window[places], places - np.repeat(begin, lens)
    out["seed"], out["key"], out["id"] = (np.repeat(x, lens) for x in (zone["seed"], keys, zone["id"]))
    order, parts = X.split_by(S._bucket(out["window"], buckets))
    return out[order], parts


def _later(window: np.ndarray, seed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window about a seed whether one with a smaller owner is the same."""
    gone = np.empty(len(window), bool)
    if len(window) == 0:
        return gone
    order = np.argsort(window, kind="stable")
    same = (window[order][1:] == window[order][:-1]) & (seed[order][1:] == seed[order][:-1])
    if np.any((window[order][1:] == window[order][:-1]) & ~same):  # one hash of windows about different seeds
        order = np.lexsort((seed, window))
        same = (window[order][1:] == window[order][:-1]) & (seed[order][1:] == seed[order][:-1])
    start = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(owner[order], start)
    gone[order] = owner[order] > np.repeat(least, np.diff(np.r_[start, len(window)]))
    return gone


def _judge(shape: S.Shape):
    def judge(key, table):
        """For each zone the windows that a smaller id has as well; for windows on their own, whether one has."""
        zones, singles, windows = [], [], []
        for body in table["body"].to_pylist():
            m, k = np.frombuffer(body, np.int64, 2).tolist()
            zones.append(np.frombuffer(body, _ZONE, m, 16))
            singles.append(np.frombuffer(body, _SINGLE, k, 16 + m * _ZONE.itemsize))
            windows.append(np.frombuffer(body, G.U64, -1, 16 + m * _ZONE.itemsize + k * _SINGLE.itemsize))
        if not zones:
            return X.messages([], 0, [])
        zone, window = _verdicts(np.concatenate(zones), np.concatenate(windows)), np.concatenate(singles)
        single = np.empty(len(window), S.VERDICT)
        single["key"] = window["key"]
        single["bits"] = _later(window["window"], window["seed"], window["id"]).astype(np.uint64) << window["nth"].astype(np.uint64)
        cuts = (np.r_[0, np.cumsum([len(x) for x in found])] for found in (zones, singles))
        back = []
        for c, a, b, d, e in zip(table["src"].to_pylist(), *(x for cut in cuts for x in (cut[:-1], cut[1:])), strict=True):
            both = np.concatenate([zone[a:b], single[d:e]])
            both = both[both["bits"] != 0]
            if len(both):
                back.append((c, both.tobytes()))
        return X.messages([c for c, _ in back], key[0].as_py(), [x for _, x in back])

    return X.tidied(judge)


def _verdicts(zone: np.ndarray, window: np.ndarray) -> np.ndarray:
    verdict = np.empty(len(zone), S.VERDICT)
    if len(zone) == 0:
        return verdict
    lens = zone["n"].astype(np.int64)
    gone = _later(window, np.repeat(zone["seed"], lens), np.repeat(zone["id"], lens))
    end = np.cumsum(lens)
    begin = end - lens
    nth = np.arange(len(window)) - np.repeat(begin, lens)
    first, last = window[begin], window[end - 1]
    verdict["key"] = G.mix(first * np.uint64(3) + last * np.uint64(5) + (lens - 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    verdict["bits"] = np.bitwise_or.reduceat(gone.astype(np.uint64) << nth.astype(np.uint64), begin)
    return verdict


def _remove(shape: S.Shape, keep_layout: bool, carried: int):
    def remove(key, table, replies):
        texts = table["text"].combine_chunks()
        ids = X.ids_of(table)
        verdict = np.concatenate([np.empty(0, S.VERDICT), *[np.frombuffer(x, S.VERDICT) for x in replies["body"].to_pylist()]])
        verdict = S.one_each(verdict)
        slices = list(S.each_slice(table, shape))
        keys = [z.release(shape) for *_, z in slices]
        owners = [ids[a + z.doc] for a, _, _, _, z in slices]
        _, local_keys, local_least = S.distinct(np.concatenate([np.empty(0, G.U64), *keys]), np.concatenate([np.empty(0, np.int64), *owners]))
        n_words, n_removed, kept, spans = [], [], [], []
        for (a, b, buf, off, z), k, owner in zip(slices, keys, owners, strict=True):
            starts, ends = z.spans
            gone = S.covered(S.flagged(z, k, owner, verdict["key"], verdict["bits"], local_keys, local_least), len(starts), shape.span)
            raw = buf.tobytes()
            for d in range(b - a):
                i, j = int(z.first[d]), int(z.first[d + 1])
                text, cut = raw[off[d] : off[d + 1]], gone[i:j]
                lost = int(cut.sum())
                n_words.append(j - i)
                n_removed.append(lost)
                if lost == 0:
                    spans.append([])
                    kept.append((text if texts[a + d].is_valid else None) if keep_layout else b" ".join(text.split()))
                    continue
                edge = np.flatnonzero(np.diff(np.r_[False, cut, False]))
                spans.append([{"start": int(s), "len": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                if keep_layout:
                    kept.append(_without(raw, int(off[d]), int(off[d + 1]), starts[i:j], edge))
                else:
                    stay = ~cut
                    kept.append(b" ".join(w for w, s in zip(text.split(), stay.tolist(), strict=True) if s))
        out = {
            "id": table["id"],
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())]))),
        }
        return pa.table(out | {f"c{i}": table[f"c{i}"] for i in range(carried)})

    return X.tidied(remove)


def _without(raw: bytes, begin: int, end: int, starts: np.ndarray, edge: np.ndarray) -> bytes:
    """The text without the runs of words between the edges; the white space before what follows stays as it is."""
    out, at = [], begin
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        out.append(raw[at : starts[s]])
        at = int(starts[e]) if e < len(starts) else end
    out.append(raw[at:end])
    return b"".join(out).rstrip() if at == end else b"".join(out)
