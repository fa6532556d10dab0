"""Suffix-array dedup: removal of byte strings that a document with a smaller id has too.

A common-prefix-aware distributed merge sort.  Suffixes are sampled at winnowed seeds (every match of
`min_bytes` bytes has one, at the same place in both texts).  Each chunk of documents sorts the
suffixes that start at shared seeds, and the reversed prefixes that end there, cuts them to the window
length and sends both as front-coded runs (length of the prefix shared with the string before, then
the rest).  A bucket combines its runs with loser trees that keep, for each loser, the length of the
prefix it shares with the winner, and compare strings beyond that only.  The merge gives both orders
with their common-prefix arrays; two windows are the same bytes if their suffixes share enough bytes
right of the seed and their prefixes enough bytes left of it, so between chunks equal windows are found
by their bytes, as intervals of the two arrays, without pairs of documents.  64-bit hashes choose seeds,
find which are shared, tell equal zones within a chunk and address the verdicts.  A seed of very many
chunks is hot: its windows go to buckets one by one, by their own hash, so that a common string in ever
other surroundings doesn't fill one bucket.

Cost at scale: one shuffle of the text (reused by three rounds), 8 bytes a distinct seed and chunk,
and front-coded strings only around seeds that two documents share, distinct in a chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import _exchange as X
from fabula.llm import _grams as G
from fabula.llm import _seeds as S

#: What a message holds of each zone: key, smallest id, fewest and most bytes left of the seed in its windows.
#: (a zone about a hot seed is sent as its windows one by one), and which window of the zone is its first.
_ZONE = np.dtype([("key", "<u8"), ("id", "<i8"), ("least", "<u2"), ("most", "<u2"), ("nth", "u1")])
_RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, len: long>>"


def shape_for(min_bytes: int) -> S.Shape:
    if min_bytes < 16:
        raise ValueError("min_bytes must be 16 at least")
    return S.Shape("bytes", min_bytes, max(8, min_bytes - 63, round(0.32 * min_bytes)))


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50, *, chunk_bytes: int = X.CHUNK_BYTES, hot_chunks: int = S.HOT_CHUNKS) -> DataFrame:
    """Removes each byte in a string of `min_bytes` bytes that also starts in a document with a smaller id.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the other bytes, which may
    cut a character) and spans (start and length in bytes).

    Defined cases: a null text is empty; rows with equal ids are one document's for the comparison
    ("smaller" is strict); a null id is larger than every other and not smaller than another null.
    Texts of any length are taken whole; matches never cross documents.
    """
    shape = shape_for(min_bytes)
    n = X.chunk_count(df, text_col, chunk_bytes)
    chunks = X.in_chunks(df, id_col, text_col, n)
    shared = S.shared_seeds(chunks, shape, n, hot_chunks)
    runs = chunks.groupBy("chunk").cogroup(shared.groupBy("dest")).applyInArrow(_sorted_runs(shape, n), X.MESSAGE)
    verdicts = runs.groupBy("dest").applyInArrow(_merge(shape), X.MESSAGE)
    done = chunks.groupBy("chunk").cogroup(verdicts.groupBy("dest")).applyInArrow(_remove(shape), _RESULT)
    return done.withColumnRenamed("id", id_col)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the longest common prefix; the first `known` bytes are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: prefix shared with the one before, length, and the rests joined."""
    shared, before = np.zeros(len(strings), np.uint16), b""
    rests = []
    for i, s in enumerate(strings):
        h = common_prefix(before, s, 0)
        shared[i] = h
        rests.append(s[h:])
        before = s
    return shared, np.fromiter(map(len, strings), np.uint16, len(strings)), b"".join(rests)


def front_decode(shared: list[int], lens: list[int], rests: bytes) -> list[bytes]:
    out, at, before = [], 0, b""
    for h, n in zip(shared, lens, strict=True):
        before = before[:h] + rests[at : at + n - h]
        at += n - h
        out.append(before)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Loser-tree merge of sorted runs with their common-prefix lengths.

    Returns places (in the concatenation of the runs) in sorted order, and the length of the prefix
    that each string shares with the one before it.  Each stream keeps the prefix length it shares
    with the last string output on its path; of two streams the longer such prefix is the smaller
    string, and only equal lengths lead to a comparison, from there on."""
    base, total = [], 0
    for r in runs:
        base.append(total)
        total += len(r)
    width = 1 << max(0, (len(runs) - 1).bit_length())
    at = [0] * width
    head = [runs[i][0] if i < len(runs) and runs[i] else b"" for i in range(width)]
    known = [0 if i < len(runs) and runs[i] else -1 for i in range(width)]  # -1: exhausted
    loser = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        ha, hb = known[a], known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        if ha < 0:
            return a, b
        x, y = head[a], head[b]
        h = common_prefix(x, y, ha)
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= width:
            return node - width
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if width > 1 else 0
    order, prefix = [], []
    for _ in range(total):
        i = at[winner]
        order.append(base[winner] + i)
        prefix.append(known[winner])
        i += 1
        at[winner] = i
        if i < len(runs[winner]):
            head[winner], known[winner] = runs[winner][i], shared[winner][i]
        else:
            known[winner] = -1
        node = (winner + width) >> 1
        while node:
            other = loser[node]
            ha, hb = known[winner], known[other]
            if ha < hb:
                loser[node], winner = winner, other
            elif ha == hb and ha >= 0:
                x, y = head[winner], head[other]
                h = common_prefix(x, y, ha)
                if h == len(x) or (h < len(y) and x[h] < y[h]):
                    known[other] = h
                else:
                    known[winner] = h
                    loser[node], winner = winner, other
            node >>= 1
    return order, prefix


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """The parts as one body: its length, then length-prefixed parts under zstd."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    body = np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(body: bytes) -> list[bytes]:
    body = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(body[:8], "little")
    lens, at, out = np.frombuffer(body, np.int64, n, 8), 8 * (n + 1), []
    for x in lens:
        out.append(body[at : at + x])
        at += int(x)
    return out


def _sorted_runs(shape: S.Shape, buckets: int):
    def sorted_runs(key, table, replies):
        if table.num_rows == 0:
            return X.messages([], 0, [])
        seeds, hot, ids = S.known(replies), S.hot(replies), X.ids_of(table)
        raws, found, total = [], [], 0
        for a, _, buf, _, z in S.each_slice(table, shape):
            z = z.take(S.among(z.hash, seeds))
            found.append((z.keys(shape), ids[a + z.doc], z.hash, z.lo + total, z.seed + total, z.hi + total))
            raws.append(buf.tobytes())
            total += len(buf)
        raw = b"".join(raws)
        keys, owner, seed, lo, place, hi = (np.concatenate(x) for x in zip(*found, strict=True))
        at, _, least = S.distinct(keys, owner)
        if len(at) == 0:
            return X.messages([], 0, [])
        keys, seed, lo, place, hi = (x[at] for x in (keys, seed, lo, place, hi))
        nth, bucket = np.zeros(len(at), np.int64), S._bucket(seed, buckets)
        alone = S.among(seed, hot)
        if alone.any():
            lens = np.where(alone, hi - lo + 1, 1)
            begin = np.repeat(lo, lens)
            keys, least, place, bucket, alone = (np.repeat(x, lens) for x in (keys, least, place, bucket, alone))
            nth = np.where(alone, np.arange(len(begin)) - np.repeat(np.cumsum(lens) - lens, lens), 0)
            lo, hi = begin + nth, np.where(alone, begin + nth, np.repeat(hi, lens))
            bucket[alone] = [zlib.crc32(raw[p : p + shape.span]) % buckets for p in lo[alone].tolist()]
        order, parts = X.split_by(bucket)
        bodies = []
        for _, a, b in parts:
            some = order[a:b]
            starts, seeds_at, ends = lo[some].tolist(), place[some].tolist(), (hi[some] + shape.span).tolist()
            right = [raw[p:e] for p, e in zip(seeds_at, ends, strict=True)]
            left = [raw[s:p][::-1] for s, p in zip(starts, seeds_at, strict=True)]
            by_right = sorted(range(len(right)), key=right.__getitem__)
            zone = np.empty(b - a, _ZONE)
            zone["key"], zone["id"], zone["nth"] = keys[some], least[some], nth[some]
            zone["least"], zone["most"] = place[some] - hi[some], place[some] - lo[some]
            left = [left[i] for i in by_right]
            by_left = sorted(range(len(left)), key=left.__getitem__)
            right_run, left_run = front_code([right[i] for i in by_right]), front_code([left[i] for i in by_left])
            bodies.append(_pack(zone[by_right], *right_run, np.array(by_left, np.uint32), *left_run))
        return X.messages([k for k, _, _ in parts], key[0].as_py(), bodies)

    return X.tidied(sorted_runs)


def _merge(shape: S.Shape):
    def merge(key, table):
        zones, rights, lefts, left_places, total = [], [], [], [], 0
        for body in table["body"].to_pylist():
            zone, rs, rl, rt, place, ls, ll, lt = _unpack(body)
            zones.append(np.frombuffer(zone, _ZONE))
            rs, rl, ls, ll = (np.frombuffer(x, np.uint16).tolist() for x in (rs, rl, ls, ll))
            rights.append((front_decode(rs, rl, rt), rs))
            lefts.append((front_decode(ls, ll, lt), ls))
            left_places.append(np.frombuffer(place, np.uint32).astype(np.int64) + total)
            total += len(zones[-1])
        if not total:
            return X.messages([], 0, [])
        zone = np.concatenate(zones)
        right_order, right_shared = map(np.array, merge_runs(*map(list, zip(*rights, strict=True))))
        left_order, left_shared = map(np.array, merge_runs(*map(list, zip(*lefts, strict=True))))
        bits = equal_windows(zone["id"], zone["least"].astype(np.int64), zone["most"].astype(np.int64), right_order, right_shared, np.concatenate(left_places)[left_order], left_shared, shape.span)
        verdict = np.empty(total, S.VERDICT)
        verdict["key"], verdict["bits"] = zone["key"], bits << zone["nth"].astype(np.uint64)
        cut = np.r_[0, np.cumsum([len(z) for z in zones])]
        back = [(c, verdict[a:b][bits[a:b] != 0]) for c, a, b in zip(table["src"].to_pylist(), cut[:-1], cut[1:], strict=True)]
        back = [(c, x.tobytes()) for c, x in back if len(x)]
        return X.messages([c for c, _ in back], key[0].as_py(), [x for _, x in back])

    return X.tidied(merge)


def equal_windows(ids, least, most, right_order, right_shared, left_order, left_shared, span: int) -> np.ndarray:
    """For each zone the windows (bit 0: the first) that a zone with a smaller id has too.

    The window with `left` bytes before the seed is fixed by the interval of suffixes that share
    span - left bytes, and the interval of reversed prefixes that share `left` bytes."""
    n = len(ids)
    bits = np.zeros(n, np.uint64)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for left in range(int(least.min()), int(most.max()) + 1):
        some = np.flatnonzero((least <= left) & (left <= most))
        if len(some) == 0:
            continue
        right_class[right_order] = np.cumsum(right_shared < span - left)
        left_class[left_order] = np.cumsum(left_shared < left)
        both = right_class[some] * (n + 1) + left_class[some]
        order = np.argsort(both)
        start = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]])
        owner = ids[some][order]
        gone = owner > np.repeat(np.minimum.reduceat(owner, start), np.diff(np.r_[start, len(some)]))
        hit = some[order[gone]]
        bits[hit] |= np.uint64(1) << (most[hit] - left).astype(np.uint64)
    return bits


def _remove(shape: S.Shape):
    def remove(key, table, replies):
        ids = X.ids_of(table)
        verdict = np.concatenate([np.empty(0, S.VERDICT), *[np.frombuffer(x, S.VERDICT) for x in replies["body"].to_pylist()]])
        verdict = S.one_each(verdict)
        slices = [(a, b, buf, off, z, z.release(shape), ids[a + z.doc]) for a, b, buf, off, z in S.each_slice(table, shape)]
        _, local_keys, local_least = S.distinct(np.concatenate([np.empty(0, G.U64), *[x[5] for x in slices]]), np.concatenate([np.empty(0, np.int64), *[x[6] for x in slices]]))
        n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
        for _, _, buf, off, z, k, owner in slices:
            gone = S.covered(S.flagged(z, k, owner, verdict["key"], verdict["bits"], local_keys, local_least), len(buf), shape.span)
            sums = np.r_[0, np.cumsum(gone)]
            for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                lost = int(sums[j] - sums[i])
                edge = np.flatnonzero(np.diff(np.r_[False, gone[i:j], False])) if lost else np.empty(0, np.int64)
                n_bytes.append(j - i)
                n_removed.append(lost)
                n_spans.append(len(edge) // 2)
                spans.append([{"start": int(s), "len": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept.append((buf[i:j][~gone[i:j]] if lost else buf[i:j]).tobytes())
        longs = {k: pa.array(v, pa.int64()) for k, v in (("n_bytes", n_bytes), ("n_removed", n_removed), ("n_spans", n_spans))}
        return pa.table({"id": table["id"], **longs, "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int64())])))})

    return X.tidied(remove)
