"""Near-duplicate documents by circulant MinHash.

Two permutations make all coordinates of a signature: the first spreads a document's shingles over
the cycle of 2**32 places, the second orders the places, and coordinate k is the minimum after a
shift of the cycle by k.  Bands of the signature propose candidates; exact Jaccard on the full
shingle sets decides.

Documents with equal sets are one class from the start.  A band's bucket proposes star links to its
smallest member only, so proposals stay linear in the bucket; the components of the proposals are
families.  A family's sets meet in one task, which searches its verified graph breadth first and so
compares a member only with members not yet reached.  A family beyond `block_docs` documents or
`block_shingles` shingles is dealt into blocks that each hold its commonest centres too; members
outside its largest component are then compared, in blocks, with all of the family.  So no link is
lost to a cap, and no pairs are emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.llm import _exchange as X
from fabula.llm import _grams as G
from fabula.llm.components import UnionFind, components

#: Documents of a family that one task compares.
BLOCK_DOCS = 1500
#: Shingles of them (about 80 bytes each while they are compared).
BLOCK_SHINGLES = 2_000_000
#: Centres that each block of a larger family holds.
CENTRES = 16


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` coordinates by which a pair at `similarity` is missed with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity**rows, 1 - 1e-12))))


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each document, A-Z folded; of fewer words, one of them all."""
    buf = G.FOLD[buf]
    starts, ends, doc = G.words(buf, off)
    w = G.word_hashes(buf, starts, ends)
    first = np.searchsorted(doc, np.arange(len(off))).tolist()
    grams = G.multilinear(w, len(w) - k + 1, list(range(k)), 200)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            out.append(G.multilinear(w[a:b], 1, list(range(n)), 300 + 20 * n))
        else:
            out.append(np.empty(0, G.U64))
    return out


def circulant_signatures(x: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x documents; x: the places (32 bits) of the documents' shingles, starts: where each begins."""
    out = np.empty((coordinates, len(starts)), np.uint32)
    v, t = np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.add(x, np.uint32(k), out=v)  # the cycle shifted by k
        np.right_shift(v, np.uint32(16), out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0x85EBCA6B), out=v)
        np.right_shift(v, np.uint32(13), out=t)
        np.bitwise_xor(v, t, out=v)
        np.multiply(v, np.uint32(0xC2B2AE35), out=v)
        out[k] = np.minimum.reduceat(v, starts)
    return out


def _signed(k: int, rows: int, bands: int):
    def signed(batches):
        for batch in batches:
            buf, off = G.text_buffer(batch["text"])
            parts = []
            for a, b in G.slices(off, X.SLICE_BYTES):
                sets = shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], k)
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((b - a, bands), np.int64)
                digest = np.zeros((2, b - a), np.int64)
                full = np.flatnonzero(n)
                if len(full):
                    h = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(n[full]) - n[full]
                    for i, c in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
                        digest[i, full] = np.add.reduceat(G.mix(h * np.uint64(c)), starts).view(np.int64)
                    sig = circulant_signatures((G.mix(h) >> np.uint64(32)).astype(np.uint32), starts, rows * bands)
                    for j in range(bands):
                        own = sig[j * rows : (j + 1) * rows].astype(np.uint64)
                        keys[full, j] = G.multilinear(np.concatenate([own.T.ravel(), np.zeros(1, np.uint64)]), (rows * len(full)) - rows + 1, list(range(rows)), 400 + 16 * j)[::rows].view(np.int64)
                parts.append((n, digest, keys))
            n, digest, keys = (np.concatenate(x, axis=a) for x, a in zip(zip(*parts, strict=True), (0, 1, 0), strict=True)) if parts else (np.empty(0, np.int64), np.empty((2, 0), np.int64), np.empty((0, bands), np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n), pa.array(digest[0]), pa.array(digest[1]), lists], ["id", "n", "d1", "d2", "keys"])

    return lambda batches: X.tidy(signed(batches))


def _sets(k: int):
    def sets(batches):
        for batch in batches:
            buf, off = G.text_buffer(batch["text"])
            found = [s.tobytes() for a, b in G.slices(off, X.SLICE_BYTES) for s in shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], k)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, pa.binary())], ["id", "set"])

    return lambda batches: X.tidy(sets(batches))


class Postings:
    """Which members of a group hold each shingle; counts intersections of one member with all others."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets], np.int64)
        self.at = np.r_[0, np.cumsum(self.n)]
        every = np.concatenate([*sets, np.empty(0, G.U64)])
        order = np.argsort(every, kind="stable")
        new = np.r_[True, every[order][1:] != every[order][:-1]] if len(every) else np.empty(0, bool)
        self.group = np.empty(len(every), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.member = np.repeat(np.arange(len(sets)), self.n)[order]
        self.of = self.group[order]
        self.groups = int(new.sum())
        self.restrict(np.ones(len(sets), bool))

    def restrict(self, members: np.ndarray) -> None:
        """Only these members are counted from now on."""
        keep = members[self.member]
        self.member, self.of = self.member[keep], self.of[keep]
        self.len = np.bincount(self.of, minlength=self.groups)
        self.start = np.cumsum(self.len) - self.len
        self.live = int(members.sum())

    def shared(self, i: int) -> np.ndarray:
        g = self.group[self.at[i] : self.at[i + 1]]
        return np.bincount(self.member[G.expand(self.start[g], self.len[g])], minlength=len(self.n))

    def linked(self, i: int, num: int, den: int) -> np.ndarray:
        both = self.shared(i)
        return den * both >= num * (self.n[i] + self.n - both)


def _links(num: int, den: int):
    def links(key, table):
        """A spanning forest of the group's verified links; where some members ask, of those links that an asker has."""
        ids = table["id"].to_numpy()
        sets = [np.frombuffer(x, G.U64) for x in table["set"].to_pylist()]
        asks = table["asks"].to_numpy().astype(bool)
        part = table["part"].to_numpy()
        post, out, joined = Postings(sets), [], UnionFind()
        if asks.any():
            for i in np.flatnonzero(asks):
                for j in np.flatnonzero(post.linked(int(i), num, den) & (part != part[i])):
                    if joined.union(int(part[i]), int(part[j])):
                        out.append((ids[i], ids[j]))
        else:
            left = post.n > 0
            for seed in range(len(ids)):
                todo = [seed] if left[seed] else []
                left[seed] = False
                while todo and left.any():
                    if left.sum() * 2 < post.live:
                        post.restrict(left)
                    x = todo.pop()
                    for y in np.flatnonzero(post.linked(x, num, den) & left).tolist():
                        out.append((ids[seed], ids[y]))
                        left[y] = False
                        todo.append(y)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return X.tidied(links)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    shingle_words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    rows: int = 5,
    miss: float = 1e-8,
    block_docs: int = BLOCK_DOCS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Returns id, n_shingles, component_id, kept for each row.

    Two documents are linked if den * |intersection| >= num * |union| of their sets of word shingles
    (A-Z folded); component_id is the smallest id reachable, kept says whether it is the id itself.
    A pair at the very threshold is proposed with probability 1 - miss, more similar ones surer.

    Defined cases: a null or empty text, or one of white space, has no shingles and is linked with
    nothing; a text of fewer words than a shingle is one shingle; rows with one id are one node; a
    null id has a null component, is linked with nothing and is kept.
    """
    X.bounded_batches(df)
    num, den = similarity
    bands = bands_for(num / den, rows, miss)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = X.checkpoint(docs.mapInArrow(_signed(shingle_words, rows, bands), "id long, n long, d1 long, d2 long, keys array<long>"))
    filled = signed.where("n > 0 and id is not null")
    hot = X.hot_size(filled.count())
    classes = filled.groupBy("d1", "d2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    classed = X.join_sized(filled, classes, ["d1", "d2", "n"], "copies", hot)
    classed = X.checkpoint(classed.select("id", "node", "copies", F.when(F.col("id") == F.col("node"), F.col("keys")).alias("keys")))
    members = classed.select("id", "node")
    keys = classed.where("keys is not null").select("node", F.explode("keys").alias("key")).distinct()
    buckets = keys.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("size")).where("size > 1")
    proposed = X.join_sized(keys, buckets, ["key"], "size", bands * hot).where("node <> centre")
    proposed = X.checkpoint(proposed.groupBy("node", "centre").agg(F.count("*").alias("votes")))
    weight = filled.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    family = components(proposed.select(F.col("node").alias("a"), F.col("centre").alias("b"))).withColumnRenamed("component", "family")
    family = X.checkpoint(family.join(weight, "node"))
    size = family.groupBy("family").agg(_blocks(block_docs, block_shingles).alias("blocks"))
    dealt = family.join(size, "family").select("family", F.col("node").alias("id"), F.expr("pmod(xxhash64(node), blocks)").alias("block"), "blocks")
    group = dealt.select("family", "block", "id", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("part"))
    large = size.where("blocks > 1")
    any_large = len(large.take(1)) > 0
    if any_large:
        group = group.union(_centres(proposed, family, dealt))
    sets = X.checkpoint(docs.join(family.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(_sets(shingle_words), "id long, set binary"))
    found = X.checkpoint(_verified(sets, group, num, den))
    if any_large:
        late = _outsiders(found, family, large, block_docs, block_shingles)
        found = found.union(_verified(sets, late, num, den))
    of_class = components(found).withColumnRenamed("component", "least")
    # A class's first member stands for it; a node that stands for several classes has their largest number of copies.
    size = classed.where("keys is not null").groupBy("node").agg(F.max("copies").alias("copies"))
    least = size.join(of_class, "node", "left").select("node", "copies", F.coalesce("least", "node").alias("least"))
    named = X.join_sized(members, least, ["node"], "copies", hot).groupBy("id").agg(F.min("least").alias("component"))
    out = signed.select("id", "n").join(named, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _blocks(block_docs: int, block_shingles: int) -> Column:
    """Blocks of a group of documents, by their number and the shingles (n) that they have together."""
    return F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles))


def _verified(sets: DataFrame, group: DataFrame, num: int, den: int) -> DataFrame:
    dealt = sets.join(group, "id").select("family", "block", "asks", "part", "id", "set")
    return dealt.groupBy("family", "block").applyInArrow(_links(num, den), "a long, b long")


def _centres(proposed: DataFrame, family: DataFrame, dealt: DataFrame) -> DataFrame:
    """The commonest centres of each family in several blocks, once for each block that they aren't in."""
    several = dealt.where("blocks > 1")
    votes = proposed.groupBy("centre").agg(F.sum("votes").alias("votes")).join(several, F.col("centre") == F.col("id"))
    best = votes.groupBy("family", "blocks").agg(F.expr(f"slice(sort_array(collect_list(struct(votes, id, block)), false), 1, {CENTRES})").alias("best"))
    each = best.select("family", "blocks", F.explode("best").alias("c")).select("family", F.col("c.id").alias("id"), F.col("c.block").alias("own"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    return each.where("block <> own").select("family", "block", "id", F.lit(False).alias("asks"), F.lit(0).cast("long").alias("part"))


def _outsiders(found: DataFrame, family: DataFrame, large: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """Of large families: the members outside the largest component, in blocks, each with every block of the family."""
    nodes = family.join(large, "family").join(components(found), "node", "left").select("family", "blocks", "n", F.col("node").alias("id"), F.coalesce("component", "node").alias("part"))
    nodes = X.checkpoint(nodes)
    parts = nodes.groupBy("family", "part").agg(F.count("*").alias("docs"))
    main = parts.groupBy("family").agg(F.max(F.struct("docs", "part")).alias("m")).select("family", F.col("m.part").alias("main"))
    asking = nodes.join(main, "family").where("part <> main")
    asked = asking.groupBy("family").agg(_blocks(block_docs, block_shingles).alias("ask_blocks"))
    nodes = nodes.join(asked, "family").withColumn("row_block", F.expr("pmod(xxhash64(id), blocks)"))
    asking = asking.join(asked, "family").withColumn("ask_block", F.expr("pmod(xxhash64(id, 1), ask_blocks)"))
    wide = 1 << 20
    ask_each = F.explode(F.expr(f"transform(sequence(0L, blocks - 1), i -> ask_block * {wide} + i)"))
    row_each = F.explode(F.expr(f"transform(sequence(0L, ask_blocks - 1), i -> i * {wide} + row_block)"))
    askers = asking.select("family", ask_each.alias("block"), "id", F.lit(True).alias("asks"), "part")
    rest = nodes.select("family", row_each.alias("block"), "id", F.lit(False).alias("asks"), "part")
    return askers.union(rest)
