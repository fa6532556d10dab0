"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm._exchange import checkpoint, hot_size, join_sized


class UnionFind:
    """Smallest member as root, path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(batches):
    """Links of a task, fewer: one from each node to the smallest that it reaches within the task's links."""
    found = UnionFind()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            found.union(a, b)
    pairs = np.array([(x, found.find(x)) for x in list(found.up)], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    for i in range(0, len(pairs), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000, k]) for k in (0, 1)], ["a", "b"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its smallest node.

    Alternates large-star and small-star rounds (minimum by aggregation with partial sums, then an
    equi-join, in which nodes with very many links are broadcast: the skew-join rule doesn't split a join
    with an aggregate of the same key); the number of rounds
    grows with the logarithm of the longest path.  Each round is a reliable checkpoint.  Null ends and
    loops are ignored; an empty table gives an empty table.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = checkpoint(links.mapInArrow(_forest, "a long, b long").distinct())
    seen, hot = None, hot_size(2 * edges.count())
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select("a", F.least("a", "m").alias("m"), "links")
        large = join_sized(both, least, ["a"], "links", hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links"))
        small = join_sized(down, least, ["a"], "links", hot).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = checkpoint(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
