"""Shards of near-equal bytes by a k-d tree over document metadata.

A node that still has n shards is split at the place of its bytes where floor(n / 2) of n shards end,
along its widest metadata dimension, until every leaf is one shard.  The splits of a level are found
together, by distributed weighted selection: bytes are summed in up to 1,024 buckets of each node's key
range, and the bucket that holds the split is cut again until it holds one key.  Keys join the
dimension's value with a hash of the row, so rows with equal values (a hot source) can be split
anywhere.  The driver sees sums of buckets only, a million in a round.

Cost at scale: two dozen scans of a narrow checkpointed table (no text), no sort of all rows; slots are
numbered within parts of a shard, whose counts are summed first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabula.llm._exchange import checkpoint, shuffle_partitions

_BUCKETS = 1024
_VALUE_BITS = 31
#: Bits of the tie that a row's values give; the rest tell equal rows apart.
_ROW_BITS = 20
#: Bucket sums that the driver gets in a round.
_MOST_SUMS = 1 << 20
#: Rows that one task numbers.
_PART_ROWS = 1_000_000


@dataclass
class Node:
    """A box of the tree: its shards; once split the dimension, the first key of the right side, and both sides; of a leaf its shard."""

    number: int
    shards: int
    dim: int = 0
    key: int = 0
    sides: tuple[Node, Node] | None = None
    shard: int = 0


class Places:
    """The tree as arrays by node number, so that rows are placed by an expression of one size for any number of nodes."""

    def __init__(self, root: Node) -> None:
        nodes, todo, self.depth = [], [(root, 0)], 0
        while todo:
            node, depth = todo.pop()
            nodes.append(node)
            self.depth = max(self.depth, depth)
            todo += [(side, depth + 1) for side in node.sides or ()]
        self.nodes = {n.number: n for n in nodes}
        self.size = max(self.nodes) + 1

    def column(self, dims: int) -> Column:
        """Number of the node without sides that a row falls in."""
        split = [self.nodes[i] if i in self.nodes and self.nodes[i].sides else None for i in range(self.size)]
        dim, key = ([getattr(n, x) if n else 0 for n in split] for x in ("dim", "key"))
        left, right = ([n.sides[x].number if n else i for i, n in enumerate(split)] for x in (0, 1))
        own = F.array(*[F.col(f"k{i}") for i in range(dims)])

        def step(node: Column, _: Column) -> Column:
            below = F.get(own, F.get(_constants(dim, "int"), node)) < F.get(_constants(key, "bigint"), node)
            return F.when(below, F.get(_constants(left, "int"), node)).otherwise(F.get(_constants(right, "int"), node))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.lit(0), step) if self.depth else F.lit(0)

    def shard(self, dims: int) -> Column:
        shard = [self.nodes[i].shard if i in self.nodes else None for i in range(self.size)]
        return F.get(_constants(shard, "int"), self.column(dims))


def _constants(values: list, kind: str) -> Column:
    """An array of constants; a null where there is none."""
    return F.from_json(F.lit("[" + ",".join("null" if v is None else str(v) for v in values) + "]"), f"array<{kind}>")


def kd_shards(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: list[str] = ("doc_id", "n_chars", "source", "lang"),
    shards: int | None = None,
    row_bytes: int = 16,
    *,
    target_bytes: int | None = None,
) -> DataFrame:
    """As many shards as asked for, or as leaves of `target_bytes` at most (but for a row) need.  Returns id, size (UTF-8 bytes of the text plus row_bytes), text_crc32, shard (from 0) and slot (gapless from 0 in its shard).

    Dimensions are numbers (by value) or strings (by hash); a null is a dimension's least value.
    Near equal: each split misses its place by half of one row at most (by half of a 2,048th of the
    rows that are wholly equal, if there are more).  With fewer rows than shards some shards are empty.
    Defined cases: a null text has size row_bytes and crc32 0; rows that are equal in id, text and
    dimensions are told apart by their place in the checkpoint; an empty table gives an empty result.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    numeric = [not df.schema[d].dataType.simpleString().startswith("string") for d in dims]
    values = [F.col(f"`{d}`").cast("double") if n else F.crc32(F.col(f"`{d}`").cast("string")).cast("double") for d, n in zip(dims, numeric, strict=True)]
    base = df.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[v.alias(f"v{i}") for i, v in enumerate(values)],
    )
    base = checkpoint(base)
    span = base.agg(*[f(f"v{i}") for i in range(len(dims)) for f in (F.min, F.max)], F.sum("size"), F.count("*")).first()
    rows_in_all = span[len(span) - 1]
    if shards is None:
        shards = max(1, -(-(span[len(span) - 2] or 0) // target_bytes))
    # Of equal rows the place in the checkpoint decides, which is the same each time it is read.
    same = F.shiftleft(F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 64 - _ROW_BITS), _VALUE_BITS - _ROW_BITS)
    tie = same + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - _VALUE_BITS + _ROW_BITS)
    keyed = []
    for i in range(len(dims)):
        low, high = span[2 * i], span[2 * i + 1]
        wide = high - low if low is not None and high > low else 1.0
        level = F.coalesce(F.floor((F.col(f"v{i}") - F.lit(low)) / F.lit(wide) * F.lit((1 << _VALUE_BITS) - 2.0)) + 1, F.lit(0)).cast("long") if low is not None else F.lit(0).cast("long")
        keyed.append((F.shiftleft(level, _VALUE_BITS) + tie).alias(f"k{i}"))
    rows = checkpoint(base.select("id", "size", "crc", *keyed))
    root = _grow(rows, len(dims), shards)
    placed = rows.select("id", "size", F.col("crc").alias("text_crc32"), Places(root).shard(len(dims)).alias("shard"))
    parts = max(-(-rows_in_all // (shards * _PART_ROWS)), -(-2 * shuffle_partitions(df.sparkSession) // shards))
    placed = checkpoint(placed.withColumn("part", F.pmod(F.xxhash64("id", "text_crc32", F.monotonically_increasing_id()), F.lit(parts))))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size"))
    out = placed.withColumn("nth", nth).join(offsets, ["shard", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))


def _grow(rows: DataFrame, dims: int, shards: int) -> Node:
    """Splits nodes level by level; at the end shards are numbered in the order of the leaves."""
    root, number = Node(0, shards), 0
    open_nodes = [root] if shards > 1 else []
    while open_nodes:
        where = Places(root).column(dims).cast("int").alias("node")
        stats = {
            r["node"]: r
            for r in rows.select(where, "size", *[f"k{i}" for i in range(dims)])
            .groupBy("node")
            .agg(F.sum("size").alias("bytes"), *[f(f"k{i}").alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)])
            .collect()
        }
        seeking = {}
        for node in open_nodes:
            s = stats.get(node.number)
            if s is None:  # no rows: any split will do
                node.dim, node.key = 0, 0
                continue
            node.dim = max(range(dims), key=lambda i: ((s[f"max{i}"] >> _VALUE_BITS) - (s[f"min{i}"] >> _VALUE_BITS), -i))
            low, high = s[f"min{node.dim}"], s[f"max{node.dim}"]
            seeking[node.number] = (node, low, high, 0, s["bytes"] * (node.shards // 2) / node.shards)
        while seeking:
            seeking = _narrow(rows, root, dims, seeking)
        for node in open_nodes:
            left = node.shards // 2
            node.sides = (Node(number + 1, left), Node(number + 2, node.shards - left))
            number += 2
        open_nodes = [side for node in open_nodes for side in node.sides if side.shards > 1]
    _name(root, 0)
    return root


def _name(node: Node, first: int) -> int:
    """Numbers the shards of the leaves from `first`, in order; returns the next one."""
    if node.sides is None:
        node.shard = first
        return first + 1
    return _name(node.sides[1], _name(node.sides[0], first))


def _narrow(rows: DataFrame, root: Node, dims: int, seeking: dict) -> dict:
    """One round: cuts each node's range (low to high, `before` bytes below it) to the bucket with the target; ends at one key."""
    buckets = max(2, min(_BUCKETS, _MOST_SUMS // len(seeking)))
    size = max(seeking) + 1
    dim, low, high, wide = [[None] * size for _ in range(4)]
    for number, (node, least, most, _, _) in seeking.items():
        dim[number], low[number], high[number], wide[number] = node.dim, least, most, (most - least) // buckets + 1
    placed = rows.select("size", *[f"k{i}" for i in range(dims)], Places(root).column(dims).cast("int").alias("node"))
    at = [F.get(_constants(v, k), F.col("node")) for v, k in ((dim, "int"), (low, "bigint"), (high, "bigint"), (wide, "bigint"))]
    ranged = placed.select("node", "size", F.get(F.array(*[F.col(f"k{i}") for i in range(dims)]), at[0]).alias("key"), at[1].alias("low"), at[2].alias("high"), at[3].alias("wide"))
    sums = ranged.where("key between low and high").groupBy("node", F.expr("(key - low) div wide").alias("bucket"))
    found = sums.agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
    by_node: dict[int, list] = {}
    for r in found:
        by_node.setdefault(r["node"], []).append(r)
    left = {}
    for number, (node, _, last, before, target) in seeking.items():
        for r in sorted(by_node[number], key=lambda r: r["bucket"]):
            if before + r["bytes"] >= target or r["high"] == last:
                if r["low"] == r["high"]:  # one key: it goes to the nearer side
                    node.key = r["low"] if target - before < before + r["bytes"] - target else r["low"] + 1
                else:
                    left[number] = (node, r["low"], r["high"], before, target)
                break
            before += r["bytes"]
    return left
