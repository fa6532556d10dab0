"""Narrative graph: counted triplets, edges, degrees, largest component."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.schema import ROLES


def narrative_counts(statements: DataFrame) -> DataFrame:
    """Distinct narratives of all role columns with value, their number; missing roles are empty, neg is "not " or empty."""
    have = [F.when(F.col("neg"), F.lit("not ")).otherwise(F.lit("")).alias("neg") if r == "neg" else F.coalesce(F.col(r), F.lit("")).alias(r) if r in statements.columns else F.lit("").alias(r) for r in ROLES if r != "neg" or "neg" in statements.columns]
    flat = statements.select(*have)
    if "neg" not in flat.columns:
        flat = flat.withColumn("neg", F.lit(""))
    return flat.groupBy(*ROLES).agg(F.count("*").alias("value"))


def edges(statements: DataFrame, top_n: int | None = None) -> DataFrame:
    """src, dst, label, value of narratives with agent, verb and patient, the most frequent first; ties by the roles."""
    full = narrative_counts(statements).where("arg0 <> '' and arg1 <> '' and verb <> ''")
    if top_n is not None:
        full = full.orderBy(F.desc("value"), "arg0", "arg1", "arg2", "verb", "neg", "mod").limit(top_n)
    return full.select(F.col("arg0").alias("src"), F.col("arg1").alias("dst"), F.concat("neg", "verb").alias("label"), "value")


def degrees(edge: DataFrame) -> DataFrame:
    """id, value: ends of edges at the node; parallel edges count, a loop counts twice."""
    return edge.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("value"))


#: Edges of a graph on the driver if no number is given.
MOST_EDGES = 100_000


@dataclass
class Graph:
    """A small graph on the driver: edges as (src, dst, label, value), nodes with their degree."""

    edges: list[tuple]
    nodes: dict[str, int]


def build_graph(statements: DataFrame, top_n: int | None = 100, prune_network: bool = True) -> Graph:
    """The top edges, or all (MOST_EDGES at most, as the driver gets them; more are refused); pruned to the largest weak component.

    Of components of equal size the one with the highest-ranked edge stays.  No statements give an empty graph."""
    found = edges(statements, top_n)
    rows = [tuple(r) for r in (found if top_n is not None else found.orderBy(F.desc("value"), "src", "dst", "label").limit(MOST_EDGES + 1)).collect()]
    if top_n is None and len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; give top_n")
    up: dict[str, str] = {}

    def find(a: str) -> str:
        up.setdefault(a, a)
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    for src, dst, *_ in rows:
        up[find(src)] = find(dst)
    if prune_network and rows:
        size: dict[str, int] = {}
        for node in list(up):
            size[find(node)] = size.get(find(node), 0) + 1
        largest = max(size.values())
        keep = next(find(r[0]) for r in rows if size[find(r[0])] == largest)
        rows = [r for r in rows if find(r[0]) == keep]
    degree: dict[str, int] = {}
    for src, dst, *_ in rows:
        degree[src] = degree.get(src, 0) + 1
        degree[dst] = degree.get(dst, 0) + 1
    return Graph(rows, degree)
