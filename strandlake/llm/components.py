"""Groups of linked records by random contraction of the graph of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.session import HOT_MIN_ROWS, HOT_SHARE, cut_lineage, cut_table, discard, lookup_join


def _order(c: str, seed: int) -> Column:
    """A fresh random order of vertices; the vertex itself settles equal hashes."""
    return F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("hash"), F.col(c).alias("id"))


def _relabel(edges: DataFrame, end: str, rep: DataFrame, n_edges: int) -> DataFrame:
    """Put the representative of `end` in its place. Vertices with more than a thousandth of all
    edges number two thousand at most; their few mapping rows are broadcast."""
    rep = rep.select(F.col("v").alias(end), F.col("rep").alias("_to"), "degree")
    if n_edges < HOT_MIN_ROWS:
        joined = edges.join(rep, end)
    else:
        hot = F.broadcast(rep.where(F.col("degree") > n_edges // HOT_SHARE).select(end, F.col("_to").alias("_hot")))
        marked = edges.join(hot, end, "left")
        cold = marked.where("_hot IS NULL").drop("_hot").join(rep, end).drop("degree")
        joined = marked.where("_hot IS NOT NULL").withColumnRenamed("_hot", "_to").unionByName(cold)
    other = "b" if end == "a" else "a"
    return joined.select(F.col("_to").alias(end), other)


def link_groups(edges: DataFrame, a: str, b: str, seed: int = 7) -> DataFrame:
    """One row (`member`, `root`) for each vertex with a link to another; `root` is the smallest member of its group.

    In each round every vertex hooks to the neighbour, or itself, that comes first in a fresh hash order;
    edges are relabelled, loops and repeats dropped, until no edge is left. Then the mappings are expanded
    from the last round backwards. Hooking and all deduplication combine before the shuffle, so a vertex
    with a third of all edges sends one row per partition. Every round is written to the checkpoint folder.

    Direction does not matter; repeated edges count once. Edges with a null end and loops link nothing.
    An empty table gives no rows. Other columns are ignored.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edge, path = cut_table(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[tuple[DataFrame, int]] = []
    while n_edges := edge.count():
        step = seed * 1_000_003 + len(maps)
        ways = edge.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edge.select("b", "a"))
        nearest = ways.groupBy("v").agg(F.min(_order("w", step)).alias("m"), F.count(F.lit(1)).alias("degree"))
        rep = nearest.select("v", F.least(F.col("m"), _order("v", step))["id"].alias("rep"), "degree")
        rep = cut_lineage(rep)
        maps.append((rep.select("v", "rep"), 2 * n_edges))  # no more vertices than ends
        moved = _relabel(_relabel(edge, "a", rep, n_edges), "b", rep, n_edges)
        old = path
        edge, path = cut_table(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        discard(edge.sparkSession, old)
    if not maps:
        return edge.select(F.col("a").alias("member"), F.col("b").alias("root"))
    root = maps[-1][0]
    for rep, n in reversed(maps[:-1]):
        known = root.select(F.col("v").alias("rep"), F.col("rep").alias("_root"))
        root = lookup_join(rep, known, "rep", n).select("v", F.coalesce("_root", "rep").alias("rep"))
    root = cut_lineage(root)
    least = root.groupBy("rep").agg(F.min("v").alias("root"))
    return lookup_join(root, least, "rep", maps[0][1]).select(F.col("v").alias("member"), "root")
