"""Long-tail subgraph sampling: anchors, capped neighbourhoods, prompts, parsed questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parsing import qa_items
from tessera.operators import dedup, graph
from tessera.session import stage_table


def partition(edges: DataFrame, max_size: int = 50, min_size: int = 3, tail_ratio: float = 0.5, expansion_depth: int = 2, max_communities: int = 100, seed: str = "anchor") -> tuple[DataFrame, DataFrame]:
    """Communities and their members. ``edges``: src, tgt; taken as a simple undirected graph."""
    flat = stage_table(graph.collapse(edges), "simple-edges")
    anchors = stage_table(graph.sample_anchors(graph.degrees(flat), max_communities, tail_ratio, seed), "anchors")
    members = graph.capped_bfs(anchors, flat, expansion_depth, 1, max_size)
    return graph.communities(anchors, members, flat, min_size), members


def context(members: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 180, group: str = "anchor") -> DataFrame:
    """``group``, ``context``: lines of nodes, then of edges, the first ``most`` of them.

    ``nodes``: node, name, type; ``edges``: src, tgt, relation, relation_name.
    """
    named = members.join(nodes.select("node", "name", "type"), "node", "left")
    lines = named.select(group, F.lit(0).alias("k"), F.concat(F.lit("- ["), F.coalesce("type", F.lit("")), F.lit("] "), F.coalesce(F.nullif("name", F.lit("")), "node")).alias("line"))
    inside = graph.induced_edges(members, edges, group).join(edges.select("src", "tgt", F.coalesce(F.nullif("relation", F.lit("")), F.nullif("relation_name", F.lit("")), F.lit("related_to")).alias("rel")), ["src", "tgt"])
    names = nodes.select("node", F.coalesce(F.nullif("name", F.lit("")), "node").alias("n"))
    inside = inside.join(names.select(F.col("node").alias("src"), F.col("n").alias("u")), "src", "left").join(names.select(F.col("node").alias("tgt"), F.col("n").alias("v")), "tgt", "left")
    more = inside.select(group, F.lit(1).alias("k"), F.concat(F.coalesce("u", "src"), F.lit(" --["), "rel", F.lit("]--> "), F.coalesce("v", "tgt")).alias("line"))
    both = lines.unionByName(more).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("x"))
    return both.select(group, F.array_join(F.transform(F.slice("x", 1, most), lambda l: l["line"]), "\n").alias("context"))


def questions(contexts: DataFrame, ask: Callable[[Column], Column], n: int = 4, key: str = "community_id") -> DataFrame:
    """Questions that a model answers a community's prompt with, one per id; the last community's wins."""
    prompt = F.concat(F.lit(f"Write {n} questions as <qa> blocks about this graph:\n"), F.col("context"))
    replies = stage_table(contexts.select(key, ask(prompt).alias("reply")), "qa-replies")
    return dedup.latest_by(qa_items(replies, key_col=key), "qa_id", F.struct("community_id", "pos"))
