"""Communities: hierarchical clustering, assembly, votes, ranking and description."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_section, tokens
from tessera.operators.budget import prefix_within, split_budget
from tessera.operators.components import connected_components
from tessera.session import stage_table


def _local_moves(adj: dict, label: dict, within: dict | None = None) -> dict:
    """Leiden's moves of nodes between neighbouring clusters while modularity grows, on a small weighted graph. A queue
    holds the nodes whose surroundings changed. ``within``: clusters that moves stay inside (then only nodes that are
    alone and well connected to the rest of their cluster move, which is the refinement)."""
    strength = {v: sum(ws.values()) for v, ws in adj.items()}
    twice = sum(strength.values()) or 1.0
    total: dict = {}
    size: dict = {}
    for v, c in label.items():
        total[c] = total.get(c, 0.0) + strength[v]
        size[c] = size.get(c, 0) + 1
    outer: dict = {}
    if within:
        for v, c in within.items():
            outer[c] = outer.get(c, 0.0) + strength[v]
    work = deque(sorted(adj))
    queued = set(work)
    while work:
        v = work.popleft()
        queued.discard(v)
        own, links = label[v], {}
        for u, w in adj[v].items():
            if u != v and (within is None or within[u] == within[v]):
                links[label[u]] = links.get(label[u], 0.0) + w
        if within is not None:
            rest = outer[within[v]] - strength[v]
            if size[own] > 1 or sum(links.values()) < strength[v] * rest / twice - 1e-12:
                continue
        total[own] -= strength[v]
        stay = links.get(own, 0.0) - strength[v] * total[own] / twice
        best = max(sorted(links), key=lambda c: links[c] - strength[v] * total[c] / twice, default=own)
        if links.get(best, 0.0) - strength[v] * total[best] / twice > stay + 1e-12:
            size[own] -= 1
            size[best] += 1
            label[v] = best
            if within is None:
                for u in adj[v]:
                    if label[u] != best and u not in queued:
                        queued.add(u)
                        work.append(u)
        total[label[v]] += strength[v]
    return label


def _clusters(adj: dict) -> dict:
    """Node to cluster (its smallest node) by the Leiden method (Traag et al. 2019): moves, refinement of each cluster from
    single nodes, contraction by the refined clusters with the moves' clusters as a start, and again. Refined clusters
    grow along links only, so a cluster is connected. The merge with the largest gain is taken instead of a random one, so
    that runs agree."""
    member = {v: v for v in adj}  # node to node of the contracted graph
    graph, label = adj, {v: v for v in adj}
    while True:
        label = _local_moves(graph, label)
        if len({*label.values()}) == len(graph):
            break
        fine = _local_moves(graph, {v: v for v in graph}, label)
        if len({*fine.values()}) == len(graph):
            fine = label  # nothing was refined: contract by the clusters themselves
        member = {v: fine[c] for v, c in member.items()}
        nxt: dict = {}
        for v, ws in graph.items():
            row = nxt.setdefault(fine[v], {})
            for u, w in ws.items():
                row[fine[u]] = row.get(fine[u], 0.0) + w
        first: dict = {}
        for v in sorted(graph):
            first.setdefault(label[v], fine[v])
        label = {fine[v]: first[label[v]] for v in graph}
        graph = nxt
    found = {v: label[c] for v, c in member.items()}
    out: dict = {}
    for v in sorted(adj):  # the connected part of its cluster that a node is in, by its smallest node
        if v not in out:
            out[v], stack = v, [v]
            while stack:
                for u in adj[stack.pop()]:
                    if u not in out and found[u] == found[v]:
                        out[u] = v
                        stack.append(u)
    return out


def _hierarchy(edges: pd.DataFrame, most: int, levels: int) -> list[tuple]:
    """(node, level, cluster) rows: clusters over ``most`` nodes are clustered again one level below."""
    rows: list[tuple] = []
    work = [(0, "", edges)]
    while work:
        level, parent, es = work.pop()
        adj: dict = {}
        for a, b, w in es[["src", "tgt", "weight"]].itertuples(index=False):
            adj.setdefault(a, {})[b] = adj.get(a, {}).get(b, 0.0) + w
            if a != b:
                adj.setdefault(b, {})[a] = adj.get(b, {}).get(a, 0.0) + w
        label = _clusters(adj)
        groups: dict = {}
        for v, c in label.items():
            groups.setdefault(c, []).append(v)
        if len(groups) == 1 and level:
            continue  # it can't be split
        for c, vs in sorted(groups.items()):
            name = f"{parent}/{c}" if parent else str(c)
            rows += [(v, level, name) for v in sorted(vs)]
            if len(vs) > most and level + 1 < levels:
                inside = set(vs)
                work.append((level + 1, name, es[es["src"].isin(inside) & es["tgt"].isin(inside)]))
    return rows


def hierarchical_communities(edges: DataFrame, max_cluster_size: int = 10, levels: int = 10, largest_only: bool = True) -> DataFrame:
    """``node``, ``level``, ``cluster``: nested clusters by the Leiden method on modularity, level 0 first.

    Clusters of more than ``max_cluster_size`` nodes are clustered again below. Components are clustered on
    their own; with ``largest_only`` only the largest has clusters. A component is one task's work, as the
    moves are sequential: for graphs whose component exceeds a task's memory, cut it first (see
    ``graph.capped_bfs``).
    """
    flat = stage_table(edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), *([F.col("weight").cast("double").alias("weight")] if "weight" in edges.columns else [F.lit(1.0).alias("weight")])).groupBy("src", "tgt").agg(F.sum("weight").alias("weight")), "cluster-edges")
    found = connected_components(flat, "src", "tgt")
    if largest_only:
        best = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
        found = found.join(F.broadcast(best.select("component")), "component", "left_semi")  # one row
    kind = flat.schema["src"].dataType.simpleString()

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_hierarchy(pdf, max_cluster_size, levels), columns=["node", "level", "cluster"])

    return flat.join(found.withColumnRenamed("node", "src"), "src").groupBy("component").applyInPandas(cluster, f"node {kind}, level int, cluster string")


def assemble(clusters: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``cluster``, ``level``, ``nodes``, ``edges`` (touching the community, ends in order), ``chunk_ids``, ``occurrence`` (share of
    the largest number of chunks).

    ``clusters``: node, level, cluster; ``chunks``: node, chunk_id.
    """
    nodes = clusters.groupBy("level", "cluster").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    flat = edges.select(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).distinct()
    ends = flat.select(F.explode(F.array("a", "b")).alias("node"), "a", "b").distinct()
    touching = clusters.join(ends, "node").select("level", "cluster", "a", "b").distinct().groupBy("level", "cluster").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("edges"))
    cited = clusters.join(chunks, "node").select("level", "cluster", "chunk_id").distinct().groupBy("level", "cluster").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    out = nodes.join(touching, ["level", "cluster"], "left").join(cited, ["level", "cluster"], "left")
    n = F.when(F.col("chunk_ids").isNull(), 0).otherwise(F.size("chunk_ids"))
    out = out.withColumn("__n", n)
    most = cited.agg(F.max(F.size("chunk_ids")).alias("__most")).select("__most", F.lit(0).alias("__k"))  # one row
    return out.withColumn("__k", F.lit(0)).join(F.broadcast(most), "__k", "left").drop("__k").withColumn("occurrence", F.col("__n") / F.nullif(F.col("__most"), F.lit(0))).drop("__n", "__most")


def sub_communities(clusters: DataFrame, any_deeper: bool = False) -> DataFrame:
    """``parent``, ``child``: communities of the next level (or any deeper one) all of whose nodes the parent has.

    Shared nodes are counted through an equi-join on the node; a child is inside where all of them are shared.
    """
    size = clusters.groupBy("level", "cluster").agg(F.count(F.lit(1)).alias("n"))
    p = clusters.select(F.col("level").alias("pl"), F.col("cluster").alias("parent"), "node")
    c = clusters.select(F.col("level").alias("cl"), F.col("cluster").alias("child"), "node")
    deeper = F.col("cl") > F.col("pl") if any_deeper else F.col("cl") == F.col("pl") + 1
    shared = p.join(c, "node").where(deeper).groupBy("pl", "parent", "cl", "child").agg(F.count(F.lit(1)).alias("k"))
    return shared.join(size, (F.col("cl") == F.col("level")) & (F.col("child") == F.col("cluster"))).where("k = n").select("pl", "parent", "cl", "child")


def votes(hits: DataFrame, clusters: DataFrame, level: int) -> DataFrame:
    """Communities of the retrieved nodes up to a level, by number of hits."""
    return hits.join(clusters.where(F.col("level") <= level), "node").groupBy("cluster").agg(F.count(F.lit(1)).alias("votes"))


def rank_communities(voted: DataFrame, reports: DataFrame) -> DataFrame:
    """By votes, then rating (-1 where there is none); communities without a report are left out."""
    return voted.join(reports, "cluster").withColumn("rating", F.coalesce("rating", F.lit(-1.0))).orderBy(F.desc("votes"), F.desc("rating"), "cluster")


def select_global(table: DataFrame, most: int = 512, least_rating: float = 0.0) -> DataFrame:
    """The ``most`` communities by occurrence, of those the ones rated enough, by occurrence and rating."""
    top = table.orderBy(F.desc("occurrence"), "cluster").limit(most).withColumn("rating", F.coalesce("rating", F.lit(0.0)))
    return top.where(F.col("rating") >= least_rating).orderBy(F.desc("occurrence"), F.desc("rating"), "cluster")


def select_points(points: DataFrame, budget: int) -> DataFrame:
    """Points with a description and a score (1 by default) above 0, best first, within the budget."""
    rows = points.where("description is not null").withColumn("score", F.coalesce("score", F.lit(1))).where("score > 0")
    return prefix_within(rows.withColumn("__t", F.size(tokens(F.col("description")))), F.col("__t"), budget, [F.desc("score"), F.col("description")]).drop("__t")


_NODE = [("node", True), ("type", True), ("description", True), ("degree", False)]
_EDGE = [("src", True), ("tgt", True), ("description", True), ("rank", False)]


def _cells(cells: list[tuple[str, bool]]) -> Column:
    """The tokens of a line."""
    return F.size(tokens(F.concat_ws(" ", *(F.col(c).cast("string") for c, _ in cells))))


def describe(members: DataFrame, edges: DataFrame, budget: int = 12000, children: DataFrame | None = None) -> DataFrame:
    """``cluster``, ``context``: nodes by degree and edges by rank as quoted lines, each within its share of the budget.

    ``members``: cluster, node, type, description, degree; ``edges``: cluster, src, tgt, description, rank. With
    ``children`` (parent, child, report, rating, occurrence, child_nodes, child_edges) a community whose nodes and edges
    don't all fit has the reports of its parts first, by occurrence within the budget; what those tell of comes last
    among the nodes and edges, which share what is left.
    """
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(_cells(_NODE) + 1).alias("t_nodes"))
    m = edges.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(_cells(_EDGE) + 1).alias("t_edges"))
    sizes = n.join(m, "cluster", "left").withColumns({"n_edges": F.coalesce("n_edges", F.lit(0)), "t_edges": F.coalesce("t_edges", F.lit(0))})
    if children is None:
        sizes = sizes.withColumns({"reports": F.lit(None).cast("string"), "left": F.lit(budget)})
        members, edges = members.withColumn("told", F.lit(False)), edges.withColumn("told", F.lit(False))
    else:
        wide = sizes.where(F.col("t_nodes") + F.col("t_edges") > budget).select(F.col("cluster").alias("parent"))
        packed = stage_table(pack_children(children.join(wide, "parent"), budget), "packed-children")
        order = Window.partitionBy("parent").orderBy(F.desc("occurrence"), "child")
        rows = packed.withColumn("id", F.row_number().over(order) - 1).withColumn("rating", F.coalesce("rating", F.lit(-1.0)))
        section = csv_section(["id", "report", "rating", "importance"], F.array_sort(F.collect_list(F.struct("id", "report", "rating", "occurrence"))), [("id", False), ("report", True), ("rating", False), ("occurrence", False)])
        told = rows.groupBy(F.col("parent").alias("cluster")).agg(section.alias("reports"), F.sum(F.size(tokens(F.col("report"))) + 1).alias("used"))
        sizes = sizes.join(told, "cluster", "left").withColumn("left", F.greatest(F.lit(budget) - F.coalesce("used", F.lit(0)), F.lit(0)).cast("int"))
        nodes = packed.select(F.col("parent").alias("cluster"), F.explode("child_nodes").alias("node")).distinct().withColumn("told", F.lit(True))
        ends = packed.select(F.col("parent").alias("cluster"), F.explode("child_edges").alias("e")).select("cluster", F.col("e.a").alias("src"), F.col("e.b").alias("tgt")).distinct().withColumn("told", F.lit(True))
        members = members.join(nodes, ["cluster", "node"], "left").withColumn("told", F.coalesce("told", F.lit(False)))
        edges = edges.join(ends, ["cluster", "src", "tgt"], "left").withColumn("told", F.coalesce("told", F.lit(False)))
    for_nodes, for_edges = split_budget(F.col("left"), F.col("n_nodes"), F.col("n_edges"))
    sizes = sizes.withColumn("bn", for_nodes).withColumn("be", for_edges)

    def section(rows: DataFrame, limit: str, order: list[Column], cells: list[tuple[str, bool]], name: str) -> DataFrame:
        rows = rows.join(sizes.select("cluster", limit), "cluster").withColumn("__c", _cells(cells))
        rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("cluster").orderBy("told", *order)) - 1)
        rows = prefix_within(rows, F.col("__c"), F.col(limit), [F.col("id")], ["cluster"])
        got = rows.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("id", *(c for c, _ in cells)))).alias("r"))
        return got.select("cluster", csv_section(["id", *(c for c, _ in cells)], F.col("r"), [("id", False), *cells]).alias(name))

    a = section(members, "bn", [F.desc("degree"), F.col("node")], _NODE, "entities")
    b = section(edges, "be", [F.desc("rank"), F.col("src"), F.col("tgt")], _EDGE, "relationships")
    both = sizes.select("cluster", "reports").join(a, "cluster", "left").join(b, "cluster", "left").where("reports is not null or entities is not null")
    head = F.coalesce(F.concat(F.lit("-----Reports-----\n"), "reports", F.lit("\n")), F.lit(""))
    return both.select("cluster", F.concat(head, F.lit("-----Entities-----\n"), F.coalesce("entities", F.lit("")), F.lit("\n-----Relationships-----\n"), F.coalesce("relationships", F.lit(""))).alias("context"))


def pack_children(children: DataFrame, budget: int) -> DataFrame:
    """Child reports by occurrence within the budget of each parent. ``children``: parent, child, occurrence, report."""
    return prefix_within(children.withColumn("__t", F.size(tokens(F.col("report")))), F.col("__t"), budget, [F.desc("occurrence"), F.col("child")], ["parent"]).drop("__t")
