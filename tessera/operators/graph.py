"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform
from tessera.functions.text import clean_str
from tessera.operators.components import connected_components
from tessera.session import stage_table


def symmetric(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Both directions of each edge, once: columns ``node``, ``nbr``. Loops stay single."""
    flip = edges.select(F.col(src).alias("node"), F.col(tgt).alias("nbr")).unionByName(edges.select(F.col(tgt).alias("node"), F.col(src).alias("nbr")))
    return flip.distinct()


def collapse(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Undirected edges once each, smaller end first."""
    return edges.select(F.least(src, tgt).alias("src"), F.greatest(src, tgt).alias("tgt")).distinct()


def degrees(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """``node``, ``degree``: every row counts at both ends, so parallel edges count and loops count 2."""
    return edges.select(F.explode(F.array(src, tgt)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def simple_degrees(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Degrees of the simple graph: parallel edges collapse, loops count 2."""
    return degrees(collapse(edges, src, tgt))


def edge_degrees(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges with ``rank``: the sum of their ends' degrees."""
    out = edges.join(of.select(F.col("node").alias("src"), F.col("degree").alias("__a")), "src", "left").join(of.select(F.col("node").alias("tgt"), F.col("degree").alias("__b")), "tgt", "left")
    return out.withColumn("rank", F.coalesce("__a", F.lit(0)) + F.coalesce("__b", F.lit(0))).drop("__a", "__b")


def degree_stats(of: DataFrame) -> DataFrame:
    """Largest, smallest, mean (2 decimals) and upper median degree, and the number of nodes.

    The median comes from the histogram of degrees, not from a sort of all nodes.
    """
    hist = of.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("degree")))
    return ranked.agg(F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.sum(F.col("degree") * F.col("n")) / F.sum("n"), 2).alias("mean_degree"), middle.alias("median_degree"), F.sum("n").alias("nodes"))


def value_counts(triples: DataFrame, *columns: str) -> DataFrame:
    """Counts by each of the columns alone, in one pass with grouping sets."""
    spread = triples.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns))).alias("x"))
    return spread.groupBy(F.col("x.facet").alias("facet"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def isolated(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Names in no triple."""
    ends = triples.select(F.explode(F.array("head", "tail")).alias("name")).distinct()
    return entities.select("name").distinct().join(ends, "name", "left_anti")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("tgt")).distinct(), "tgt", "left_semi").select(*edges.columns)


def with_missing_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes and the ends of edges that aren't among them."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(ends, allowMissingColumns=True)


def neighbours(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``nbr`` for the seed nodes."""
    return symmetric(edges).join(seeds.select("node").distinct(), "node", "left_semi")


def node_edges(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's edges as an array, empty where it has none or isn't there."""
    got = neighbours(ids, edges).groupBy("node").agg(F.array_sort(F.collect_set("nbr")).alias("nbrs"))
    return ids.join(got, "node", "left").withColumn("nbrs", F.coalesce("nbrs", F.array().cast("array<string>")))


def connected_within_two(pairs: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``hops``: 1 for an edge, 2 for a shared neighbour, else null.

    Starts from the pairs, so that only their ends' neighbours are joined, never all paths.
    """
    both = symmetric(edges)
    unique = pairs.select(a, b).distinct()
    ends = unique.select(F.explode(F.array(a, b)).alias("node")).distinct()
    near = stage_table(both.join(ends, "node", "left_semi"), "near")
    one = unique.join(near, (F.col(a) == F.col("node")) & (F.col(b) == F.col("nbr")), "left_semi").withColumn("h", F.lit(1))
    left = unique.join(near.select(F.col("node").alias(a), F.col("nbr").alias("mid")), a)
    right = near.select(F.col("node").alias(b), F.col("nbr").alias("mid"))
    two = left.join(right, [b, "mid"], "left_semi").select(a, b).distinct().withColumn("h", F.lit(2))
    hops = one.unionByName(two).groupBy(a, b).agg(F.min("h").alias("hops"))
    return pairs.join(hops, [a, b], "left")


def stable_largest_component(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the largest component (ties: the one with the smallest node), names cleaned and
    upper case, ends in order."""
    upper = lambda c: F.upper(clean_str(F.col(c)))
    found = stage_table(connected_components(edges, "src", "tgt"), "components")
    best = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    inside = found.join(F.broadcast(best), "component", "left_semi").select("node")  # one row
    kept = edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    return inside.select(upper("node").alias("node")), collapse(kept.select(upper("src").alias("src"), upper("tgt").alias("tgt")))


def component_stats(edges: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Number of components and size of the largest."""
    sizes = connected_components(edges, src, tgt).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes merged by key, the fresh value where there is one."""
    rows = stored.withColumn("__v", F.lit(0)).unionByName(fresh.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (*keys, "__v")]
    return rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__v"))).alias(c) for c in rest))


def hash_sample(rows: DataFrame, key: Column, n: int, seed: str = "42") -> DataFrame:
    """n rows by a hash of seed and key: the same for every layout of the input."""
    return rows.withColumn("__u", F.md5(F.concat(F.lit(seed), key.cast("string")))).orderBy("__u", key).limit(n).drop("__u")


def sample_anchors(of: DataFrame, budget: int, tail_ratio: float = 0.5, seed: str = "anchor") -> DataFrame:
    """``node``, ``degree``, ``kind``, ``anchor_rank``: long-tail nodes (degree at most the upper median) drawn
    without replacement by inverse degree, and head nodes drawn uniformly.

    Exponential keys give the same inclusion probabilities as drawing one by one (Efraimidis and Spirakis
    2006); a limit over ordered keys keeps what reaches one task to the budget.
    """
    live = of.where("degree > 0")
    median = degree_stats(live).select("median_degree").first()[0]
    n_tail = int(budget * tail_ratio)
    u = F.greatest(uniform(F.col("node"), seed), F.lit(2.0**-53))
    tail = live.where(F.col("degree") <= F.lit(median)).withColumn("w", -F.log(u) * (F.col("degree") + 1e-6)).orderBy("w", "node").limit(n_tail).withColumn("kind", F.lit("tail"))
    head = live.where(F.col("degree") > F.lit(median)).withColumn("w", -F.log(u)).orderBy("w", "node").limit(budget - n_tail).withColumn("kind", F.lit("head"))
    both = tail.unionByName(head)
    order = Window.orderBy(F.desc("kind"), "w", "node")  # at most ``budget`` rows
    return both.withColumn("anchor_rank", F.row_number().over(order) - 1).select("node", "degree", "kind", "anchor_rank")


def capped_bfs(anchors: DataFrame, edges: DataFrame, tail_depth: int = 2, head_depth: int = 1, cap: int = 50, seed: str = "bfs") -> DataFrame:
    """``anchor``, ``node``, ``rank``, ``level``: breadth-first from each anchor up to a depth and ``cap`` nodes.

    Equal to a queue that stops mid-expansion: within a level, nodes come by the rank of the first parent
    that reaches them, then by a seeded hash. Of a hub's neighbours only the first ``cap`` can be used by
    any parent, so the adjacency is cut to those before it is joined.
    """
    both = symmetric(edges).where("node <> nbr").withColumn("key", F.md5(F.concat(F.lit(seed), F.col("node"), F.lit("|"), F.col("nbr"))))
    start = anchors.select(F.col("node").alias("anchor"), "node", F.lit(0).alias("rank"), F.lit(0).alias("level"), F.when(F.col("kind") == "tail", tail_depth).otherwise(head_depth).alias("depth"))
    seen = stage_table(start, "bfs-0")
    # up to ``cap`` nodes are there already, so a parent's first 2 * cap neighbours hold all that it can add
    near = stage_table(both.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("key", "nbr"))).where(F.col("n") <= 2 * cap).drop("n"), "bfs-adjacency")
    for level in range(1, max(tail_depth, head_depth) + 1):
        front = seen.where((F.col("level") == level - 1) & (F.col("depth") >= level))
        reach = front.select("anchor", F.col("node").alias("parent"), F.col("rank").alias("parent_rank"), "depth").join(near.withColumnRenamed("node", "parent"), "parent")
        fresh = reach.join(seen.select("anchor", F.col("node").alias("nbr")), ["anchor", "nbr"], "left_anti")
        first = fresh.groupBy("anchor", "nbr").agg(F.min(F.struct("parent_rank", "key")).alias("by"), F.first("depth").alias("depth"))
        counts = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("have"))
        order = Window.partitionBy("anchor").orderBy("by.parent_rank", "by.key", "nbr")
        ranked = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).join(counts, "anchor").withColumn("rank", (F.col("n") + F.col("have") - 1).cast("int")).where(F.col("rank") < cap)
        seen = stage_table(seen.unionByName(ranked.select("anchor", F.col("nbr").alias("node"), "rank", F.lit(level).alias("level"), "depth")), f"bfs-{level}")
    return seen.drop("depth")


def induced_edges(members: DataFrame, edges: DataFrame, group: str = "anchor") -> DataFrame:
    """Undirected edges with both ends in the same group: ``group``, ``src``, ``tgt``."""
    flat = collapse(edges)
    a = members.select(group, F.col("node").alias("src"))
    b = members.select(group, F.col("node").alias("tgt"))
    return a.join(flat, "src").join(b, [group, "tgt"], "left_semi").select(group, "src", "tgt")


def communities(anchors: DataFrame, members: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """``community_id``, ``anchor``, ``kind``, ``degree``, sorted ``nodes``, ``n_edges``; small ones are dropped, ids run
    over the rest, tail anchors first."""
    grouped = members.groupBy("anchor").agg(F.array_sort(F.collect_list("node")).alias("nodes")).where(F.size("nodes") >= least)
    counts = induced_edges(members, edges).groupBy("anchor").agg(F.count(F.lit(1)).alias("n_edges"))
    out = grouped.join(anchors.withColumnRenamed("node", "anchor"), "anchor").join(counts, "anchor", "left")
    order = Window.orderBy("anchor_rank")  # one row per anchor
    return out.select((F.row_number().over(order) - 1).cast("long").alias("community_id"), "anchor", "kind", "degree", "nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def keyword_seeds(nodes: DataFrame, edges: DataFrame, word: str, limit: int) -> DataFrame:
    """Nodes whose name holds the word, up to max(50, limit / 4) by degree, then their neighbours until ``limit``."""
    of = simple_degrees(edges)
    cap = max(50, limit // 4)
    seeds = nodes.where(F.col("node").contains(word)).join(of, "node", "left").orderBy(F.desc_nulls_last("degree"), "node").limit(cap).select("node", F.lit(0).alias("hop"))
    near = neighbours(seeds, edges).select(F.col("nbr").alias("node")).distinct().join(seeds, "node", "left_anti").withColumn("hop", F.lit(1))
    return seeds.unionByName(near.select("node", "hop")).orderBy("hop", "node").limit(limit)


def top_degree(nodes: DataFrame, edges: DataFrame, types: list[str] | None, limit: int) -> DataFrame:
    rows = nodes if types is None else nodes.where(F.col("type").isin(*types))
    return rows.join(degrees(edges), "node").orderBy(F.desc("degree"), "node").limit(limit)
