"""Vector search and the local, global and naive retrieval contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import csv_section, tokens
from tessera.functions.vectors import cosine
from tessera.operators import community, graph
from tessera.operators.budget import prefix_within


def vector_topk(vectors: DataFrame, query: list[float], k: int = 20, threshold: float | None = 0.2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k vectors of largest cosine with the query, of those at the threshold or above; ties to the smaller id.

    One scan, and a top-k in each task before the last one.
    """
    score = cosine(F.col(vector_col), F.array(*(F.lit(float(x)) for x in query)))
    rows = vectors.select(F.col(id_col).alias("id"), score.alias("score")).where("score is not null")
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return rows.orderBy(F.desc("score"), "id").limit(k)


#: Vectors of a block, and queries that meet it at once.
BLOCK, ASKED = 8192, 4096


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 20, threshold: float | None = 0.2) -> DataFrame:
    """Exact top-k for a stated set of queries (``query_id``, ``vector``) against all vectors (``id``, ``vector``), which have
    one length. Null and zero vectors take no part; ties go to the smaller id.

    Blocks of vectors meet blocks of queries in tasks of bounded size, and at most k rows of a query leave each.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(vectors.dtypes)["id"], dict(queries.dtypes)["query_id"]
    usable = lambda c: F.col(c).isNotNull() & F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull())
    v = vectors.where(usable("vector")).select("id", F.col("vector").cast("array<double>").alias("vector"))
    q = queries.where(usable("vector")).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks, groups = max(1, -(-v.count() // BLOCK)), max(1, -(-q.count() // ASKED))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("g", each(groups))
    q = q.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("b", each(blocks))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if len(own) and len(asked):
            ids, x, y = own["id"].to_pylist(), matrix(own["vector"]), matrix(asked["vector"])
            size = np.sqrt(np.einsum("ij,ij->i", x, x))
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
            for name, one in zip(asked["query_id"].to_pylist(), y):
                score = np.einsum("ij,j->i", x, one) / (size * np.sqrt(one @ one))
                at = np.arange(len(score)) if threshold is None else np.flatnonzero(score >= threshold)
                if len(at) > k:
                    least = np.partition(score[at], len(at) - k)[len(at) - k]
                    at = at[score[at] >= least]
                for i in at[np.lexsort((rank[at], -score[at]))][:k].tolist():
                    out["query_id"].append(name)
                    out["id"].append(ids[i])
                    out["score"].append(float(score[i]))
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        return pa.table({"query_id": pa.array(out["query_id"], types[kind[1]]), "id": pa.array(out["id"], types[kind[0]]), "score": pa.array(out["score"], pa.float64())})

    rows = v.groupBy("b", "g").cogroup(q.groupBy("b", "g")).applyInArrow(best, f"query_id {kind[1]}, id {kind[0]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lsh_topk(vectors: DataFrame, query: list[float], k: int = 20, tables: int = 8, width: float = 1.0, seed: int = 42) -> DataFrame:
    """Approximate top-k by random projections of normalised vectors, for tables too large for a scan."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = Normalizer(inputCol="f", outputCol="u").transform(vectors.withColumn("f", array_to_vector(F.transform("vector", lambda x: x.cast("double")))))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    got = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k, distCol="d")
    return got.select("id", (1 - F.col("d") * F.col("d") / 2).alias("score")).orderBy(F.desc("score"), "id")


def text_units(seeds: DataFrame, node_chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chunk_id``, ``ord``, ``overlap``: chunks of the seed nodes by the first seed that cites them, and how many of that
    seed's neighbours cite them as well. Chunks cited by no seed don't appear.

    ``seeds``: node, ord; ``node_chunks``: node, chunk_id.
    """
    cited = seeds.join(node_chunks, "node")
    first = cited.groupBy("chunk_id").agg(F.min(F.struct("ord", "node")).alias("s")).select("chunk_id", "s.ord", "s.node")
    near = graph.neighbours(seeds, edges).where("node <> nbr")
    theirs = near.join(node_chunks.withColumnRenamed("node", "nbr"), "nbr").select("node", "nbr", "chunk_id").distinct()
    overlap = theirs.groupBy("node", "chunk_id").agg(F.count(F.lit(1)).alias("overlap"))
    return first.join(overlap, ["node", "chunk_id"], "left").select("chunk_id", "ord", F.coalesce("overlap", F.lit(0)).alias("overlap")).orderBy("ord", F.desc("overlap"), "chunk_id")


def related_edges(seeds: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """Edges at the seed nodes, once each, by rank and weight. ``edges``: src, tgt, weight, description."""
    flat = edges.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt")).groupBy("a", "b").agg(F.max("weight").alias("weight"), F.min("description").alias("description"))
    flat = flat.select(F.col("a").alias("src"), F.col("b").alias("tgt"), "weight", "description")
    ids = seeds.select("node").distinct()
    touching = flat.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(flat.join(ids.withColumnRenamed("node", "tgt"), "tgt", "left_semi")).distinct()
    return graph.edge_degrees(touching, of).orderBy(F.desc("rank"), F.desc("weight"), "src", "tgt")


def within_budget(rows: DataFrame, text: str, order: list[Column], budget: int) -> DataFrame:
    """The best rows whose texts fit into the token budget."""
    return prefix_within(rows.withColumn("__t", F.size(tokens(F.coalesce(F.col(text), F.lit(""))))), F.col("__t"), budget, order).drop("__t")


def local_context(hits: DataFrame, nodes: DataFrame, edges: DataFrame, node_chunks: DataFrame, chunks: DataFrame, clusters: DataFrame, reports: DataFrame, level: int = 2, report_budget: int = 3200, unit_budget: int = 4000, edge_budget: int = 4800) -> dict[str, DataFrame]:
    """The four sections of a local query, without any model call.

    ``hits``: node, ord (by similarity); ``nodes``: node, type, description; ``chunks``: chunk_id, content; ``reports``: cluster,
    rating, report. Nodes, reports and chunks that are missing are left out.
    """
    of = graph.simple_degrees(edges)
    entities = hits.join(nodes, "node").join(of, "node", "left").withColumn("rank", F.coalesce("degree", F.lit(0))).select("ord", "node", "type", "description", "rank").orderBy("ord")
    ranked = community.rank_communities(community.votes(hits, clusters, level), reports)
    picked = within_budget(ranked, "report", [F.desc("votes"), F.desc("rating"), F.col("cluster")], report_budget)
    units = within_budget(text_units(hits, node_chunks, edges).join(chunks, "chunk_id"), "content", [F.col("ord"), F.desc("overlap"), F.col("chunk_id")], unit_budget)
    related = within_budget(related_edges(hits, edges, of), "description", [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("tgt")], edge_budget)
    return {"reports": picked, "entities": entities, "relationships": related, "sources": units}


def render(rows: DataFrame, order: list[Column], cells: list[tuple[str, bool]]) -> DataFrame:
    """One row, ``section``: quoted lines with a header. What is rendered has been cut to a token budget."""
    numbered = rows.withColumn("id", F.row_number().over(Window.orderBy(*order)) - 1)
    got = numbered.agg(F.array_sort(F.collect_list(F.struct("id", *(c for c, _ in cells)))).alias("r"))
    return got.select(csv_section(["id", *(c for c, _ in cells)], F.col("r"), [("id", False), *cells]).alias("section"))


def naive_context(hits: DataFrame, chunks: DataFrame, budget: int = 12000) -> DataFrame:
    """One row, ``context``: the chunks found, best first, within the budget."""
    kept = within_budget(hits.join(chunks, hits["id"] == chunks["chunk_id"]), "content", [F.desc("score"), F.col("id")], budget)
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("score", "content")), asc=False), lambda x: x["content"]), "--New Chunk--\n").alias("context"))


def global_points(table: DataFrame, answer: Callable[[Column], Column], group_budget: int = 16384, point_budget: int = 16384, most: int = 512, least_rating: float = 0.0) -> DataFrame:
    """The map stage of a global query and its points. ``table``: cluster, occurrence, rating, report; ``answer``: a
    column function from a group's reports to ``points`` JSON."""
    from tessera.functions.parsing import salvage
    from tessera.operators.budget import pack_groups

    top = community.select_global(table, most, least_rating)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence")).alias("o"), (-F.col("rating")).alias("r"), F.col("cluster").alias("id"), F.size(tokens(F.col("report"))).alias("tokens"), "report"))), lambda x: F.struct(x["id"].alias("id"), x["tokens"].alias("tokens"), x["report"].alias("report")))
    packed = top.agg(ordered.alias("items")).select(F.explode(pack_groups(F.col("items"), group_budget)).alias("p")).select(F.col("p.id").alias("cluster"), F.col("p.group").alias("group"))
    groups = packed.join(top, "cluster").groupBy("group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence")).alias("o"), "cluster", "report"))), lambda x: x["report"]), "\n").alias("reports"))
    points = groups.select("group", F.explode(salvage(answer(F.col("reports")), "object", "points array<struct<description string, score double>>")["points"]).alias("p")).select("group", "p.description", "p.score")
    return community.select_points(points, point_budget)
