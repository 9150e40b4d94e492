"""Merging triples and entities of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import strip

KEY = ["head", "relation", "tail"]


def sorted_sources(lists: Column) -> Column:
    """Comma-joined lists as one sorted list without repeats."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(F.filter(lists, lambda s: s.isNotNull()), lambda s: F.transform(F.split(s, ","), strip))), lambda s: s != ""))), ",")


def dedup_triples(triples: DataFrame, order: str = "ord") -> DataFrame:
    """One row per (head, relation, tail) with no null among them: the first row's columns, the sources'
    sorted union, and the first description of more than 5 characters, else the first row's."""
    rows = triples.dropna(subset=KEY)
    others = [c for c in triples.columns if c not in (*KEY, order, "source", "description")]
    long = F.length("description") > 5
    out = rows.groupBy(*KEY).agg(
        *(F.min_by(F.struct(c), order)[c].alias(c) for c in others),
        F.min(order).alias(order),
        sorted_sources(F.collect_set("source")).alias("source"),
        F.coalesce(F.min_by("description", F.when(long, F.col(order))), F.min_by(F.struct("description"), order)["description"]).alias("description"),
        F.count(F.lit(1)).alias("merged"),
    )
    return out.withColumn("both_sources", F.col("source").contains(","))


def merge_entities(entities: DataFrame, order: str = "ord") -> DataFrame:
    """One row per name: the first type, the first three descriptions of more than 5 characters (300 each,
    800 in all), the sources' sorted union."""
    described = F.when(F.length("description") > 5, F.struct(F.col(order).alias("o"), F.left("description", F.lit(300)).alias("d")))
    # what a name's descriptions need is their first three: ranked before they are collected
    ranked = entities.where(F.length("description") > 5).withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy(order))).where("rn <= 3")
    texts = ranked.groupBy("name").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(described)), lambda x: x["d"]), " | "), F.lit(800)).alias("description"))
    head = entities.where("name is not null").groupBy("name").agg(F.coalesce(F.min_by("type", F.when(F.col("type").isNotNull(), F.col(order))), F.lit(V.DEFAULT_TYPE)).alias("type"), sorted_sources(F.collect_set("source")).alias("source"))
    return head.join(texts, "name", "left").select("name", "type", F.coalesce("description", F.lit("")).alias("description"), "source")


def conflict_pairs(triples: DataFrame) -> DataFrame:
    """(head, tail) pairs with several relations, for a judge of redundancy."""
    return triples.groupBy("head", "tail").agg(F.array_sort(F.collect_set("relation")).alias("relations")).where(F.size("relations") > 1)


def remove_triples(triples: DataFrame, unwanted: DataFrame) -> DataFrame:
    return triples.join(unwanted.select(*KEY).distinct(), KEY, "left_anti")


def new_triples(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates that aren't known, each once."""
    return candidates.dropna(subset=KEY).dropDuplicates(KEY).join(known.select(*KEY).distinct(), KEY, "left_anti")


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def latest_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__n = 1").drop("__n")


def merge_nodes(mentions: DataFrame, order: str = "ord") -> DataFrame:
    """One row per entity: the type most mentioned (ties: met first), distinct descriptions sorted and
    joined, chunk ids. ``ord`` puts new rows before stored ones."""
    votes = mentions.groupBy("entity_name", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    kind = votes.groupBy("entity_name").agg(F.max_by("entity_type", F.struct("n", (-F.col("o")).alias("o"))).alias("entity_type"))
    rest = mentions.groupBy("entity_name").agg(F.array_join(F.array_sort(F.collect_set("description")), V.FIELD_SEP).alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return kind.join(rest, "entity_name")


def merge_edges(mentions: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per undirected pair (weights summed, least order, distinct descriptions and chunks), and the
    nodes with the endpoints that were missing."""
    rows = mentions.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt"))
    edges = rows.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.sum("weight").alias("weight"), F.min("ord").cast("int").alias("ord"), F.array_join(F.array_sort(F.collect_set("description")), V.FIELD_SEP).alias("description"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    ends = edges.select(F.col("src").alias("entity_name"), "description", "source_ids").unionByName(edges.select(F.col("tgt").alias("entity_name"), "description", "source_ids"))
    missing = ends.join(nodes.select("entity_name"), "entity_name", "left_anti").groupBy("entity_name").agg(F.min_by("description", "description").alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_ids")))).alias("source_ids"))
    return edges, nodes.unionByName(missing.select("entity_name", F.lit(V.NO_TYPE).alias("entity_type"), "description", "source_ids"))


def summarise_long(rows: DataFrame, summarise, token_count: Column, limit: int = 500) -> DataFrame:
    """Descriptions of ``limit`` tokens and more by ``summarise`` (a column function)."""
    return rows.withColumn("description", F.when(token_count >= limit, summarise(F.col("description"))).otherwise(F.col("description")))
