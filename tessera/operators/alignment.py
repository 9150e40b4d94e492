"""Entity alignment and the joins that apply it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import fuzzy_key


def exact_alignment(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """Names on both sides, as a mapping with confidence 1."""
    both = left.select(name).distinct().join(right.select(name).distinct(), name)
    return both.select(F.col(name).alias("guideline_entity"), F.col(name).alias("structured_entity"), F.lit("exact").alias("match_type"), F.lit(1.0).alias("confidence"))


def fuzzy_alignment(left: DataFrame, right: DataFrame, exact: DataFrame, name: str = "name") -> DataFrame:
    """Names that agree in their fuzzy key and aren't matched exactly; of names that share a key the
    smallest stands for it. Empty keys match nothing."""

    def keyed(side: DataFrame, matched: str, out: str) -> DataFrame:
        rest = side.select(F.col(name).alias(out)).distinct().join(exact.select(F.col(matched).alias(out)), out, "left_anti")
        return rest.withColumn("key", fuzzy_key(F.col(out)))

    a = keyed(left, "guideline_entity", "guideline_entity").where("key <> ''")
    b = keyed(right, "structured_entity", "structured_entity").where("key <> ''").groupBy("key").agg(F.min("structured_entity").alias("structured_entity"))
    return a.join(b, "key").select("guideline_entity", "structured_entity", F.lit("fuzzy").alias("match_type"), F.lit(0.95).alias("confidence"))


def learned_alignment(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """A model's mapping, restricted by confidence; the most confident, then smallest, name wins."""
    good = pairs.where(F.col("confidence") >= least)
    best = good.groupBy("guideline_entity").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "structured_entity")).alias("m"))
    return best.select("guideline_entity", F.col("m.structured_entity").alias("structured_entity"), F.lit("llm").alias("match_type"), (-F.col("m.c")).alias("confidence"))


def combine_alignments(base: DataFrame, learned: DataFrame) -> DataFrame:
    """The learned mapping overrides the base on the same name."""
    return base.join(learned, "guideline_entity", "left_anti").unionByName(learned)


def rewrite_names(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Heads and tails by the mapping, others unchanged."""
    one = mapping.groupBy("guideline_entity").agg(F.min("structured_entity").alias("to"))
    out = triples
    for c in ("head", "tail"):
        out = out.join(one.select(F.col("guideline_entity").alias(c), F.col("to").alias(f"__{c}")), c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out.select(*triples.columns)


def backfill_types(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Missing head and tail types from the entity table, else the default."""
    types = entities.groupBy("name").agg(F.min("type").alias("__t"))
    out = triples
    for c in ("head", "tail"):
        out = out.join(types.withColumnRenamed("name", c), c, "left").withColumn(f"{c}_type", F.coalesce(F.nullif(F.col(f"{c}_type"), F.lit("")), "__t", F.lit(V.DEFAULT_TYPE))).drop("__t")
    return out.select(*triples.columns)


def skip_existing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among those that are done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def hydrate(ids: DataFrame, table: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The table's row of each id, in the ids' order; missing ids have nulls."""
    return ids.join(table, key, "left").orderBy(position)
