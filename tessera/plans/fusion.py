"""Knowledge-graph fusion in six steps, each a function from tables to tables.

Model calls are columns: a cached table of answers joined by the key of the prompt. Each step's tables are
written before the next step reads them, so any step can be run alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.hashing import prompt_key
from tessera.functions.text import guideline_type, prefix, tail_type
from tessera.operators import alignment, dedup, evaluate, graph
from tessera.operators.budget import batches, top_n
from tessera.sources.readers import missing_to_null
from tessera.sources.sinks import export_edges, export_nodes

COMPLETION_TYPES = ("疾病", "症状", "检查", "药物")
RICH_TYPES = ("疾病", "症状", "检查", "药物", "手术治疗", "病原体")


def answered(prompts: DataFrame, answers: DataFrame, ask: Callable[[Column], Column] | None = None, prompt: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Prompts with their ``reply``, and the answers table with what was asked anew.

    Each distinct prompt without a cached answer is asked once; ``ask`` is a column function (an Arrow UDF
    around a model). Without it, such prompts have a null reply.
    """
    keyed = prompts.withColumn("__k", prompt_key(F.col(prompt)))
    known = answers
    if ask is not None:
        from tessera.session import stage_table

        pending = keyed.select(F.col("__k").alias("key"), F.col(prompt).alias("p")).dropDuplicates(["key"]).join(answers, "key", "left_anti")
        known = stage_table(answers.select("key", "reply").unionByName(pending.select("key", ask(F.col("p")).alias("reply"))), "answers")
    return keyed.join(known.select(F.col("key").alias("__k"), "reply"), "__k", "left").drop("__k"), known


def standardise_guideline(nodes: DataFrame, edges: DataFrame, learned_types: DataFrame | None = None, learned_relations: DataFrame | None = None, structured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Guideline entities with unified types, and triples whose relation a model named from the first 100 characters
    of the edge's description (else 相关)."""
    types = nodes
    if learned_types is not None:
        types = types.join(learned_types.withColumnRenamed("type", "__l"), "type_raw", "left")
    else:
        types = types.withColumn("__l", F.lit(None).cast("string"))
    entities = types.select(missing_to_null(F.col("name")).alias("name"), guideline_type(F.col("type_raw"), F.col("__l")).alias("type"), "description", F.lit("guideline").alias("source")).where("name is not null")
    rows = edges.withColumn("__d", prefix(F.col("description"), 100))
    if learned_relations is not None:
        rows = rows.join(learned_relations.select(F.col("description").alias("__d"), "relation"), "__d", "left")
    else:
        rows = rows.withColumn("relation", F.lit(None).cast("string"))
    triples = rows.select(missing_to_null(F.col("head")).alias("head"), F.lit(None).cast("string").alias("head_type"), F.coalesce("relation", F.lit("相关")).alias("relation"), missing_to_null(F.col("tail")).alias("tail"), F.lit(None).cast("string").alias("tail_type"), F.lit("guideline").alias("source"), "description", "weight")
    return entities, alignment.backfill_types(triples.dropna(subset=dedup.KEY), entities)


def fill_tail_types(triples: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Missing tail types by the relation's rule, then a model's (by relation and head type), then the default."""
    now = triples.withColumn("tail_type", tail_type(F.col("relation"), F.col("head_type"), F.col("tail_type")))
    if learned is not None:
        now = now.join(learned.withColumnRenamed("tail_type", "__l"), ["relation", "head_type"], "left").withColumn("tail_type", F.coalesce("tail_type", "__l")).drop("__l")
    return now.withColumn("tail_type", F.coalesce("tail_type", F.lit(V.DEFAULT_TYPE)))


def align(guideline: DataFrame, structured: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    exact = alignment.exact_alignment(guideline, structured)
    base = exact.unionByName(alignment.fuzzy_alignment(guideline, structured, exact))
    return base if learned is None else alignment.combine_alignments(base, alignment.learned_alignment(learned))


def alignment_prompts(guideline: DataFrame, structured: DataFrame, mapping: DataFrame, size: int = 40, names: int = 100) -> DataFrame:
    """Batches of unmatched guideline names of a type with up to ``names`` of the structured source's."""
    open_names = guideline.join(mapping.select(F.col("guideline_entity").alias("name")), "name", "left_anti").select("type", "name").distinct()
    open_names = top_n(open_names, 2000, [F.col("name")], ["type"])
    known = top_n(structured.select("type", "name").distinct(), names, [F.col("name")], ["type"]).groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("known"))
    asked = batches(open_names, size, [F.col("name")], ["type"]).groupBy("type", "batch").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("open"))
    return asked.join(known, "type").select("type", "batch", F.concat(F.lit("Match names of type "), "type", F.lit(".\nA: "), "open", F.lit("\nB: "), "known").alias("prompt"))


def merge(structured: DataFrame, guideline: DataFrame, mapping: DataFrame, redundant: DataFrame | None = None) -> DataFrame:
    """All triples under aligned names, merged; weights and confidences 1 where there are none."""
    both = dedup.union_sources(alignment.rewrite_names(guideline, mapping).withColumn("ord", F.lit(0).cast("long")), structured.withColumn("ord", F.lit(1).cast("long")))
    both = both.withColumn("ord", F.col("ord") * F.lit(1 << 60) + F.pmod(F.xxhash64("head", "relation", "tail", "source"), F.lit(1 << 59)))
    merged = dedup.dedup_triples(both.withColumn("description", F.coalesce("description", F.lit("")))).withColumn("confidence", F.lit(1.0)).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return merged if redundant is None else dedup.remove_triples(merged, redundant)


def rich_entities(entities: DataFrame, triples: DataFrame, most: int = 500, relations: int = 10) -> DataFrame:
    """Entities of some types described in more than 50 characters, longest first, with up to ``relations`` of theirs."""
    picked = entities.where(F.col("type").isin(*RICH_TYPES) & (F.length("description") > 50)).orderBy(F.desc(F.length("description")), "name").limit(most)
    own = top_n(triples.select(F.col("head").alias("name"), "relation", "tail"), relations, [F.col("relation"), F.col("tail")], ["name"]).groupBy("name").agg(F.array_sort(F.collect_list(F.concat_ws(" ", "relation", "tail"))).alias("known"))
    return picked.join(own, "name", "left")


def sparse_entities(entities: DataFrame, triples: DataFrame, most: int = 200, degree: int = 3, types: tuple[str, ...] = COMPLETION_TYPES) -> DataFrame:
    """Entities of some types in at most ``degree`` triples, by name."""
    of = graph.degrees(triples, "head", "tail")
    rows = entities.where(F.col("type").isin(*types)).join(of.withColumnRenamed("node", "name"), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.where(F.col("degree") <= degree).orderBy("name").limit(most)


def complete(triples: DataFrame, extracted: DataFrame, inferred: DataFrame) -> DataFrame:
    """Triples with those a model found: extracted ones with confidence 0.8, inferred ones with their own, 0.9 at most.
    Both are checked against all that is there, and against each other."""
    first = dedup.new_triples(extracted, triples).withColumn("confidence", F.lit(0.8)).withColumn("source", F.lit("inferred"))
    second = dedup.new_triples(inferred, triples.select(*dedup.KEY).unionByName(first.select(*dedup.KEY))).withColumn("confidence", F.least(F.coalesce("confidence", F.lit(0.9)), F.lit(0.9))).withColumn("source", F.lit("inferred"))
    return dedup.union_sources(triples, first, second)


def statistics(triples: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    of = graph.degrees(triples, "head", "tail")
    return {
        "by_facet": graph.value_counts(triples, "source", "relation"), "by_type": graph.value_counts(entities, "type"), "degrees": graph.degree_stats(of),
        "isolated": graph.isolated(entities, triples), "components": graph.component_stats(triples, "head", "tail"),
    }


def quality_sample(triples: DataFrame, n: int = 200, seed: str = "42") -> DataFrame:
    return graph.hash_sample(triples, F.concat_ws("|", "head", "relation", "tail"), n, seed)


@dataclass
class Fusion:
    """The steps over a folder of tables. ``run()``: all; ``run(only=n)``: one; ``run(upto=n)``: the first n."""

    spark: SparkSession
    folder: str
    structured: Callable[[], DataFrame]
    guideline: Callable[[], tuple[DataFrame, DataFrame]]
    learned: dict[str, DataFrame] = field(default_factory=dict)

    def _put(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")

    def _get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def step1(self) -> None:
        structured = fill_tail_types(self.structured(), self.learned.get("tail_types"))
        entities, triples = standardise_guideline(*self.guideline(), self.learned.get("types"), self.learned.get("relations"))
        self._put("structured", structured)
        self._put("guideline", triples)
        self._put("entities", entities)

    def step2(self) -> None:
        s = self._get("structured")
        names = s.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.col("head_type").alias("type")), F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("type")))).alias("x")).select("x.*").distinct()
        self._put("structured_entities", names)
        self._put("mapping", align(self._get("entities"), names, self.learned.get("alignment")))

    def step3(self) -> None:
        mapping = self._get("mapping")
        self._put("merged", merge(self._get("structured"), self._get("guideline"), mapping, self.learned.get("redundant")))
        g = self._get("entities").join(mapping.groupBy(F.col("guideline_entity").alias("name")).agg(F.min("structured_entity").alias("to")), "name", "left").withColumn("name", F.coalesce("to", "name")).drop("to").withColumn("ord", F.lit(0).cast("long"))
        s = self._get("structured_entities").withColumn("description", F.lit("")).withColumn("source", F.lit("medical_kg")).withColumn("ord", F.lit(1).cast("long"))
        both = g.unionByName(s).withColumn("ord", F.col("ord") * F.lit(1 << 60) + F.pmod(F.xxhash64("name", "type", "description"), F.lit(1 << 59)))
        self._put("merged_entities", dedup.merge_entities(both))

    def step4(self) -> None:
        none = self.spark.createDataFrame([], "head string, head_type string, relation string, tail string, tail_type string, confidence double")
        self._put("completed", complete(self._get("merged"), self.learned.get("extracted", none), self.learned.get("inferred", none)))

    def step5(self) -> None:
        for name, df in statistics(self._get("completed"), self._get("merged_entities")).items():
            self._put(f"report_{name}", df)
        if "scores" in self.learned:
            self._put("report_scores", evaluate.score_validation(self.learned["scores"]))

    def step6(self) -> None:
        triples = self._get("completed")
        self._put("nodes", export_nodes(triples, self._get("merged_entities")))
        self._put("edges", export_edges(triples))

    def run(self, only: int | None = None, upto: int = 6) -> None:
        for n in [only] if only else range(1, upto + 1):
            getattr(self, f"step{n}")()
