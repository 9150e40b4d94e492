"""Sources: every reader takes an explicit schema and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import normal_name, remap, strip, strip_chars
from tessera.operators.graph import valid_edges, with_missing_nodes

# Columns of the files that are read.
STRUCTURED = "entity1_norm string, entity1_type string, relation_canonical string, entity2_norm string, entity2_type string"
CHOICE_QUESTION = "id string, question string, option map<string,string>, question_type string, exam_type string"
CHOICE_ANSWER = "id string, answer string"
EMR_CASE = "custom_id string, system string, instruction string, input string, output string"
KGQA_CASE = "instruction string, input string, output string"
TRAINING = "instruction string, input string, output string, standard_output string"
METRICS = "step long, epoch double, loss double, grad_norm double, learning_rate double, reward double, reward_std double, kl double"

#: Texts that a CSV reader of the fusion steps takes for a missing value.
MISSING = ("", "nan", "NaN", "null", "NULL", "NA", "N/A", "n/a", "None", "<NA>", "#N/A")


def structured_triples(spark: SparkSession, path: str) -> DataFrame:
    """The structured source as standard triples: names normalised, types and relations remapped."""
    rows = spark.read.schema(STRUCTURED).option("header", True).option("escape", '"').csv(path)
    return standardise(rows.toDF("head", "head_type", "relation", "tail", "tail_type"))


def missing_to_null(x: Column) -> Column:
    return F.when(~x.isin(*MISSING), x)


def standardise(rows: DataFrame) -> DataFrame:
    """Unified types and relations. A missing head type is the default; an unknown relation stays itself."""
    kind = lambda c: remap(F.col(c), V.STRUCTURED_TYPES, V.DEFAULT_TYPE)
    return rows.select(
        missing_to_null(normal_name(F.col("head"))).alias("head"), kind("head_type").alias("head_type"), remap(strip(F.col("relation")), V.RELATIONS).alias("relation"),
        missing_to_null(normal_name(F.col("tail"))).alias("tail"), F.when(F.col("tail_type").isNotNull(), kind("tail_type")).alias("tail_type"), F.lit("medical_kg").alias("source"),
    ).dropna(subset=["head", "relation", "tail"])


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of XML documents that may go over several files. Spark's default parser takes a file for a document: of a file
    without a single root, or with no such element, it gives one null row instead. The legacy parser looks for the tags."""
    return spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(schema).load(path)


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML files: ids unquoted and lower case, descriptions cut to 500 and 300 characters,
    types and weights with defaults. Attribute keys are the names declared in the file's ``key`` elements."""
    data = "data array<struct<_VALUE: string, _key: string>>"
    keys = _elements(spark, path, "key", "_id string, _for string, `_attr.name` string")

    def attributes(rows: DataFrame, kind: str) -> DataFrame:
        mine = keys.where(F.col("_for").isin(kind, "all") | F.col("_for").isNull())
        names = F.broadcast(mine.agg(F.map_from_entries(F.collect_set(F.struct("_id", "`_attr.name`"))).alias("names")))  # one row
        named = F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]), d["_VALUE"]))
        return rows.join(names, F.lit(True)).withColumn("a", F.map_from_entries(named))

    get = lambda k: F.try_element_at("a", F.lit(k))
    bare = lambda c: F.lower(strip(strip_chars(c, '"')))
    nodes = attributes(_elements(spark, path, "node", f"_id string, {data}"), "node")
    nodes = nodes.select(bare(F.col("_id")).alias("name"), F.coalesce(get("entity_type"), F.lit(V.NO_TYPE)).alias("type_raw"), F.left(F.coalesce(get("description"), F.lit("")), F.lit(500)).alias("description"), get("source_id").alias("source_id"))
    edges = attributes(_elements(spark, path, "edge", f"_source string, _target string, {data}"), "edge")
    edges = edges.select(bare(F.col("_source")).alias("head"), bare(F.col("_target")).alias("tail"), F.left(F.coalesce(get("description"), F.lit("")), F.lit(300)).alias("description"), F.coalesce(get("weight").try_cast("double"), F.lit(1.0)).alias("weight"))
    return nodes, edges


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``text`` of each text file, stripped, empty ones dropped."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), strip(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def _first(columns: list[str], *names: str) -> Column:
    found = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in columns]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def sampling_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges from all-string tables with export or plain headers: blank ids are skipped, missing
    endpoints are created, of repeated edges the last (by ``ord``, if there is one) wins."""
    n, e = nodes.columns, edges.columns
    found = nodes.select(_first(n, ":ID", "id").alias("node"), _first(n, "name").alias("name"), _first(n, ":LABEL", "type").alias("type"), _first(n, "description").alias("description")).where("node <> ''").dropDuplicates(["node"])
    order = F.col("ord") if "ord" in e else F.lit(0)
    rows = edges.select(_first(e, ":START_ID", "source").alias("src"), _first(e, ":END_ID", "target").alias("tgt"), _first(e, ":TYPE", "relation").alias("relation"), _first(e, "relation_name").alias("relation_name"), order.alias("ord")).where("src <> '' and tgt <> ''")
    last = rows.groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.max_by(F.struct("relation", "relation_name"), F.struct("ord", "relation", "relation_name")).alias("r"))
    last = last.select("src", "tgt", "r.*")
    return with_missing_nodes(found, last), last


def sampling_graph_csv(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    read = lambda p: spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(p)
    return sampling_graph(read(nodes_path), read(edges_path))


def reward_graph_csv(spark: SparkSession, nodes_path: str, edges_path: str) -> tuple[DataFrame, DataFrame]:
    """Typed nodes, and the edges both of whose ends are nodes; missing weights and confidences are 1."""
    read = lambda p: spark.read.option("header", True).option("escape", '"').csv(p)
    nodes = read(nodes_path).select(F.col("`:ID`").alias("node"), "name", "type", "description")
    edges = read(edges_path).select(F.col("`:START_ID`").alias("src"), F.col("`:END_ID`").alias("tgt"), F.col("`:TYPE`").alias("relation"), "relation_name", F.coalesce(F.col("`weight:float`").try_cast("double"), F.lit(1.0)).alias("weight"), F.coalesce(F.col("`confidence:float`").try_cast("double"), F.lit(1.0)).alias("confidence"))
    return nodes, valid_edges(edges, nodes)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON arrays, with an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def training_samples(spark: SparkSession, path: str) -> DataFrame:
    """Instruction, input and the expected output under either of its names."""
    return json_records(spark, path, TRAINING).select("instruction", F.coalesce("input", F.lit("")).alias("input"), F.coalesce("standard_output", "output", F.lit("")).alias("output"))


def metrics_log(spark: SparkSession, path: str, schema: str = METRICS) -> DataFrame:
    """A JSON Lines log; blank lines are skipped."""
    return spark.read.schema(schema).json(path).where("step is not null")
