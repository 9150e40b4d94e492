"""Queries through files and stores: what a sink or a store has written, as its reader gives it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import hashing, text
from tessera.functions import vocabulary as V
from tessera.operators import dedup
from tessera.plans import bridge, fusion
from tessera.plans.graphrag import GraphRAG
from tessera.plans.registry import _COS, _with, query
from tessera.session import shared_folder, stage_table, table
from tessera.sources import readers, sinks
from tessera.sources.stores import GraphStore, TableStore, VectorStore


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


@query(f"SELECT lower(c_name) AS head, '{V.DEFAULT_TYPE}' AS head_type, 'located_in' AS relation, lower(n_name) AS tail, '{V.DEFAULT_TYPE}' AS tail_type, 'medical_kg' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey")
def source_csv_triples(spark, sf):
    """SRC1, SNK1: customers as structured triples, written as CSV and read as the structured source."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    path = _folder(spark, "triples")
    sinks.write_csv(rows.select(F.concat(F.lit("  "), "c_name").alias("entity1_norm"), F.col("c_mktsegment").alias("entity1_type"), F.lit("located_in").alias("relation_canonical"), F.col("n_name").alias("entity2_norm"), F.lit("nation").alias("entity2_type")), path)
    return readers.structured_triples(spark, path)


def _graphml(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("entity_type"), F.concat("p_name", F.lit(' <"&'), "p_type").alias("description"), "p_size")
    path = _folder(spark, "graphml")
    sinks.write_graphml(p.select("node", "entity_type", "description"), p.select(F.col("node").alias("src"), F.col("entity_type").alias("tgt"), F.col("p_size").cast("double").alias("weight"), F.lit("made by").alias("description")), path)
    return readers.graphml(spark, path)


@query("SELECT 'p:' || p_partkey AS name, p_brand AS type_raw, left(p_name || ' <\"&' || p_type, 500) AS description FROM part")
def source_graphml_nodes(spark, sf):
    """SRC2, SNK4."""
    return _graphml(spark, sf)[0].select("name", "type_raw", "description")


@query("SELECT 'p:' || p_partkey AS head, lower(p_brand) AS tail, 'made by' AS description, CAST(p_size AS DOUBLE) AS weight FROM part")
def source_graphml_edges(spark, sf):
    """SRC2, SNK4."""
    return _graphml(spark, sf)[1]


@query("SELECT trim(text) AS text FROM benchmark WHERE trim(text) <> ''")
def source_text_files(spark, sf):
    """SRC3: a file for each benchmark item."""
    path = _folder(spark, "texts")
    table(spark, sf, "benchmark").select("item_id", F.concat(F.lit(" "), "text", F.lit("\n")).alias("text")).write.partitionBy("item_id").text(path)
    return readers.text_files(spark, path).select("text")


_EXPORTED = "exported AS (SELECT 'e_' || left(md5(head), 12) AS a, 'e_' || left(md5(tail), 12) AS b, relation, head, tail FROM triples)"


def _exported(spark, sf, nodes_of: str):
    t = bridge.triples(spark, sf).withColumn("ord", F.lit(0).cast("long"))
    nothing = spark.createDataFrame([], "name string, type string, description string, source string")
    nodes, edges = _folder(spark, "nodes"), _folder(spark, "edges")
    sinks.write_csv(sinks.export_nodes(t.where(nodes_of), nothing), nodes)
    sinks.write_csv(sinks.export_edges(t), edges)
    return nodes, edges


@query(_with(bridge.TRIPLES, _EXPORTED) + "SELECT least(a, b) AS src, greatest(a, b) AS tgt, max(relation) AS relation, max(relation) AS relation_name FROM exported GROUP BY least(a, b), greatest(a, b)")
def source_sampling_csv(spark, sf):
    """SRC4, SNK2: the exported graph as the sampling steps read it."""
    return readers.sampling_graph_csv(spark, *_exported(spark, sf, "true"))[1].select("src", "tgt", "relation", "relation_name")


@query(_with(bridge.TRIPLES, _EXPORTED, "ends AS (SELECT a AS node FROM exported WHERE relation <> 'has_brand' UNION SELECT b FROM exported WHERE relation <> 'has_brand')") + "SELECT a AS src, b AS tgt, relation, CAST(1 AS DOUBLE) AS weight, CAST(1 AS DOUBLE) AS confidence FROM exported WHERE a IN (SELECT node FROM ends) AND b IN (SELECT node FROM ends)")
def source_reward_csv(spark, sf):
    """SRC5, SNK2: the exported graph as the rewards read it; edges to brands go, as brands aren't among the nodes."""
    return readers.reward_graph_csv(spark, *_exported(spark, sf, "relation <> 'has_brand'"))[1].select("src", "tgt", "relation", "weight", "confidence")


@query("SELECT 'about ' || n_name AS instruction, CASE WHEN n_regionkey = 1 THEN '' ELSE 'region ' || n_regionkey END AS input, lower(n_name) AS output FROM nation")
def source_json_samples(spark, sf):
    """SRC6: training samples in a JSON array."""
    n = table(spark, sf, "nation")
    sample = F.struct(F.concat(F.lit("about "), "n_name").alias("instruction"), F.when(F.col("n_regionkey") != 1, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("input"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).alias("output"), F.when(F.col("n_nationkey") % 2 == 1, F.lower("n_name")).alias("standard_output"))
    path = _folder(spark, "samples")
    n.agg(F.to_json(F.collect_list(sample)).alias("value")).coalesce(1).write.text(path)  # the nations of one small table
    return readers.training_samples(spark, path)


@query("SELECT event_id AS step, round(value, 6) AS loss FROM events")
def source_metrics_log(spark, sf):
    """SRC7, SNK6: metrics appended in two runs."""
    e, path = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.col("value").alias("loss"), "event_type"), _folder(spark, "metrics")
    for part in (e.where("event_type = 'purchase'"), e.where("event_type <> 'purchase'")):
        sinks.append_metrics(part.drop("event_type"), path)
    return readers.metrics_log(spark, path).select("step", "loss")


@query("SELECT event_id, event_type, value FROM events")
def sink_json_results(spark, sf):
    """SNK3: results as JSON, read again."""
    path = _folder(spark, "results")
    sinks.write_json(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("""WITH stored AS (SELECT c_custkey AS k, c_name AS name FROM customer), fresh AS (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name FROM customer),
kept AS (SELECT coalesce(f.k, s.k) AS k, coalesce(f.name, s.name) AS name FROM stored s FULL JOIN fresh f ON s.k = f.k) SELECT o.k, kept.name FROM (SELECT DISTINCT o_custkey + 50 AS k FROM orders) o LEFT JOIN kept ON kept.k = o.k""")
def store_key_values(spark, sf):
    """SRC8, GR2, GR4: rows put into a store, put again in part, and looked up; null for the missing."""
    c = table(spark, sf, "customer")
    store = TableStore(spark, _folder(spark, "kv"), "k long, name string", "k")
    store.upsert(c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    store.upsert(c.select((F.col("c_custkey") + 100).alias("k"), F.when(F.col("c_custkey") % 2 == 0, "new").alias("name")))
    ids = table(spark, sf, "orders").select((F.col("o_custkey") + 50).alias("k")).distinct().withColumn("pos", F.col("k"))
    return store.get(ids).select("k", "name")


@query(f"SELECT v.vec_id AS id, round({_COS}, 6) AS score, v.label FROM embeddings q, embeddings v WHERE q.vec_id = 7 AND {_COS} >= 0.2 ORDER BY {_COS} DESC, v.vec_id LIMIT 20")
def store_vectors(spark, sf):
    """SRC9: exact search in a vector store, with metadata."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    store = VectorStore(spark, _folder(spark, "vectors"), "label int")
    store.schema = f"id long, vector array<float>, label {dict(e.dtypes)['label']}"
    store.upsert(e)
    q = e.where("id = 7").first()
    return store.query(list(q["vector"]) if q else [1.0] * 64).select("id", F.round("score", 6).alias("score"), "label")


@query("""WITH pairs AS (SELECT DISTINCT 'c:' || o_custkey AS src, 'n:' || (o_orderkey % 25) AS tgt FROM orders) SELECT src, tgt FROM pairs WHERE EXISTS (SELECT 1 FROM customer WHERE 'c:' || c_custkey = src AND 'n:' || c_nationkey = tgt)""")
def store_graph_edges(spark, sf):
    """SRC11, SRC12, GR1: edges asked for, in either direction, that a graph store has."""
    key = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    c = table(spark, sf, "customer")
    g = GraphStore(spark, _folder(spark, "graph"), "type string", "weight double")
    g.upsert_nodes(c.select(key("c", "c_custkey").alias("node"), F.col("c_mktsegment").alias("type")))
    g.upsert_edges(c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("tgt"), F.lit(1.0).alias("weight")))
    pairs = table(spark, sf, "orders").select(key("c", "o_custkey").alias("src"), F.concat(F.lit("n:"), (F.col("o_orderkey") % 25).cast("string")).alias("tgt")).distinct()
    return g.has_edges(pairs)


@query("""WITH edge AS (SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS tgt FROM customer), ids AS (SELECT 'c:' || c_custkey AS node FROM customer UNION SELECT 'n:' || (n_nationkey + 3) FROM nation) SELECT node, (SELECT count(*) FROM edge WHERE src = node OR tgt = node) AS degree FROM ids""")
def store_graph_degrees(spark, sf):
    """SRC11, AG7: degrees from a graph store, 0 for the missing."""
    key = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))
    c = table(spark, sf, "customer")
    g = GraphStore(spark, _folder(spark, "graph"), "type string", "weight double")
    g.upsert_edges(c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("tgt"), F.lit(1.0).alias("weight")))
    ids = c.select(key("c", "c_custkey").alias("node")).union(table(spark, sf, "nation").select(F.concat(F.lit("n:"), (F.col("n_nationkey") + 3).cast("string")))).distinct()
    return g.degrees(ids).select("node", F.col("degree").cast("long").alias("degree"))


# ---------------------------------------------------------------- an index from documents

_WORDS = r"words AS (SELECT DISTINCT content, w FROM (SELECT trim(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), ' ')) AS content FROM benchmark) CROSS JOIN LATERAL (SELECT list_filter(regexp_split_to_array(upper(regexp_replace(content, '[^A-Za-z ]', '', 'g')), ' '), lambda x: x <> '') AS w)), named AS (SELECT content, w[1] AS a, w[2] AS b, w[3] AS c FROM words WHERE len(w) >= 3 AND w[1] <> w[2] AND w[2] <> w[3])"


def _extract(content):
    """Three words as entities and two relations between them, as a model would answer."""
    w = F.filter(F.split(F.upper(F.regexp_replace(content, "[^A-Za-z ]", "")), " "), lambda x: x != "")
    a, b, c = (F.try_element_at(w, F.lit(i)) for i in (1, 2, 3))
    entity = lambda x: F.concat(F.lit('("entity"<|>'), x, F.lit("<|>word<|>the word)##"))
    relation = lambda x, y: F.concat(F.lit('("relationship"<|>'), x, F.lit("<|>"), y, F.lit("<|>follows<|>2)##"))
    said = F.concat(entity(a), entity(b), entity(c), relation(a, b), relation(b, c), F.lit("<|COMPLETE|>"))
    return F.when((F.size(w) >= 3) & (a != b) & (b != c), said).otherwise("<|COMPLETE|>")


@query(f"WITH {_WORDS} SELECT least(x, y) AS src, greatest(x, y) AS tgt, 2.0 * count(*) AS weight, count(DISTINCT content) AS chunks FROM (SELECT content, a AS x, b AS y FROM named UNION ALL SELECT content, b, c FROM named) GROUP BY least(x, y), greatest(x, y)")
def rag_insert(spark, sf):
    """Q1: documents inserted in two runs that overlap; the graph's edges."""
    rag = GraphRAG(spark, _folder(spark, "rag"), _extract)
    b = table(spark, sf, "benchmark").select("item_id", "text")
    rag.insert(b.where("item_id % 3 > 0").select("text"))
    rag.insert(b.select("text"))
    return rag.graph()[1].select("src", "tgt", "weight", F.size("source_ids").cast("long").alias("chunks"))


@query(f"""WITH parts AS (SELECT lower(c_name) AS head, 'located_in' AS relation, lower(n_name) AS tail, 'medical_kg' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT lower(c_name), CASE WHEN c_nationkey % 2 = 0 THEN 'located_in' ELSE '相关' END, lower(n_name), 'guideline' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0
  UNION ALL SELECT lower(s_name), CASE WHEN s_nationkey % 2 = 0 THEN 'located_in' ELSE '相关' END, lower(n_name), 'guideline' FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'e_' || left(md5(head), 12) AS start_id, 'e_' || left(md5(tail), 12) AS end_id, relation, string_agg(DISTINCT source, ',' ORDER BY source) AS source FROM parts GROUP BY head, relation, tail""")
def fusion_run(spark, sf):
    """Q9: all six steps over two sources that share names; the exported edges."""
    n = table(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("place"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("c_name").alias("head"), "place", "c_custkey", F.col("c_nationkey").alias("k"))
    s_ = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("s_name").alias("head"), "place", F.col("s_nationkey").alias("k"))
    kind = F.lit(V.DEFAULT_TYPE)
    told = F.when(F.col("k") % 2 == 0, "is in").otherwise("belongs to")
    structured = c.select("head", kind.alias("head_type"), F.lit("located_in").alias("relation"), F.col("place").alias("tail"), kind.alias("tail_type"), F.lit("medical_kg").alias("source"))
    edges = c.where("c_custkey % 3 = 0").select("head", F.col("place").alias("tail"), told.alias("description"), F.lit(1.0).alias("weight")).unionByName(s_.select("head", F.col("place").alias("tail"), told.alias("description"), F.lit(1.0).alias("weight")))
    nodes = edges.select(F.col("head").alias("name")).union(edges.select("tail")).distinct().select("name", F.lit(V.NO_TYPE).alias("type_raw"), F.lit("").alias("description"), F.lit("c").alias("source_id"))
    learned = {"relations": spark.createDataFrame([("is in", "located_in")], "description string, relation string")}
    run = fusion.Fusion(spark, _folder(spark, "fusion"), lambda: structured, lambda: (nodes, edges), learned)
    run.run()
    return run._get("edges").select(F.col(":START_ID").alias("start_id"), F.col(":END_ID").alias("end_id"), F.col("relation_name").alias("relation"), "source")


# ---------------------------------------------------------------- functions without a query elsewhere

@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '疾病' WHEN 1 THEN '症状' WHEN 2 THEN '学到' ELSE '其他治疗' END AS type FROM part""")
def guideline_types(spark, sf):
    """SCL5: a unified type in quotes, one in the table, a learned one, and the default."""
    raw = F.when(F.col("p_partkey") % 5 == 0, '"疾病"').when(F.col("p_partkey") % 5 == 1, "症状").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", text.guideline_type(raw, F.when(F.col("p_partkey") % 5 == 2, "学到")).alias("type"))


@query("""SELECT doc_id, md5('{"a0":' || doc_id || ',"a1":"' || lang || '"}') AS key FROM documents WHERE lang IS NOT NULL""")
def argument_keys(spark, sf):
    """SCL8."""
    return table(spark, sf, "documents").where("lang is not null").select("doc_id", hashing.args_key(F.col("doc_id"), F.col("lang")).alias("key"))


@query(r"SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 200 THEN 'in short: ' || left(text, 30) ELSE text END AS description FROM documents")
def summarise_long(spark, sf):
    """AG6."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    return dedup.summarise_long(d, lambda x: F.concat(F.lit("in short: "), F.left(x, F.lit(30))), F.size(text.tokens(F.col("description"))), 200)
