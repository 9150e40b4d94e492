"""Graph-shaped views of the star tables, in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed triples of two sources that overlap in (order, contains, part)."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(f"{p}:"), F.col(c).cast("string"))

    def rows(df, head, head_type, relation, tail, tail_type, source):
        return df.select(head.alias("head"), F.lit(head_type).alias("head_type"), F.lit(relation).alias("relation"), tail.alias("tail"), F.lit(tail_type).alias("tail_type"), F.lit(source).alias("source"))

    lineitem = t("lineitem")
    parts = [
        rows(t("customer"), key("c", "c_custkey"), "customer", "located_in", key("n", "c_nationkey"), "nation", "orders"),
        rows(t("nation"), key("n", "n_nationkey"), "nation", "part_of", key("r", "n_regionkey"), "region", "orders"),
        rows(t("orders"), key("o", "o_orderkey"), "order", "placed_by", key("c", "o_custkey"), "customer", "orders"),
        rows(t("supplier"), key("s", "s_suppkey"), "supplier", "located_in", key("n", "s_nationkey"), "nation", "lineitem"),
        rows(t("part"), key("p", "p_partkey"), "part", "has_brand", F.concat(F.lit("b:"), "p_brand"), "brand", "orders"),
        rows(lineitem.select("l_partkey", "l_suppkey").distinct(), key("p", "l_partkey"), "part", "supplied_by", key("s", "l_suppkey"), "supplier", "lineitem"),
        rows(lineitem.where("l_linenumber <= 2"), key("o", "l_orderkey"), "order", "contains", key("p", "l_partkey"), "part", "lineitem"),
        rows(lineitem.where("l_linenumber = 1"), key("o", "l_orderkey"), "order", "contains", key("p", "l_partkey"), "part", "orders"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES = """
triples AS (
  SELECT 'c:' || c_custkey AS head, 'customer' AS head_type, 'located_in' AS relation, 'n:' || c_nationkey AS tail, 'nation' AS tail_type, 'orders' AS source FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', 'part_of', 'r:' || n_regionkey, 'region', 'orders' FROM nation
  UNION ALL SELECT 'o:' || o_orderkey, 'order', 'placed_by', 'c:' || o_custkey, 'customer', 'orders' FROM orders
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', 'located_in', 'n:' || s_nationkey, 'nation', 'lineitem' FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part', 'has_brand', 'b:' || p_brand, 'brand', 'orders' FROM part
  UNION ALL SELECT 'p:' || l_partkey, 'part', 'supplied_by', 's:' || l_suppkey, 'supplier', 'lineitem' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
  UNION ALL SELECT 'o:' || l_orderkey, 'order', 'contains', 'p:' || l_partkey, 'part', 'lineitem' FROM lineitem WHERE l_linenumber <= 2
  UNION ALL SELECT 'o:' || l_orderkey, 'order', 'contains', 'p:' || l_partkey, 'part', 'orders' FROM lineitem WHERE l_linenumber = 1
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple long-tailed graph: orders by customer, customers by nation, parts by supplier."""
    t = lambda n: table(spark, sf_dir, n)
    pair = lambda df, a, p, b, q: df.select(F.concat(F.lit(f"{p}:"), F.col(a).cast("string")).alias("src"), F.concat(F.lit(f"{q}:"), F.col(b).cast("string")).alias("tgt"))
    return pair(t("orders"), "o_custkey", "c", "o_orderkey", "o").unionByName(pair(t("customer"), "c_custkey", "c", "c_nationkey", "n")).unionByName(pair(t("lineitem").select("l_partkey", "l_suppkey").distinct(), "l_partkey", "p", "l_suppkey", "s"))


EDGES = """
edges AS (
  SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS tgt FROM orders
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
)"""


def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and those up to four places before them within their label (in runs of 1000 ids) that point the
    same way: src < tgt, weight. Linear in the vectors, and no run outgrows a task."""
    from tessera.functions.vectors import dot

    w = Window.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tgt"), F.col("embedding").alias("y"), F.array(*(F.struct(F.lag("vec_id", k).over(w).alias("src"), F.lag("embedding", k).over(w).alias("x")) for k in range(1, 5))).alias("before"))
    pairs = e.select("tgt", "y", F.explode("before").alias("b")).where("b.src is not null")
    return pairs.select(F.col("b.src").alias("src"), "tgt", dot(F.col("b.x"), F.col("y")).alias("weight")).where("weight > 0")


SIMILARITY = """
placed AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) AS place FROM embeddings),
similarity AS (
  SELECT a.vec_id AS src, b.vec_id AS tgt, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS weight
  FROM placed a JOIN placed b ON a.label = b.label AND a.vec_id // 1000 = b.vec_id // 1000 AND b.place - a.place BETWEEN 1 AND 4
  WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0
)"""


def vote_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of users as entities typed by their events."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("entity_name"), F.upper("event_type").alias("entity_type"), F.concat(F.lit("did "), "event_type").alias("description"), F.concat(F.lit("chunk-"), (F.col("event_id") % 97).cast("string")).alias("source_id"), F.col("event_id").alias("ord"))


MENTIONS = """
mentions AS (
  SELECT 'USER_' || user_id AS entity_name, upper(event_type) AS entity_type, 'did ' || event_type AS description, 'chunk-' || (event_id % 97) AS source_id, event_id AS ord FROM events
)"""


def vote_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between users whose ids meet in an event's number."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("USER_"), (F.col("event_id") % 50).cast("string")).alias("tgt"), (F.col("event_id") % 7).cast("double").alias("weight"), (F.col("event_id") % 3 + 1).cast("int").alias("ord"), F.concat(F.lit("met at "), "event_type").alias("description"), F.concat(F.lit("chunk-"), (F.col("event_id") % 97).cast("string")).alias("source_id"))


RELATIONS = """
relations AS (
  SELECT 'USER_' || user_id AS src, 'USER_' || (event_id % 50) AS tgt, CAST(event_id % 7 AS DOUBLE) AS weight, event_id % 3 + 1 AS ord, 'met at ' || event_type AS description, 'chunk-' || (event_id % 97) AS source_id FROM events
)"""


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nested levels of clusters over vectors: label, then label and parity."""
    e = table(spark, sf_dir, "embeddings")
    top = e.select(F.col("vec_id").alias("node"), F.lit(0).alias("level"), F.col("label").cast("string").alias("cluster"))
    return top.unionByName(e.select(F.col("vec_id").alias("node"), F.lit(1).alias("level"), F.concat(F.col("label").cast("string"), F.lit("/"), (F.col("vec_id") % 2).cast("string")).alias("cluster")))


CLUSTERS = """
clusters AS (
  SELECT vec_id AS node, 0 AS level, CAST(label AS VARCHAR) AS cluster FROM embeddings
  UNION ALL SELECT vec_id, 1, label || '/' || (vec_id % 2) FROM embeddings
)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look for: words of benchmark items of seven letters and more."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[\s.,]+")).alias("name"))
    return words.where(F.length("name") >= 7).distinct()


VOCABULARY = r"""
vocabulary AS (
  SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '[\s.,]+')) AS name FROM benchmark) WHERE length(name) >= 7
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


TURNS = "turns AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant')"


def vocabulary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over the names: those whose lengths and first letters agree are related."""
    v = vocabulary(spark, sf_dir).withColumn("k", F.concat(F.left("name", F.lit(2)), F.length("name").cast("string")))
    return v.select(F.col("name").alias("src"), "k").join(v.select(F.col("name").alias("tgt"), "k"), "k").where(F.col("src") < F.col("tgt")).select("src", "tgt")


VOCABULARY_EDGES = VOCABULARY + """,
vedges AS (
  SELECT a.name AS src, b.name AS tgt FROM vocabulary a JOIN vocabulary b ON left(a.name, 2) = left(b.name, 2) AND length(a.name) = length(b.name) AND a.name < b.name
),
vsym AS (SELECT src AS node, tgt AS nbr FROM vedges UNION SELECT tgt, src FROM vedges)"""
