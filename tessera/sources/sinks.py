"""Sinks: stage tables, property-graph CSV, JSON results, GraphML, the cleaning audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.hashing import export_id
from tessera.functions.text import section_states


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def one_line(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\r\n]+", " ")


def export_nodes(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One node per name in a triple: the type where it first occurs (heads before tails of the same triple), else
    the entity table's; description and source from the entity table."""
    ord_ = F.coalesce("ord", F.lit(1 << 61))  # rows without an order come last
    ends = triples.select(F.explode(F.array(F.struct(F.col("head").alias("name"), F.col("head_type").alias("t"), (ord_ * 2).alias("o")), F.struct(F.col("tail").alias("name"), F.col("tail_type").alias("t"), (ord_ * 2 + 1).alias("o")))).alias("x")).select("x.*")
    first = ends.groupBy("name").agg(F.min_by(F.struct("t"), "o")["t"].alias("t"))
    rows = first.join(entities.dropDuplicates(["name"]).select("name", F.col("type").alias("et"), "description", "source"), "name", "left")
    kind = F.coalesce(F.nullif("t", F.lit("")), "et", F.lit(V.DEFAULT_TYPE))
    return rows.select(export_id(F.col("name")).alias(":ID"), "name", kind.alias("type"), kind.alias(":LABEL"), one_line(F.col("description")).alias("description"), F.coalesce("source", F.lit("")).alias("source"))


def export_edges(triples: DataFrame) -> DataFrame:
    """One edge per triple, repeated ones included; missing weights and confidences are 1."""
    kind = F.regexp_replace("relation", "[^a-zA-Z0-9一-鿿_]", "_")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) if c in triples.columns else F.lit(1.0)
    text = one_line(F.left("description", F.lit(500))) if "description" in triples.columns else F.lit("")
    return triples.select(export_id(F.col("head")).alias(":START_ID"), export_id(F.col("tail")).alias(":END_ID"), kind.alias(":TYPE"), F.col("relation").alias("relation_name"), text.alias("description"), number("weight").alias("weight:float"), F.col("source"), number("confidence").alias("confidence:float"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_metrics(metrics: DataFrame, path: str, digits: int = 6) -> None:
    """Rounded metrics, one JSON object per step."""
    doubles = [c for c, t in metrics.dtypes if t == "double"]
    metrics.withColumns({c: F.round(c, digits) for c in doubles}).write.mode("append").json(path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Lines of GraphML: header, nodes, edges, footer, in files whose order is the document's."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    data = lambda kind, cols: F.concat(F.lit(""), *(F.concat(F.lit(f'<data key="{kind}_{c}">'), esc(c), F.lit("</data>")) for c in cols))
    nf, ef = [c for c in nodes.columns if c != "node"], [c for c in edges.columns if c not in ("src", "tgt")]
    spark = nodes.sparkSession
    declared = "".join(f'<key id="{k}_{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, cs in (("node", nf), ("edge", ef)) for c in cs)
    head = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{declared}<graph edgedefault="undirected">')], "part int, value string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "part int, value string")
    body = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), esc("node"), F.lit('">'), data("node", nf), F.lit("</node>")).alias("value"))
    more = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), esc("src"), F.lit('" target="'), esc("tgt"), F.lit('">'), data("edge", ef), F.lit("</edge>")).alias("value"))
    head.unionByName(body).unionByName(more).unionByName(tail).repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def cleaning_audit(rows: DataFrame, key: str = "doc_id", before: str = "before", after: str = "after") -> DataFrame:
    """Lengths, reduction in percent, and the audited sections that were deleted or are still there."""
    states = section_states(F.col(before), F.coalesce(F.col(after), F.lit("")))
    return rows.select(key, F.length(before).alias("before_chars"), F.length(F.coalesce(F.col(after), F.lit(""))).alias("after_chars"), F.round(100 * (1 - F.length(F.coalesce(F.col(after), F.lit(""))) / F.nullif(F.length(before), F.lit(0))), 4).alias("reduction_pct"), F.transform(F.filter(states, lambda s: s["deleted"]), lambda s: s["section"]).alias("deleted"), F.transform(F.filter(states, lambda s: ~s["deleted"]), lambda s: s["section"]).alias("present"))
