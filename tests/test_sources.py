import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, sinks
from tessera.sources.stores import GraphStore, TableStore, VectorStore

GRAPHML = """<?xml version='1.0'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="node" attr.name="description" attr.type="string"/><key id="d2" for="edge" attr.name="weight" attr.type="double"/><key id="d3" for="edge" attr.name="description" attr.type="string"/>
<graph edgedefault="undirected">
<node id="&quot;LUNG&quot;"><data key="d0">"疾病"</data><data key="d1">breathes</data></node>
<node id="heart"></node>
<edge source="&quot;LUNG&quot;" target="heart"><data key="d2">2.5</data><data key="d3">near</data></edge>
<edge source="heart" target="heart"></edge>
</graph></graphml>"""


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert sorted((r["name"], r["type_raw"], r["description"]) for r in nodes.collect()) == [("heart", "UNKNOWN", ""), ("lung", '"疾病"', "breathes")]
    assert sorted((r["head"], r["tail"], r["weight"]) for r in edges.collect()) == [("heart", "heart", 1.0), ("lung", "heart", 2.5)]


def test_graphml_is_written_as_it_is_read(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b", "t1"), ("c&d", None)], "node string, entity_type string")
    edges = spark.createDataFrame([("a<b", "c&d", 2.0)], "src string, tgt string, weight double")
    sinks.write_graphml(nodes, edges, str(tmp_path / "out"))
    got, links = readers.graphml(spark, str(tmp_path / "out"))
    assert sorted(r["name"] for r in got.collect()) == ["a<b", "c&d"]
    assert [(r["head"], r["tail"], r["weight"]) for r in links.collect()] == [("a<b", "c&d", 2.0)]


@pytest.fixture
def graphml_in_files(spark, tmp_path):
    nodes = spark.range(40).selectExpr("'n' || id as node", "'t' || id as entity_type")
    edges = spark.range(40).selectExpr("'n' || id as src", "'m' || id as tgt", "double(id) as weight")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_graphml(nodes, edges, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("part-*"))) > 2
    return str(tmp_path / "out")


def test_edges_of_graphml_in_several_files(spark, graphml_in_files):
    edges = readers.graphml(spark, graphml_in_files)[1]
    assert sorted((r["weight"], r["head"], r["tail"]) for r in edges.collect()) == [(i, f"n{i}", f"m{i}") for i in range(40)]


def test_nodes_of_graphml_in_several_files(spark, graphml_in_files):
    nodes = readers.graphml(spark, graphml_in_files)[0]
    assert sorted((r["name"], r["type_raw"]) for r in nodes.collect()) == sorted((f"n{i}", f"t{i}") for i in range(40))


def test_structured_triples_and_missing_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text("entity1_norm,entity1_type,relation_canonical,entity2_norm,entity2_type\n Lung Cancer ,疾病,药物治疗,Drug,西药\nnull,疾病,症状,x,\nfoo,预后,新关系,bar,\n")
    got = readers.structured_triples(spark, str(tmp_path / "t.csv")).collect()
    assert sorted((r["head"], r["head_type"], r["relation"], r["tail_type"]) for r in got) == [("foo", "流行病学", "新关系", None), ("lung cancer", "疾病", "治疗", "西药")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" one\n")
    (tmp_path / "b.txt").write_text(" \n")
    (tmp_path / "c.md").write_text("no")
    assert [tuple(r) for r in readers.text_files(spark, str(tmp_path)).collect()] == [("a.txt", "one")]


def test_sampling_graph_creates_endpoints_and_keeps_the_last_edge(spark):
    nodes = spark.createDataFrame([("a", "A"), ("", "none")], "`:ID` string, name string")
    edges = spark.createDataFrame([("a", "b", "r1", 1), ("b", "a", "r2", 2), ("", "x", "r", 3)], "`:START_ID` string, `:END_ID` string, `:TYPE` string, ord int")
    n, e = readers.sampling_graph(nodes, edges)
    assert sorted(r["node"] for r in n.collect()) == ["a", "b"]
    assert [(r["src"], r["tgt"], r["relation"]) for r in e.collect()] == [("a", "b", "r2")]


def test_export_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("x", "T", "has \"it\"", "y", "U", "s", 'say "hi"\nthere', 1)], "head string, head_type string, relation string, tail string, tail_type string, source string, description string, ord long")
    entities = spark.createDataFrame([("x", "V", None, "s")], "name string, type string, description string, source string")
    sinks.write_csv(sinks.export_nodes(t, entities), str(tmp_path / "n"))
    sinks.write_csv(sinks.export_edges(t), str(tmp_path / "e"))
    nodes, edges = readers.reward_graph_csv(spark, str(tmp_path / "n"), str(tmp_path / "e"))
    assert {r["name"]: r["type"] for r in nodes.collect()} == {"x": "T", "y": "U"}
    e = edges.first()
    assert (e["relation"], e["relation_name"], e["weight"]) == ("has__it_", 'has "it"', 1.0)


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"instruction": "i", "output": "o"}, {"instruction": "j", "input": "x", "standard_output": "p"}]))
    assert sorted(map(tuple, readers.training_samples(spark, str(tmp_path / "s.json")).collect())) == [("i", "", "o"), ("j", "x", "p")]
    (tmp_path / "m.jsonl").write_text('{"step": 1, "reward": 0.25}\n\n{"step": 2}\n')
    assert readers.metrics_log(spark, str(tmp_path / "m.jsonl")).select("step", "reward").orderBy("step").collect() == [(1, 0.25), (2, None)]


def test_metrics_are_appended_rounded(spark, tmp_path):
    for step in (1, 2):
        sinks.append_metrics(spark.createDataFrame([(step, 1 / 3)], "step long, loss double"), str(tmp_path / "m"))
    assert sorted(map(tuple, readers.metrics_log(spark, str(tmp_path / "m")).select("step", "loss").collect())) == [(1, 0.333333), (2, 0.333333)]


def test_table_store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "kv"), "k string, v string, w string", "k")
    assert store.all().count() == 0
    store.upsert(spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "k string, v string, w string"))
    store.upsert(spark.createDataFrame([("a", "3", None)], "k string, v string, w string"))
    assert sorted(map(tuple, store.all().collect())) == [("a", "3", "x"), ("b", "2", "y")]
    ids = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "a")], "pos int, k string")
    assert [(r["k"], r["v"]) for r in store.get(ids, ["v"]).collect()] == [("b", "2"), ("zz", None), ("a", "3")]
    assert [r["k"] for r in store.missing(ids).collect()] == ["zz"]
    store.drop()
    assert store.all().count() == 0


def test_vector_and_graph_stores(spark, tmp_path):
    v = VectorStore(spark, str(tmp_path / "v"), "name string")
    v.upsert(spark.createDataFrame([("a", [1.0, 0.0], "A"), ("b", [0.6, 0.8], "B"), ("c", [-1.0, 0.0], "C")], "id string, vector array<float>, name string"))
    assert [(r["name"], round(r["score"], 3)) for r in v.query([2.0, 0.0]).collect()] == [("A", 1.0), ("B", 0.6)]
    g = GraphStore(spark, str(tmp_path / "g"))
    g.upsert_nodes(spark.createDataFrame([("a", "t", "d")], "node string, type string, description string"))
    g.upsert_edges(spark.createDataFrame([("b", "a", 1.0, "x")], "src string, tgt string, weight double, description string"))
    g.upsert_edges(spark.createDataFrame([("a", "b", 2.0, "y")], "src string, tgt string, weight double, description string"))
    assert [tuple(r) for r in g.edges.all().collect()] == [("a", "b", 2.0, "y")]
    ids = spark.createDataFrame([("a",), ("q",)], "node string")
    assert [r["node"] for r in g.has_nodes(ids).collect()] == ["a"]
    assert dict(g.degrees(ids).collect()) == {"a": 1, "q": 0}
    assert {r["node"]: r["nbrs"] for r in g.node_edges(ids).collect()} == {"a": ["b"], "q": []}
    assert g.has_edges(spark.createDataFrame([("b", "a"), ("a", "c")], "src string, tgt string")).count() == 1


def test_audit(spark):
    got = sinks.cleaning_audit(spark.createDataFrame([(1, "Body. References 1 致谢", "Body. 致谢")], "doc_id long, before string, after string")).first()
    assert got["deleted"] == ["References"] and got["present"] == ["Acknowledgment"]


def test_quality_report_identities(spark):
    # degrees, shares and means as they are rounded in reports
    s = spark.range(200).select(F.when(F.col("id") < 22, 1).when(F.col("id") < 71, 2).when(F.col("id") < 105, 3).when(F.col("id") < 151, 4).otherwise(5).alias("score"))
    from tessera.operators.evaluate import score_validation

    assert tuple(score_validation(s).first()) == (200, pytest.approx(3.26), 47.5, 64.5)


def test_a_store_survives_a_crash_while_it_publishes(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "kv"), "k string, v string", "k")
    row = lambda *x: spark.createDataFrame(list(x), "k string, v string")
    store.upsert(row(("a", "1")))
    publish = TableStore._publish
    monkeypatch.setattr(TableStore, "_publish", lambda self, segments: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        store.upsert(row(("b", "2")))
    monkeypatch.setattr(TableStore, "_publish", publish)
    assert [tuple(r) for r in store.all().collect()] == [("a", "1")]
    store.append(row(("c", "3")))
    store.put(row(("c", "4"), ("d", "5")), "k")
    assert sorted(map(tuple, store.all().collect())) == [("a", "1"), ("c", "4"), ("d", "5")]
    for i in range(20):
        store.append(row((f"x{i}", "")))
    assert store.all().count() == 23 and len(store._current()) <= 17
    assert len(store._names("manifests")) == 2 and len(store._names("segments")) <= 34
