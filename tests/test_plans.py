import pytest
from pyspark.sql import functions as F

from tessera.operators import community
from tessera.plans import cleaning, sampling
from tessera.plans.fusion import Fusion, answered
from tessera.plans.graphrag import GraphRAG, QueryParam
from tessera.sources.stores import TableStore
from tessera.streaming import incremental


def extract(content):
    pair = lambda a, b: F.concat(F.lit('("entity"<|>'), a, F.lit("<|>word<|>the word "), a, F.lit(')##("entity"<|>'), b, F.lit("<|>word<|>the word "), b, F.lit(')##("relationship"<|>'), a, F.lit("<|>"), b, F.lit("<|>follows<|>2)##"))
    w = F.split(content, " ")
    return F.concat(pair(w[0], w[1]), pair(w[1], w[2]), F.lit("<|COMPLETE|>"))


def embed(x):
    low = F.lower(x)
    return F.array(*(F.when(low.contains(c), 1.0).otherwise(0.1).cast("float") for c in "abcd"))


def report(_):
    return F.lit('```{"title": "T", "summary": "S", "rating": 5, "findings": [{"summary": "f", "explanation": "e"}]}```')


def answer(context):
    return F.when(context.startswith("#"), '{"points": [{"description": "p1", "score": 3}, {"description": "p0", "score": 0}]}').otherwise(F.concat(F.lit("said: "), F.left(context, F.lit(2))))


def test_graphrag(spark, tmp_path):
    rag = GraphRAG(spark, str(tmp_path / "rag"), extract, embed, report, answer)
    texts = spark.createDataFrame([("alpha beta cat",), ("alpha beta cat",), ("beta cat dog",)], "text string")
    assert rag.insert(texts)
    assert not rag.insert(texts)
    nodes, edges = rag.graph()
    assert sorted(r["entity_name"] for r in nodes.collect()) == ["ALPHA", "BETA", "CAT", "DOG"]
    assert {(r["src"], r["tgt"]): r["weight"] for r in edges.collect()} == {("ALPHA", "BETA"): 2.0, ("BETA", "CAT"): 4.0, ("CAT", "DOG"): 2.0}
    assert rag.reports.all().where("report like '# T%'").count() > 0
    sections = rag.query([1.0, 0.1, 0.1, 0.1], QueryParam("local", only_need_context=True))
    assert sections["entities"].count() > 0 and sections["relationships"].count() > 0 and sections["sources"].count() > 0 and sections["reports"].count() > 0
    assert "alpha" in rag.query([1.0, 0.1, 0.1, 0.1], QueryParam("naive", only_need_context=True)).first()["context"]
    assert [r["description"] for r in rag.query(None, QueryParam(only_need_context=True)).collect()] == ["p1"]
    assert rag.query(None).first()["answer"] == "said: p1"
    assert rag.insert(spark.createDataFrame([("cat dog eel",)], "text string"))
    assert {(r["src"], r["tgt"]): r["weight"] for r in rag.graph()[1].collect()}["CAT", "DOG"] == 4.0


def test_fusion(spark, tmp_path):
    structured = spark.createDataFrame([("肺癌", "疾病", "治疗", "drug-a", None, "medical_kg"), ("肺癌", "疾病", "并发症", "肺炎", "疾病", "medical_kg")], "head string, head_type string, relation string, tail string, tail_type string, source string")
    nodes = spark.createDataFrame([("肺癌", '"疾病"', "a long description", "c1"), ("drug a", '"西药"', "x", "c1"), ("咳嗽", "怪", "cough described well", "c2")], "name string, type_raw string, description string, source_id string")
    edges = spark.createDataFrame([("肺癌", "drug a", "treats", 1.0), ("肺癌", "咳嗽", "shows", 2.0)], "head string, tail string, description string, weight double")
    learned = {"relations": spark.createDataFrame([("treats", "治疗")], "description string, relation string"), "types": spark.createDataFrame([("怪", "症状")], "type_raw string, type string"), "inferred": spark.createDataFrame([("咳嗽", "症状", "检查", "ct", "检查", 0.95), ("肺癌", "疾病", "治疗", "drug-a", "药物", 0.9)], "head string, head_type string, relation string, tail string, tail_type string, confidence double")}
    f = Fusion(spark, str(tmp_path), lambda: structured, lambda: (nodes, edges), learned)
    f.run()
    merged = {(r["head"], r["relation"], r["tail"]): r["source"] for r in f._get("merged").collect()}
    assert merged == {("肺癌", "治疗", "drug-a"): "guideline,medical_kg", ("肺癌", "并发症", "肺炎"): "medical_kg", ("肺癌", "相关", "咳嗽"): "guideline"}
    done = f._get("completed")
    assert {r["confidence"] for r in done.where("source = 'inferred'").collect()} == {0.9} and done.count() == 4
    assert {r["name"]: r["type"] for r in f._get("nodes").collect()} == {"肺癌": "疾病", "drug-a": "西药", "肺炎": "疾病", "咳嗽": "症状", "ct": "检查"}
    assert f._get("edges").count() == 4 and f._get("report_degrees").first()["nodes"] == 5


def test_prompts_are_answered_once(spark):
    prompts = spark.createDataFrame([("p",), ("p",), ("q",)], "prompt string")
    cached = prompts.where("prompt = 'q'").select(F.md5("prompt").alias("key"), F.lit("old").alias("reply"))
    got, known = answered(prompts, cached, lambda p: F.concat(F.lit("new "), p))
    assert sorted(r["reply"] for r in got.collect()) == ["new p", "new p", "old"] and known.count() == 2


def test_questions_from_communities(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], "src string, tgt string")
    found, members = sampling.partition(edges, max_communities=2)
    assert found.count() >= 1
    nodes = spark.createDataFrame([(x, x.upper(), "T") for x in "abcd"], "node string, name string, type string")
    lines = sampling.context(members, nodes, edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"), F.lit("r").alias("relation"), F.lit("").alias("relation_name"))).first()["context"]
    assert lines.startswith("- [T] A\n") and "A --[r]--> B" in lines
    asked = sampling.questions(found.select("community_id", F.lit("x").alias("context")), lambda p: F.lit("<qa><question>q</question><answer>a</answer></qa>"))
    assert asked.count() == 1


def test_stream_inserts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"text": "one"}\n{"text": "two"}\n')
    store = TableStore(spark, str(tmp_path / "kv"), "key string, text string", "key")
    insert = lambda rows: store.upsert(incremental.new_documents(rows, store.all()).select("key", "text"))
    for name in ("2.json", "3.json"):
        incremental.insert_stream(incremental.stream_texts(spark, str(tmp_path / "in")), insert, str(tmp_path / "cp")).awaitTermination()
        (tmp_path / "in" / name).write_text('{"text": "two"}\n{"text": "%s"}\n' % name)
    incremental.insert_stream(incremental.stream_texts(spark, str(tmp_path / "in")), insert, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["text"] for r in store.all().collect()) == ["2.json", "3.json", "one", "two"]


def test_failed_rows_are_retried(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "r"), "id string, score double", "id")
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    incremental.process_new(rows, store, lambda r: r.withColumn("score", F.when(F.col("id") == "a", 1.0)))
    got = incremental.process_new(rows, store, lambda r: r.withColumn("score", F.lit(2.0)), retry=F.col("score").isNull())
    assert dict(got.collect()) == {"a": 1.0, "b": 2.0}


def test_a_failed_insert_can_be_tried_again(spark, tmp_path):
    failing = {"chunks": 1, "docs": 1}

    class Flaky(TableStore):
        def append(self, rows):
            name = self.path.rpartition("/")[2]
            if failing.get(name):
                failing[name] -= 1
                raise OSError(f"no {name} today")
            super().append(rows)

    rag = GraphRAG(spark, str(tmp_path / "rag"), extract, embed, report, answer, store=Flaky)
    texts = spark.createDataFrame([("alpha beta cat",), ("beta cat dog",)], "text string")
    for name in ("chunks", "docs"):
        with pytest.raises(OSError, match=name):
            rag.insert(texts)
    assert rag.insert(texts) and not rag.insert(texts)
    assert {(r["src"], r["tgt"]): r["weight"] for r in rag.graph()[1].collect()} == {("ALPHA", "BETA"): 2.0, ("BETA", "CAT"): 4.0, ("CAT", "DOG"): 2.0}
    assert rag.docs.all().count() == rag.chunks.all().count() == 2 and rag.vectors.all().groupBy("id").count().where("count > 1").count() == 0


def test_only_new_texts_are_embedded(spark, tmp_path):
    asked = []

    class Counting(TableStore):
        def put(self, rows, group):
            if self.path.endswith("vectors"):
                asked.append(sorted(r["name"] for r in rows.where("kind = 'entity'").collect()))
            super().put(rows, group)

    rag = GraphRAG(spark, str(tmp_path / "rag"), extract, embed, store=Counting)
    rag.insert(spark.createDataFrame([("alpha beta cat",)], "text string"))
    rag.insert(spark.createDataFrame([("cat dog eel",)], "text string"))
    assert asked == [["ALPHA", "BETA", "CAT"], ["DOG", "EEL"]]


def test_gleaning_asks_until_told_to_stop(spark, tmp_path):
    def pair(a, b):
        return F.lit(f'("entity"<|>{a}<|>word<|>d)##("entity"<|>{b}<|>word<|>d)##("relationship"<|>{a}<|>{b}<|>r<|>1)##')

    def more(content, reply):
        return F.when(content.startswith("go"), F.lit(' "Yes" ')).otherwise(F.lit("no"))

    def glean(content, reply):
        return F.when(reply.contains("third"), pair("fourth", "fifth")).otherwise(pair("second", "third"))

    rag = GraphRAG(spark, str(tmp_path / "rag"), lambda c: pair("first", "second"), glean=glean, more=more, gleanings=2)
    rag.insert(spark.createDataFrame([("go on",), ("stop here",)], "text string"))
    by = {}
    for r in rag.mentions.all().join(rag.chunks.all(), F.col("source_id") == F.col("chunk_id")).collect():
        by.setdefault(r["content"], set()).add(r["entity_name"])
    assert by == {"go on": {"FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH"}, "stop here": {"FIRST", "SECOND", "THIRD"}}


def test_reports_begin_with_the_deepest_level(spark, tmp_path):
    def extract_all(content):
        words = F.split(content, " ")
        one = F.transform(words, lambda w: F.concat(F.lit('("entity"<|>'), w, F.lit("<|>word<|>some words that tell of it at length)##")))
        two = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(F.lit('("relationship"<|>'), w, F.lit("<|>"), F.element_at(words, i + 2), F.lit("<|>next<|>1)##")))
        return F.array_join(F.concat(one, two), "")

    def told(context):
        return F.concat(F.lit('{"title": "'), F.when(context.startswith("-----Reports-----"), "by parts").otherwise("plain"), F.lit('", "summary": "S", "rating": 5, "findings": []}'))

    rag = GraphRAG(spark, str(tmp_path / "rag"), extract_all, report=told, report_tokens=120)
    rag.insert(spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)], "text string"))
    reports = rag.reports.all().collect()
    assert {r["level"] for r in reports} >= {0, 1}
    inside = {(r["parent"], r["child"]) for r in community.sub_communities(rag.clusters.all()).collect()}
    parents = {p for p, _ in inside}
    assert parents
    for r in reports:
        wide = r["cluster"] in parents and len(r["nodes"]) > 10
        assert r["report"].startswith("# by parts") == wide, (r["cluster"], r["report"][:20], len(r["nodes"]))


def test_documents_are_cleaned_and_verified(spark):
    long = "x" * 60
    docs = spark.createDataFrame([(1, f"keep this. NOISE\n{long}\nbad part"), (2, None), (3, "fine")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in cleaning.clean_documents(docs, lambda c: F.when(~c.contains("bad"), F.concat(F.replace(c, F.lit(" NOISE"), F.lit("")), F.lit("\n\n" + long))), lambda a, b: F.concat(F.lit("so: {\"kept\": "), F.length(b).cast("string"), F.lit("} ok")), size=70, overlap=5).collect()}
    assert got[3]["text"] == f"fine\n\n{long}" and got[3]["failed"] == [] and got[3]["verification"] == '{"kept": %d}' % len(got[3]["text"])
    assert got[1]["text"].count(long) == 1 or "bad" in got[1]["text"]
    assert len(got[1]["failed"]) >= 1 and "bad part" in got[1]["text"]
    assert (got[2]["text"], got[2]["chunks"], got[2]["failed"]) == ("", 0, [])
