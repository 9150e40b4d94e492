import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, parsing, text, vectors
from tessera.operators import budget, chunking


@pytest.fixture(scope="module")
def value(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return one


def test_names(value):
    assert value(text.normal_name(F.lit("　 Lung CANCER \t"))) == "lung cancer"
    assert value(text.fuzzy_key(F.lit("非小-细胞 肺癌（A·b）【】"))) == "非小细胞肺癌ab"
    assert value(text.graph_name(F.lit(' "A&amp;B"\x07 '))) == '"A&B"'


def test_references_without_a_semicolon(value):
    raw = F.lit(" a&amp b&amp;amp; &eacute;&#233;&#xe9; &copy2 &ampx; &nosuch; ")
    assert value(text.clean_str(raw)) == "a& b&amp; ééé ©2 &x; &nosuch;"
    assert value(text.clean_str(raw, ended=True)) == "a&amp b&amp; ééé &copy2 &ampx; &nosuch;"


def test_a_page_that_is_cut_within_a_reference_stays_so(spark, tmp_path):
    from tessera.plans import registry

    spark.createDataFrame([(1, " <title>x &amp;&amp</title>&lt;&quot;")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r) for r in registry.clean_strings(spark, str(tmp_path)).collect()] == [(1, '<title>x &&amp</title><"')]


def test_type_cascade(value):
    assert value(text.guideline_type(F.lit('"治疗方案"'))) == "其他治疗"
    assert value(text.guideline_type(F.lit('" 疾病 "'))) == "疾病"
    assert value(text.guideline_type(F.lit("高危因素"))) == "流行病学"
    assert value(text.guideline_type(F.lit("zzz"), F.lit("检查"))) == "检查"
    assert value(text.guideline_type(F.lit("zzz"))) == "其他治疗"


def test_tail_types(value):
    assert value(text.tail_type(F.lit("同义词"), F.lit("西药"))) == "西药"
    assert value(text.tail_type(F.lit("并发症"), F.lit("西药"))) == "疾病"
    assert value(text.tail_type(F.lit("并发症"), F.lit("西药"), F.lit("症状"))) == "症状"
    assert value(text.tail_type(F.lit("?"), F.lit("西药"))) is None


@pytest.mark.parametrize("said, found", [
    ("[肺部感染]", ["肺部感染"]),
    ("**最终答案**：[肺癌],[肺炎（尤其是重症）]", ["肺癌", "肺炎"]),
    ("诊断：如 哮喘，建议复查", ["哮喘"]),
    ("不知道", []),
    ("诊断：慢阻肺；慢阻肺、请随诊", ["慢阻肺"]),
])
def test_diagnoses(value, said, found):
    assert value(text.extract_diagnoses(F.lit(said))) == found


def test_ground_truth(value):
    assert value(text.ground_truth(F.lit("x\n诊断：[a],[b]"))) == "[a],[b]"
    assert value(text.ground_truth(F.lit("it is [a ] or [ b] now"))) == "[a], [b]"
    assert value(text.ground_truth(F.lit(" plain "))) == "plain"


def test_options(value):
    assert value(text.option_letters(F.lit("c, a和C"), F.lit(False))) == "AC"
    assert value(text.option_letters(F.lit("ca"), F.lit(True))) == "C"
    assert value(text.option_letters(F.lit("答案是D或B"), F.lit(True))) == "B"
    assert value(text.option_letters(F.lit("无"), F.lit(True))) is None


def test_lines(value):
    raw = "This line is long enough to be joined\nwith the line that follows it here.\nAnother sentence that begins anew here\n\n- bullet\nplain text after a short line, long enough"
    assert value(text.normalise_lines(F.lit(raw))) == "This line is long enough to be joined with the line that follows it here.\nAnother sentence that begins anew here\n- bullet plain text after a short line, long enough"


def test_repeated_paragraphs(value):
    long = "x" * 60
    assert value(text.drop_repeated_paragraphs(F.lit(f"{long}\nshort\n{long}\nshort"))) == f"{long}\nshort\nshort"


def test_numbers(value):
    assert [value(text.float_or(F.lit(x))) for x in ("2.5", "-.5", "1e3", "x", None)] == [2.5, -0.5, 1.0, 1.0, 1.0]


def test_records(spark):
    reply = '("entity"<|>lung<|>organ<|>breathes)##("relationship"<|>lung<|>heart<|>next to<|>0.5)##("entity"<|>x<|>y)##("relationship"<|>a<|>b<|>c<|>d<|>zz)<|COMPLETE|>'
    entities, relations = parsing.records(spark.createDataFrame([("c", reply)], "chunk_id string, reply string"))
    assert [tuple(r) for r in entities.select("entity_name", "entity_type", "description").collect()] == [("LUNG", "ORGAN", "breathes")]
    assert [tuple(r) for r in relations.select("src", "tgt", "weight").collect()] == [("LUNG", "HEART", 0.5), ("A", "B", 1.0)]


def test_json(value):
    assert parsing.first_json('noise {"a": {"b": 1}, "c": "x\ny"} {"d": 2}') == '{"a": {"b": 1}, "c": "xy"}'
    assert parsing.first_json('broken "a": 1, "b": true, c: text') == '{"a": 1, "b": true, "c": "text"}'
    assert parsing.first_json("none") is None and parsing.first_json(None) is None
    assert value(parsing.salvage(F.lit("see [1, 2] there"), "array", "array<int>")) == [1, 2]
    assert value(parsing.judge_reply(F.lit('```json\n{"score": 6, "reason": "x"}```'))) is None
    assert [value(parsing.literal_kind(F.lit(x))) for x in ("null", "True", "-3", "2.5", "abc")] == ["null", "boolean", "integer", "float", "string"]


def test_questions(spark):
    reply = "<qa><question>q1</question><answer>a</answer><evidence><triple>t</triple></evidence></qa> <qa><question>q2</question></qa> <qa><type>tail</type><question>q1</question><answer>b</answer></qa><qa><question>cut"
    got = parsing.qa_items(spark.createDataFrame([(1, reply)], "community_id long, reply string")).orderBy("pos").collect()
    assert [(r["type"], r["answer"], r["evidence"]) for r in got] == [("reasoning", "a", ["t"]), ("tail", "b", [])]


def test_ids(value):
    assert value(hashing.doc_id(F.lit(" a "))) == "doc-0cc175b9c0f1b6a831c399e269772661"
    assert value(hashing.export_id(F.lit("a"))) == "e_0cc175b9c0f1"
    assert 0 <= value(hashing.uniform(F.lit("x"))) < 1


def test_vectors(value):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert value(vectors.cosine(a, b)) == pytest.approx(0.5**0.5)
    assert value(vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) is None


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (1200, [1200, 100]), (1201, [1200, 101]), (2300, [1200, 1200, 100])])
def test_windows(value, n, sizes):
    array = F.array_repeat(F.lit("t"), n)
    assert [len(w) for w in value(chunking.windows(array, 1200, 100))] == sizes


def test_separator_chunks(spark):
    d = spark.createDataFrame([("d", "aa. bb. cc. dd."), ("e", "x" * 25)], "doc_id string, text string")
    got = chunking.separator_chunks(d, size=8, overlap=2).orderBy("doc_id", "chunk_order_index").collect()
    assert [r["content"] for r in got if r["doc_id"] == "d"] == ["aa. bb. ", ". cc. dd"]
    assert [len(r["content"]) for r in got if r["doc_id"] == "e"] == [8, 8, 8, 7, 1]


def test_paragraph_chunks(spark):
    words = "One sentence here. " * 30
    got = chunking.paragraph_chunks(spark.createDataFrame([("d", f"short\n{words}\nend")], "doc_id string, text string"), size=100, overlap=10).collect()
    assert max(r["n_chars"] for r in got) <= 110
    assert got[0]["content"] == "short" and got[-1]["content"] == "end"


def test_groups_within_budget(spark):
    rng = random.Random(2)
    for _ in range(5):
        items = [(str(i), rng.randrange(1, 40)) for i in range(30)]
        got = spark.createDataFrame([(items,)], "items array<struct<id: string, tokens: int>>").select(F.explode(budget.pack_groups(F.col("items"), 30)).alias("p")).select("p.*").collect()
        assert [r["id"] for r in got] == [i for i, _ in items]
        cost, groups = dict(items), {}
        for r in got:
            groups.setdefault(r["group"], []).append(cost[r["id"]] + 1)
        assert sorted(groups) == list(range(len(groups)))
        assert all(sum(g) <= 30 or len(g) == 1 for g in groups.values())


def test_prefix_within(spark):
    rows = spark.createDataFrame([(1, 3), (2, 3), (3, 1)], "i int, n int")
    kept = lambda b: [r["i"] for r in budget.prefix_within(rows, F.col("n"), b, [F.col("i")]).collect()]
    assert kept(8) == [1, 2] and kept(10) == [1, 2, 3] and kept(3) == [] and kept(0) == []
