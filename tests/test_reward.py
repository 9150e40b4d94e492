import pytest

from tessera.operators import evaluate, reward

EDGES = [("肺癌", "咳嗽"), ("肺炎", "咳嗽"), ("肺癌", "手术")]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(EDGES, "src string, tgt string")
    names = spark.createDataFrame([(x,) for x in sorted({x for e in EDGES for x in e} | {"小细胞肺癌", "孤立"})], "name string")
    return names, edges


def test_mentions_drop_parts_of_longer_names(spark, graph):
    t = spark.createDataFrame([(1, "小细胞肺癌引起咳嗽"), (2, "肺癌"), (3, "")], "id long, text string")
    assert sorted((r["id"], r["name"], r["pos"]) for r in reward.mentions(t, graph[0]).collect()) == [(1, "咳嗽", 8), (1, "小细胞肺癌", 1), (2, "肺癌", 1)]


def test_diagnosis_cases(spark, graph):
    rows = [(1, [], ["肺癌"]), (2, ["肺癌"], []), (3, ["肺癌"], ["肺癌"]), (4, ["手术"], ["肺癌"]), (5, ["肺炎"], ["肺癌"]), (6, ["晚期肺癌"], ["肺癌"]), (7, [], [])]
    got = dict(reward.diagnosis_reward(spark.createDataFrame(rows, "id long, pred array<string>, ref array<string>"), graph[1]).collect())
    assert got == pytest.approx({1: 0.0, 2: 0.5, 3: 1.0, 4: 0.21, 5: 0.12, 6: 0.2, 7: 0.0})


def test_graph_cases(spark, graph):
    t = spark.createDataFrame([(1, "肺癌有咳嗽。孤立"), (2, "肺癌。孤立"), (3, "肺癌"), (4, "孤立和肺癌。肺癌与手术")], "id long, text string")
    got = dict(reward.graph_reward(t, *graph).collect())
    assert got == pytest.approx({1: 1.0, 2: 0.25, 3: 0.0, 4: 0.5})


def test_path_cases(spark, graph):
    t = spark.createDataFrame([(1, "肺癌引起咳嗽"), (2, "肺癌和咳嗽"), (3, "孤立引起咳嗽；肺癌引起手术")], "id long, text string")
    known = spark.createDataFrame([("引起症状",)], "relation string")
    assert dict(reward.path_reward(t, *graph, known).collect()) == pytest.approx({1: 1.0, 2: 0.0, 3: 0.5})


def test_an_indicator_that_holds_a_relation_is_not_it(spark, graph):
    t = spark.createDataFrame([(1, "肺癌引起了咳嗽"), (2, "肺癌引起咳嗽")], "id long, text string")
    known = spark.createDataFrame([("引起",)], "relation string")
    paths = lambda whole: dict(reward.path_reward(t, *graph, known, ("引起了", "引起"), whole=whole).collect())
    assert paths(True) == pytest.approx({1: 0.0, 2: 1.0}) and paths(False) == pytest.approx({1: 1.0, 2: 1.0})


def test_unknown_answer_earns_nothing(spark, graph):
    texts = spark.createDataFrame([(1, "我不知道"), (2, "最终答案：[肺癌]")], "id long, text string")
    refs = spark.createDataFrame([(1, ["肺癌"]), (2, ["肺癌"])], "id long, ref array<string>")
    got = {r["id"]: r["reward"] for r in reward.rewards(texts, refs, *graph, spark.createDataFrame([("x",)], "relation string")).collect()}
    assert got == pytest.approx({1: 0.0, 2: 0.5})


def test_total_with_whole_relations(spark, graph):
    texts = spark.createDataFrame([(1, "肺癌引起了咳嗽")], "id long, text string")
    refs, known = spark.createDataFrame([(1, ["手术"])], "id long, ref array<string>"), spark.createDataFrame([("引起",)], "relation string")
    total = lambda whole: reward.rewards(texts, refs, *graph, known, indicators=("引起了", "引起"), whole=whole).first()
    loose, strict = total(False), total(True)
    assert (loose["r_path"], strict["r_path"]) == (1.0, 0.0) and loose["r_graph"] == strict["r_graph"] == 1.0
    assert loose["reward"] - strict["reward"] == pytest.approx(0.2)


def test_set_metrics(spark):
    rows = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b"])], "pred array<string>, gold array<string>")
    got = evaluate.set_metrics(rows).collect()
    assert [(r["em"], r["precision"], r["recall"]) for r in got] == [(1, 1, 1), (0, 0, 0), (0, 0.5, 1)]


def test_missing_verdicts_count_as_wrong(spark):
    rows = spark.createDataFrame([(True, True, "AB", "AB"), (None, True, "A", "AB"), (False, True, "A", "AB"), (False, False, "A", "B")], "verdict boolean, multi boolean, answer string, gold string")
    assert tuple(evaluate.choice_accuracy(rows).first()) == (4, 1, 1, 25.0)


def test_advantage_of_a_single_sample(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0)], "g long, reward double")
    assert [round(r["advantage"], 3) for r in evaluate.group_advantage(rows, "g").orderBy("g", "reward").collect()] == [0.0, -0.707, 0.707]
