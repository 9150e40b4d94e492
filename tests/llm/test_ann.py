import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann

QUERY = "vec_id % 50 = 0"


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(1).normal(size=(20, 48))
    y = ann.Rotation(48, 3)(x)
    assert np.allclose(x @ x.T, y @ y.T)
    assert (ann.axis(np.array([[0.1, -2.0], [3.0, 1.0]])) == [3, 0]).all()


def test_recall_at_other_sizes(spark, data):
    for name in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"{data.replace('sf0.001', name)}/embeddings.parquet")
        assert ann.recall(ann.search(v, F.expr(QUERY)), v, F.expr(QUERY)) >= 0.9


def test_recall_and_scores(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    got = ann.search(v, F.col("vec_id") % 10 == 0).cache()
    assert ann.recall(got, v, F.col("vec_id") % 10 == 0) >= 0.9
    table = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in v.collect()}
    for r in got.collect():
        a, b = table[r["query_id"]], table[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12) and r["query_id"] != r["vec_id"]
    assert {r["n"] for r in got.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {5}


def test_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=64)
    rows = [(i, [float(x) for x in (hot if i % 3 else rng.normal(size=64))]) for i in range(300)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 100).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 4), (4, 5), (5, 7)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (50, [0.5, 0.0]), (50, [0.5, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 shard", "2 block")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 4)) for r in ann.search(v, F.expr(QUERY)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 1.0), (0, 2, 1, 0.995), (50, 1, 0, 1.0), (50, 2, 1, 0.995)]
    assert ann.search(v.limit(0), F.expr(QUERY)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 6])
def test_small_tables_give_all_candidates(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x[1] = -x[0]  # on the last axis of every table
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"]) for r in ann.search(v, F.col("vec_id") == 0).orderBy("rank").collect()]
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    order = sorted(range(1, n), key=lambda i: -(unit[i] @ unit[0]))
    assert got == list(enumerate(order[:5], 1)) and len(got) == min(n - 1, 5)


def test_repeated_ids_are_one_vector(spark):
    rng = np.random.default_rng(3)
    other = [(i, [float(c) for c in rng.normal(size=64)]) for i in range(20, 30)]
    hot = [float(c) for c in rng.normal(size=64)]
    rows = [(0, hot)] + [(7, hot)] * 6 + [(8, [c * (1 + i) + i for c in hot]) for i in range(6)] + other
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    x = {}
    for i, v in rows[1:]:
        x[i] = max(x.get(i, -2), np.dot(v, hot) / np.sqrt(np.dot(v, v) * np.dot(hot, hot)))
    want = sorted(x, key=lambda i: (-round(x[i], 12), i))[:5]
    ids = [r["vec_id"] for r in got]
    assert ids[:2] == want[:2] == [7, 8] and len(set(ids)) == 5
    assert [r["score"] for r in got] == pytest.approx([x[i] for i in ids], abs=1e-12)


def test_hot_buckets_are_split(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=16)
    rows = [(i, [float(x) for x in (hot if i % 3 else rng.normal(size=16))]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(ann.search(v, F.col("vec_id") % 20 == 0).collect())
    assert sorted(ann.search(v.repartition(7), F.col("vec_id") % 20 == 0, part=50, block=7).collect()) == whole


def test_probes_are_the_nearest_codes():
    unit = np.random.default_rng(5).normal(size=(6, 8))
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    for axes in (1, 2, 3):
        turns = ann.rotations(8, 1, axes, 5)
        signed = [np.concatenate([t, -t], 1) for t in (r(unit) for r in turns)]
        for share in (0.0, 0.05, 0.4, 1.0):
            for i, got in enumerate(ann.probes(unit, turns, share)):
                total = signed[0][i]
                for s in signed[1:]:
                    total = (total[:, None] + s[i]).ravel()
                m = max(1, -int(-share * 16**axes // 1))
                assert len(got) == len(set(got.tolist())) == m
                assert np.allclose(np.sort(total[got]), np.sort(total)[-m:])
        # a vector's own code is the first of its probes
        assert all(c in p for c, p in zip(ann.codes(unit, turns), ann.probes(unit, turns, 0.0)))


def test_the_share_of_probes_falls():
    shares = [ann.share_of(n) for n in (500, 2_000, 10_000, 50_000, 10**6, 10**9)]
    assert shares == sorted(shares, reverse=True) and shares[0] == 0.2 and shares[-1] < 0.006


def test_probes_do_not_jump_beyond_a_size():
    axes = getattr(ann, "axes_of", lambda n: ann.AXES)
    probed = [ann.share_of(n) * 128 ** axes(n) for n in (500, 50_000, 2**20, 2**20 + 1, 10**7, 10**9)]
    assert probed == sorted(probed, reverse=True) and probed[2] == pytest.approx(probed[3], rel=1e-3)
