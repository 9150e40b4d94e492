import re
from collections import defaultdict

import pytest

from tessera.llm import mixing


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100), ("d", 100)]) == pytest.approx([400 * 5 / 13, 400 * 2 / 13, 400 / 13, 400 * 5 / 13])
    got = mixing.targets([("a", 10), ("b", 500), ("c", 490)])
    assert got[0] == 30 and sum(got) == pytest.approx(1000) and got[1] / got[2] == pytest.approx(2)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [0.0]


def test_mix_meets_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    truth = docs.select("doc_id", "text", "source").toPandas().merge(got, on="doc_id")
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in truth["text"]] == truth["size"].tolist()
    per = truth.groupby("source").agg(n=("size", "sum"), s=("source_size", "first"), t=("target", "first"), k=("taken", "sum"))
    assert (per["n"] == per["s"]).all()
    assert per["t"].tolist() == pytest.approx(mixing.targets([(i, int(n)) for i, n in per["n"].sort_index().items()]))
    largest = truth.groupby("source")["size"].max()
    assert ((per["k"] - per["t"]).abs() <= largest / 2).all()
    assert (truth["taken"] <= 3 * truth["size"]).all() and (truth["taken"] % truth["size"].clip(lower=1) == 0).all()


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two", None), (3, "one two", None), (4, "x", "b"), (None, "y z", "b"), (6, "w " * 50_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 size", "2 target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["size"], r["taken"]) for r in got if r["doc_id"] in (1, 2)} == {1: (0, 0), 2: (0, 0)}
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    assert {r["source_size"] for r in got} == set(sizes.values())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_copies_are_made(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").selectExpr("*", "1 key", "2 row")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
