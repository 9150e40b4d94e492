import inspect

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.mixing import mix
from tests.llm.test_neardup import brute
from tests.llm.test_packing import verify


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        out = stage(spark, docs, data)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "near_copies":
            want = brute([(r["doc_id"], r["text"]) for r in before.collect()], 80, 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, c in want.values()})
        if name == "mix":
            copies = {r["doc_id"]: r["copies"] for r in mix(before).collect() if r["copies"]}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == copies
    rows = [(r["doc_id"], r["text"]) for r in seen["mix"].collect()]
    assert verify(seen["packing"].collect(), rows) == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == sorted(map(tuple, seen["packing"].collect()))


def test_registered_queries_are_the_operators(spark, data):
    assert sorted(int(n.split("_")[0][2:]) for n in queries.queries()) == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries()


def test_near_duplicate_query_matches_its_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op9_shingle_join"]).fetchall())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op9_shingle_join(spark, data).collect())
    assert got == want


def test_near_copies_are_of_five_words_and_80_percent(spark, data):
    # one of 50 words replaced: 43 of 51 four-word shingles are shared (0.843), 41 of 51 five-word ones (0.804)
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "other", *words[26:]])), (3, " ".join(words[::-1]))]
    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r["doc_id"] for r in stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()) == [1, 3]


ODD = [
    (1, "the dog and the cat are in the house", "en", "a", 36), (1, "the dog and the cat are in the house", "en", "a", 36), (2, "der Hund und die Katze sind im Haus", "de", None, 35), (3, None, "en", "a", 0),
    (4, "", None, "b", 0), (5, "... 123", "en", "b", 7), (None, "the cat and the house are in the dog", "en", "a", 36), (6, "the dog has token = abcdefgh12345 here", None, "b", 40), (7, "the house " * 20_000, "en", "c", 200_000),
]


def test_stages_on_odd_tables(spark, data):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = docs.selectExpr("*", *(f"{i} `{c}`" for i, c in enumerate(("node", "key", "size", "copies", "rank", "sig", "version", "ids", "near", "spans", "score", "target", "h", "at"))))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, clashing.limit(0), data)
        assert empty.count() == 0, name
        out = stage(spark, clashing, data)
        if name == "packing":
            assert verify(out.collect(), [(i, t) for i, t, *_ in ODD]) == 0
            continue
        assert out.columns == clashing.columns and empty.columns == clashing.columns, name
        ids = sorted(((r["doc_id"] or 0), (r["text"] or "")[:8]) for r in out.collect())
        if name == "language":
            assert ids == [(0, "the cat "), (1, "the dog "), (1, "the dog "), (2, "der Hund"), (6, "the dog "), (7, "the hous")]
        elif name == "near_copies":
            assert ids == [(0, "the cat "), (1, "the dog "), (2, "der Hund"), (3, ""), (4, ""), (5, "... 123"), (6, "the dog "), (7, "the hous")]
        elif name == "secrets":
            assert len(ids) == len(ODD)
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}[6] == ("the dog has [SECRET] here", 25)
        else:
            assert {i for i, _ in ids} <= {0, 1, 2, 5, 6, 7} and max(ids.count(x) for x in set(ids)) <= 6  # a row that comes twice, three times each


def test_rows_go_to_python_in_bounded_batches(spark, data):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    large = spark.range(0, 600, 1, 1).selectExpr("id doc_id", "repeat('some words ', 2000) text")
    small = spark.createDataFrame(ODD[:4], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(key)
        stage(spark, small, data)
        got = large.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in got) == 600 and max(r["bytes"] for r in got) < 1 << 22, name
    # a bound of the session's own stays
    spark.conf.set(key, "1000000")
    stage(spark, small, data)
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)
