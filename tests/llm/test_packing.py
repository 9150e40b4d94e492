import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from tessera.llm import packing

public = pytest.importorskip("public_tokenizers")


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array(tokenizer().encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def verify(rows, docs, window=2048):
    """Each id in exactly one piece, no gaps in sequences; the tokens that padding costs."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    copies = defaultdict(list)
    for key, text in docs:
        copies[key].append(text)
    for key, texts in copies.items():
        starts = defaultdict(int)
        ids = ids_of(texts[0])
        assert sum(r["length"] for r in pieces[key]) == len(ids) * len(texts)
        for r in pieces[key]:
            assert r["doc_tokens"] == len(ids) and r["length"] > 0
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            starts[r["start"]] += 1
            starts[r["start"] + r["length"]] -= 1
        assert {k: v for k, v in starts.items() if v} == {0: len(texts), len(ids): -len(texts)}
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = packing.pack(docs).collect()
    assert verify(rows, [(r["doc_id"], r["text"]) for r in docs.collect()]) == 0
    assert sorted(rows) == sorted(packing.pack(docs).collect())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (4, "word " * 30_000), (5, "naïve 文字 \n\n  x"), (6, "hello")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 ids", "2 n")
    assert verify(packing.pack(docs).collect(), rows) == 0
    nothing = packing.pack(docs.limit(0))
    assert nothing.count() == 0
    lone = packing.pack(spark.createDataFrame([(None, "x")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["length"]) for r in lone] == [(None, 2)]


def test_neighbours_are_bm25():
    rng = np.random.default_rng(3)
    bags = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(30)]
    idf, mean = rng.random(40) + 0.1, float(np.mean([len(b) for b in bags]))
    shard = packing.Shard(bags, idf, mean)

    def weight(t, b):
        tf = int((b == t).sum())
        return idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(b) / mean)) if tf else 0.0

    for seed in range(30):
        terms = {int(t) for t in bags[seed]}
        got, want = shard.neighbours(seed), [sum(weight(t, b) for t in terms) for b in bags]
        others = [i for i in range(30) if i != seed]  # the seed isn't its own neighbour
        assert [got[i] for i in others] == pytest.approx([want[i] for i in others])


def test_related_documents_share_windows():
    rng = np.random.default_rng(4)
    ids = [(rng.integers(0, 50, 200) + 50 * (i % 4)).astype(np.uint16) for i in range(40)]
    same = total = 0
    for pieces in packing.fill(ids, np.ones(200), 200.0, 2048):
        topics = [d % 4 for d, _, _ in pieces]
        same += sum(t == topics[0] for t in topics)
        total += len(topics)
    assert same / total > 0.9


def test_the_order_says_nothing_of_length(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = packing.tokenise(docs).where("kind = 0").select("near", "n").toPandas()
    assert abs(rows["near"].rank().corr(rows["n"].rank())) < 0.25
    ordered = rows.sort_values("near")["n"].to_numpy()
    parts = [ordered[i : i + 100].mean() for i in range(0, len(ordered), 100)]
    assert max(parts) < 2 * np.median(parts)
