import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import langid


def test_folds_and_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(docs).toPandas()
    truth = docs.select("doc_id", "lang").toPandas().merge(got, on="doc_id")
    assert len(truth) == docs.count()
    assert list(truth["held_out"]) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in truth["doc_id"]]
    out = truth[truth["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95
    assert truth["score"].between(0, 1).all()


def test_edges(spark):
    rows = [(i, "the cat and the dog are in the house", "en") for i in range(9)] + [(20 + i, "der Hund und die Katze sind im Haus", "de") for i in range(9)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 --- 456", "de"), (103, "und der Hund", None), (None, "the dog", None), (None, "the dog", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 lang_pred", "2 score")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and by[102]["score"] == 0
    assert by[103]["lang_pred"] == "de" and by[None]["lang_pred"] == "en" and not by[None]["held_out"]
    assert langid.identify(docs.limit(0)).count() == 0
    unlabelled = langid.identify(docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_long_texts_are_read_whole():
    assert sum(len(x) for x in langid.buckets("ab " * 400_000, (1, 2, 3), 12)) == sum(len(x) for x in langid.buckets("ab " * 200_000, (1, 2, 3), 12)) * 2
    whole = [x for x in langid.buckets("xy" * 300_000, (3,), 12)]
    assert sum(map(len, whole)) == 600_000


def test_filter_keeps_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    bad = spark.createDataFrame([(10_001, "....", "en", "s", 4), (10_002, None, None, "s", 0)], docs.schema)
    assert langid.keep_identified(docs.unionByName(bad)).where("doc_id > 10000").count() == 0


def brute(model, counts, text):
    """Naive Bayes over n-grams told apart by their own hash, one text at a time."""
    fold = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    padded, grams = f" {fold} ", []
    for n in model.orders:
        grams += [g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g[0] != " " or g[-1] != " "]
    found = []
    for g in grams:
        h = len(g)
        for c in g:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % (1 << 64)
            h ^= h >> 29
        found.append(h >> (64 - model.bits))
    scores = {}
    for i, lang in enumerate(model.languages):
        total = sum(counts[lang].values())
        scores[lang] = [sum(math.log((counts[lang][b] + 0.5) / (total + 0.5 * (1 << model.bits))) for b in found), model.prior[i]]
    best = max(model.languages, key=lambda x: sum(scores[x]))
    share = min(len(found), model.weight) / len(found)
    odds = {x: math.exp(share * (a - scores[best][0]) + p - scores[best][1]) for x, (a, p) in scores.items()}
    return found, best, odds[best] / sum(odds.values())


def test_batches_match_brute_force(spark):
    train = [("en", "The cat sat on the mat, and then some."), ("en", "A house"), ("de", "Der Hund läuft über die Straße"), ("fr", "Où est le café près d'ici?")]
    model = langid.fit(spark.createDataFrame(train, "lang string, text string"))
    counts = {x: Counter() for x in model.languages}
    texts = ["the dog", "Straße und Hund", "le café", "x", "a-b c1d", "İstanbul ß", "\U0001d400 𐐀", "word " * 40, "\n\ttabs\n"]
    for lang, text in train:
        counts[lang].update(brute(model, {x: Counter() for x in model.languages}, text)[0])
    names, scores = model.predict([*texts, None, "", "123 !"])
    assert names[-3:] == ["und"] * 3 and list(scores[-3:]) == [0.0] * 3
    for text, name, score in zip(texts, names, scores):
        found, best, p = brute(model, counts, text)
        assert sorted(np.concatenate(list(langid.buckets(text, model.orders, model.bits)))) == sorted(found)
        assert name == best and score == pytest.approx(p, rel=1e-9), text


def test_ties_go_to_the_first_language(spark):
    model = langid.fit(spark.createDataFrame([("b", "same words"), ("a", "same words")], "lang string, text string"))
    assert model.predict(["same words", "others"])[0] == ["a", "a"]


def test_slices_change_nothing(monkeypatch):
    text = "ab cd, ÉF " * 50 + "z"
    whole = sorted(np.concatenate(list(langid.buckets(text, (1, 2, 3), 12))))
    for size in (1, 2, 3, 7, 64, 500):
        monkeypatch.setattr(langid, "_SLICE", size)
        assert sorted(np.concatenate(list(langid.buckets(text, (1, 2, 3), 12)))) == whole


def test_filter_edges(spark):
    docs = spark.createDataFrame([(1, "the dog", "en"), (1, "the dog", "en"), (2, None, "en"), (3, "...", None), (None, "the cat", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 lang_pred")
    assert sorted((r["doc_id"] or 0) for r in langid.keep_identified(docs).collect()) == [0, 1, 1]
    assert langid.keep_identified(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs.withColumn("lang", docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).count() == 5
