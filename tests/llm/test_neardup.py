import random
import re
import string
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import neardup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sets_of(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, percent=85, size=4):
    sets = {k: sets_of(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if either and 100 * both >= percent * either:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def run(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 key", "2 node", "3 n")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.join_classes(docs).collect()}


def corpus(rng, n, base_words=(6, 220)):
    vocabulary = ["".join(rng.choice("abcdeF") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(*base_words))]
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                i = rng.randrange(len(copy))
                copy[i : i + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            out.append(" ".join(copy) if rng.random() < 0.9 else "\n".join(copy).upper())
    return [(i, t) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(random.Random(seed), 260)
    assert run(spark, rows) == brute(rows)


def test_chains_and_a_large_group(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):  # each a few steps from the last: linked along the chain alone
        words[(7 * i) % 120] = f"x{i}"
        rows.append((1000 - i, " ".join(words)))
    base = [f"b{i}" for i in range(150)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(150)] = f"c{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(copy)))
    rows += [(3000 + i, "the same text in every copy of it") for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one  two\nthree"), (8, "one two three four"), (9, "É é"), (10, "é é"), (11, "a\x1cb c"), (12, "a b c"), (13, "w " * 60_000)]
    got = run(spark, rows)
    assert got == brute(rows) and got[5] == (1, 4) and got[1] == (0, 1) and got[13] == (1, 13)
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in neardup.join_classes(docs).collect()) == [(0, 0, None), (0, 2, None), (1, 2, 1), (1, 2, 1)]
    assert neardup.join_classes(docs.limit(0)).count() == 0


def test_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for n in (7, 20, 60, 200, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            limit = neardup.most_apart(len(a), len(a))
            drop = int(rng.integers(0, limit // 2 + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
            apart = len(np.setxor1d(a, b))
            bits = [np.unpackbits(np.array(neardup.parity_bits(x), np.int64).view(np.uint8)) for x in (a, b)]
            assert (bits[0] != bits[1]).sum() <= apart
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * len(np.union1d(a, b)) and apart:
                assert set(neardup.part_keys(a)) & set(neardup.part_keys(b)), (n, drop)


def test_sizes_at_band_edges_meet():
    rng = np.random.default_rng(6)
    for n in range(6, 400):
        a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64))
        more = n * 100 // 85 - n
        b = np.sort(np.concatenate([a, rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        if more:
            assert set(neardup.part_keys(a)) & set(neardup.part_keys(b)), n


def test_one_of_each_group_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_other_shingle_sizes_and_thresholds(spark):
    rows = corpus(random.Random(8), 200, (20, 120))
    rows += [(1000 + i, " ".join(f"{c}{j}" if j != 25 or k == 0 else "edit" for j in range(50))) for i, (c, k) in enumerate((c, k) for c in "xyz" for k in range(2))]
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.translate(LOWER).split()) for k, t in rows)}
    root = {k: k for k in grams}
    for a, b in combinations(sorted(grams), 2):
        if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b]):
            x, y = sorted((root[a], root[b]))
            root = {k: x if v == y else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.join_classes(docs, percent=80, size=5).collect()}
    assert got == {k: (len(grams[k]), root[k]) for k in grams} and got[1001][1] == 1000


def test_texts_of_one_id_are_documents_of_their_own(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    a2, b2 = [*a[:30], "x", *a[30:]], [*b[:30], "y", *b[30:]]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a2)), (3, " ".join(b2)), (1, " ".join(a)), (4, " ".join(a[::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect())
    assert got == sorted({rows[0], rows[1], rows[5]})
    classes = sorted((r["doc_id"], r["component_id"]) for r in neardup.join_classes(docs).collect())
    assert classes == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    # a text whose first id has another text too is compared by its own set alone
    mixed = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(a2[:20])), (2, " ".join(a2)), (3, " ".join(b))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.join_classes(mixed).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_keep_one_edges(spark):
    same = "one two three four five six"
    rows = [(1, None, 1), (1, None, 2), (2, "", 3), (3, " \n", 4), (4, same, 5), (5, same, 6), (4, same, 7), (None, same, 8), (None, None, 9), (7, "w " * 60_000, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").selectExpr("*", "1 key", "2 sig", "3 version", "4 rep")
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:3]) for r in kept.collect()) == sorted([(0, ""), (0, "one"), (1, ""), (2, ""), (3, " \n"), (4, "one"), (7, "w w")])
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_large_sets_are_told_apart_by_wide_sketches(spark):
    rng = random.Random(11)
    passage = [f"common{i}" for i in range(400)]
    rows = []
    for i in range(12):  # long texts that share a passage, each with a near copy
        words = [f"t{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(2_000, 6_000))]
        words[100:100] = passage
        copy = list(words)
        for _ in range(len(words) // 60):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    assert run(spark, rows) == brute(rows)


def test_wide_sketches_bound_differences_and_fold():
    rng = np.random.default_rng(12)
    for n in (1025, 2048, 3000, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        bits = neardup.wide_bits(a)
        assert 64 * len(bits) >= len(a) and neardup.wide_bits(a[:1024]) is None
        half = [x ^ y for x, y in zip(bits[: len(bits) // 2], bits[len(bits) // 2 :])]
        assert half == neardup.parity_bits(a, 32 * len(bits))
        drop = n // 20
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)]))
        ones = lambda x: np.unpackbits(np.array(x, np.int64).view(np.uint8))
        assert (ones(bits) != ones(neardup.parity_bits(b, 64 * len(bits)))).sum() <= len(np.setxor1d(a, b))


def test_a_group_of_near_copies_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(600):  # one to six changed words: many are in reach of a pivot, many of a few others alone
        copy = list(base)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(150)] = f"c{rng.randrange(10**7)}"
        rows.append((i, " ".join(copy)))
    staged, stage_table = {}, neardup.stage_table

    def stage(df, name):
        out = stage_table(df, name)
        staged[name] = out.count() if name == "cross-pairs" else 0
        return out

    monkeypatch.setattr(neardup, "stage_table", stage)
    assert run(spark, rows) == brute(rows)
    assert staged["cross-pairs"] < len(rows) // 2


def test_pairs_across_components_come_once_though_they_share_many_keys(spark):
    keys = {1: range(0, 80, 2), 2: range(20, 100), 3: [99, 78, 3], 4: [500], 5: [500]}
    rows = spark.createDataFrame([(k, n, min(n, 4)) for n, of in keys.items() for k in of], "key long, node long, component long")
    traits = spark.createDataFrame([(n, 100, [0] * (neardup.BITS // 64)) for n in keys], "node long, n long, bits array<long>")
    got = sorted((r["a"], r["b"]) for r in neardup._across(neardup._with_earlier(rows).join(traits, "node"), 85).collect())
    # 2 and 3 share 78 and, with none of the keys in between in common, 99
    assert sorted(set(got)) == [(1, 2), (1, 3), (2, 3)] and len(got) <= 4
