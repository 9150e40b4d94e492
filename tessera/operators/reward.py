"""Scoring texts against a graph: diagnoses, claims and relation paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators.chunking import sentences
from tessera.operators.graph import connected_within_two
from tessera.session import stage_table


#: Characters of a dictionary that is sent to the workers as an automaton; a larger one meets the texts in joins.
DICTIONARY = 1 << 21
_GRAM = 3


def _automaton(names: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for x in names:
        found.add_word(x, x)
    found.make_automaton()
    return found


def _by_dictionary(texts: DataFrame, names: list[str], keys: list[str], text_col: str) -> DataFrame:
    """One pass of an automaton over each text, where it is read. The names inside a name are found the same way, once in a worker."""
    shared = texts.sparkSession.sparkContext.broadcast(names)
    ready: list = []

    @F.pandas_udf("array<struct<name string, pos int>>")
    def find(column):
        import pandas as pd

        if not ready:
            ready.extend((_automaton(shared.value), {}))
        automaton, within = ready

        def one(text):
            first: dict[str, int] = {}
            for end, name in automaton.iter(text or ""):
                first.setdefault(name, end - len(name) + 2)
            part: set[str] = set()
            for name in first:
                if name not in within:
                    within[name] = [x for _, x in automaton.iter(name) if x != name]
                part.update(within[name])
            return [(x, at) for x, at in first.items() if x not in part]

        return pd.Series([one(t) for t in column], dtype=object)

    rows = texts.select(*keys, F.explode_outer(find(F.col(text_col))).alias("m")).where("m is not null")
    return rows.select(*keys, "m.name", "m.pos").distinct()


def _by_grams(texts: DataFrame, names: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Texts and names meet by runs of _GRAM characters (names shorter than that by what they have), of a name the one
    that the fewest names have. Only keys and runs are shuffled; the texts come back to the pairs that met."""

    def runs(text: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))

    each = names.select("name", F.explode(F.when(F.length("name") < _GRAM, F.array("name")).otherwise(runs(F.col("name"), _GRAM))).alias("g"))
    shared = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    anchored = stage_table(each.join(shared, "g").groupBy("name").agg(F.min(F.struct("n", "g")).alias("a")).select("name", F.col("a.g").alias("g")), "anchored-names")
    # a short name is a run of its own length, or the beginning of one
    lengths = [r[0] for r in anchored.select(F.length("g").alias("n")).distinct().collect()]  # _GRAM values at most
    grams = texts.select(*keys, F.explode(F.flatten(F.array(*(runs(F.col(text_col), n) for n in sorted(lengths)) if lengths else (F.array().cast("array<string>"),)))).alias("g")).distinct()
    met = grams.join(anchored, "g").select(*keys, "name").distinct()
    found = met.join(texts.select(*keys, F.col(text_col).alias("__t")), keys).withColumn("pos", F.instr("__t", F.col("name"))).where("pos > 0").select(*keys, "name", "pos").distinct()
    other = found.select(*keys, F.col("name").alias("__o"))
    inside = found.join(other, keys).where((F.col("name") != F.col("__o")) & F.col("__o").contains(F.col("name"))).select(*keys, "name").distinct()
    return found.join(inside, [*keys, "name"], "left_anti")


def mentions(texts: DataFrame, names: DataFrame, key: Sequence[str] = ("id",), text_col: str = "text", least: int = 2, dictionary: int = DICTIONARY) -> DataFrame:
    """``key``, ``name``, ``pos``: names of ``least`` characters and more that occur in a text and aren't part of another
    name that does; ``pos`` is the first place (from 1).

    Names of up to ``dictionary`` characters in all are sent to the workers and looked for in one pass, without a
    shuffle of any text; beyond that size texts and names meet in joins.
    """
    keys = list(key)
    known = stage_table(names.select("name").where(F.length("name") >= least).distinct(), "names")
    if (known.agg(F.sum(F.length("name"))).first()[0] or 0) <= dictionary:
        return _by_dictionary(texts, sorted(r[0] for r in known.collect()), keys, text_col)
    return _by_grams(texts, known, keys, text_col)


def pairs_of(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Unordered pairs of distinct names within each key."""
    keys = list(key)
    other = found.select(*keys, F.col("name").alias("b"), F.col("pos").alias("pos_b"))
    return found.select(*keys, F.col("name").alias("a"), F.col("pos").alias("pos_a")).join(other, keys).where(F.col("a") < F.col("b"))


def sentence_table(texts: DataFrame, marks: str, key: str = "id", text_col: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(sentences(F.col(text_col), marks)).alias("sid", "sentence"))


def diagnosis_reward(rows: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``key``, ``r_dx`` from arrays ``pred`` and ``ref``.

    0 without predictions, 0.5 without references; else the sets' F1, plus 0.3 times 0.7 (one hop) or 0.4 (two
    hops) for each wrong prediction near a missed reference (0.3 at most), plus 0.2 for each wrong one that
    holds or is part of a reference (0.2 at most), 1 at most.
    """
    wrong, missed = F.array_except("pred", "ref"), F.array_except("ref", "pred")
    hit = F.size(F.array_intersect("pred", "ref"))
    p, r = hit / F.size("pred"), hit / F.size("ref")
    f1 = F.when(hit > 0, 2 * p * r / (p + r)).otherwise(0.0)
    bonus = F.least(F.size(F.filter(wrong, lambda x: F.exists("ref", lambda y: x.contains(y) | y.contains(x)))) * 0.2, F.lit(0.2))
    base = rows.select(key, "pred", "ref", wrong.alias("wrong"), missed.alias("missed"), f1.alias("f1"), bonus.alias("bonus"))
    pairs = stage_table(base.select(key, F.explode("wrong").alias("a"), "missed").select(key, "a", F.explode("missed").alias("b")), "reward-pairs")
    near = connected_within_two(pairs, edges).withColumn("v", F.when(F.col("hops") == 1, 0.7).when(F.col("hops") == 2, 0.4))
    credit = near.groupBy(key, "a").agg(F.max("v").alias("v")).groupBy(key).agg((0.3 * F.coalesce(F.sum("v"), F.lit(0.0))).alias("near"))
    out = base.join(credit, key, "left")
    score = F.least(F.col("f1") + F.least(F.coalesce("near", F.lit(0.0)), F.lit(0.3)) + F.col("bonus"), F.lit(1.0))
    return out.select(key, F.when(F.size("pred") == 0, 0.0).when(F.size("ref") == 0, 0.5).otherwise(score).alias("r_dx"))


def graph_reward(texts: DataFrame, names: DataFrame, edges: DataFrame, key: str = "id", text_col: str = "text", marks: str = "。！？\n") -> DataFrame:
    """``key``, ``r_graph``: the share of claims (sentences with two names or more) that the graph supports.

    A claim counts fully where half of its pairs are connected within two hops, and half where some are. Without
    claims the pairs of the whole text count: ratio + (1 - ratio) / 4. Texts with fewer than two names: 0.
    """
    whole = stage_table(mentions(texts, names, [key], text_col), "mentions")
    many = whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(key)
    parts = sentence_table(texts.join(many, key, "left_semi"), marks, key, text_col)
    local = stage_table(pairs_of(mentions(parts, names, [key, "sid"], "sentence"), [key, "sid"]), "claim-pairs")
    claims = connected_within_two(local, edges).groupBy(key, "sid").agg(F.avg(F.col("hops").isNotNull().cast("double")).alias("support"))
    scored = claims.groupBy(key).agg(F.avg(F.when(F.col("support") >= 0.5, 1.0).when(F.col("support") > 0, 0.5).otherwise(0.0)).alias("score"))
    rest = many.join(scored, key, "left_anti")
    all_pairs = stage_table(pairs_of(whole.join(rest, key, "left_semi"), [key]), "text-pairs")
    loose = connected_within_two(all_pairs, edges).groupBy(key).agg(F.avg(F.col("hops").isNotNull().cast("double")).alias("ratio")).select(key, (F.col("ratio") + 0.25 * (1 - F.col("ratio"))).alias("score"))
    return texts.select(key).join(scored.unionByName(loose), key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("r_graph"))


def relation_triples(texts: DataFrame, names: DataFrame, indicators: Sequence[str] = V.RELATION_INDICATORS, key: str = "id", text_col: str = "text", marks: str = "。！？\n；;") -> DataFrame:
    """``key``, ``sid``, ``a``, ``indicator``, ``b``: pairs in a sentence with the first indicator, in list order, whose first place is
    strictly between theirs; else, for names less than 50 apart, the first within 50 of the earlier one."""
    parts = sentence_table(texts, marks, key, text_col)
    pairs = pairs_of(mentions(parts, names, [key, "sid"], "sentence"), [key, "sid"]).join(parts, [key, "sid"])
    lo, hi = F.least("pos_a", "pos_b"), F.greatest("pos_a", "pos_b")
    words = F.array(*(F.struct(F.lit(w).alias("w"), F.instr("sentence", F.lit(w)).alias("p")) for w in indicators))
    between = F.filter(words, lambda x: (x["p"] > lo) & (x["p"] < hi))
    close = F.filter(words, lambda x: (x["p"] > 0) & (F.abs(x["p"] - lo) < 50))
    pick = F.coalesce(F.try_element_at(between, F.lit(1))["w"], F.when(hi - lo < 50, F.try_element_at(close, F.lit(1))["w"]))
    return pairs.select(key, "sid", "a", pick.alias("indicator"), "b").where("indicator is not null")


def path_reward(texts: DataFrame, names: DataFrame, edges: DataFrame, relations: DataFrame, indicators: Sequence[str] = V.RELATION_INDICATORS, key: str = "id", text_col: str = "text", marks: str = "。！？\n；;", whole: bool = False) -> DataFrame:
    """``key``, ``r_path``: the share of a text's relation triples whose indicator is part of, or holds, a relation name
    (``relations``: relation; with ``whole`` it has to be one) and whose ends are connected within two hops."""
    triples = stage_table(relation_triples(texts, names, indicators, key, text_col, marks), "relation-triples")
    # each relation name is held against the list of indicators where it is read
    listed = F.array(*(F.lit(w) for w in indicators))
    agreed = F.filter(listed, lambda w: w == F.col("relation") if whole else w.contains(F.col("relation")) | F.col("relation").contains(w))
    valid = relations.select(F.explode(agreed).alias("indicator")).distinct().withColumn("__ok", F.lit(1))
    hops = connected_within_two(triples, edges).join(valid, "indicator", "left")
    score = hops.groupBy(key).agg(F.avg((F.col("hops").isNotNull() & F.col("__ok").isNotNull()).cast("double")).alias("r"))
    return texts.select(key).join(score, key, "left").select(key, F.coalesce("r", F.lit(0.0)).alias("r_path"))


def total_reward(parts: DataFrame, weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> Column:
    return F.col("r_dx") * weights[0] + F.col("r_graph") * weights[1] + F.col("r_path") * weights[2]


def rewards(texts: DataFrame, references: DataFrame, names: DataFrame, edges: DataFrame, relations: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), key: str = "id", predictions: Column | None = None, indicators: Sequence[str] = V.RELATION_INDICATORS, claim_marks: str = "。！？\n", path_marks: str = "。！？\n；;", whole: bool = False) -> DataFrame:
    """``key``, the three parts and ``reward``. ``references``: key, ref (array of diagnoses); ``predictions``: of a text (None:
    the diagnoses it names); ``whole``: as in ``path_reward``."""
    from tessera.functions.text import extract_diagnoses

    told = extract_diagnoses(F.col("text")) if predictions is None else predictions
    rows = stage_table(texts.join(references, key, "left").select(key, "text", told.alias("pred"), F.coalesce("ref", F.array().cast("array<string>")).alias("ref")), "reward-texts")
    out = diagnosis_reward(rows, edges, key).join(graph_reward(rows, names, edges, key, marks=claim_marks), key).join(path_reward(rows, names, edges, relations, indicators, key, marks=path_marks, whole=whole), key)
    return out.withColumn("reward", total_reward(out, weights))
