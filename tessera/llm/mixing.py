"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document's expected number of copies grows with a power
of its size, up to a most, so that a source's expected words are its target. Whole copies are certain;
the rest is the document's own inclusion probability, and documents are ranked by random odds divided
by inclusion odds (Pareto order sampling, Rosén 1997). Sources are split into strata of like sizes. Each
stratum's sample has a fixed size, the first so many of its ranking; the sizes are set so that a source's
words come to its target: first from expected words, the largest strata first, then corrected
for what the rankings really hold.

A ranking is never sorted as one group: ranks are cut into bins, counts of bins give the bin in which
a stratum's sample ends, and only that bin's documents are put in order. What a stratum's sample comes
to is one threshold, so documents are taken where they are read and none of their texts is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stage_table

# Fixed values of the mix: the weights that sources take in turn, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Expected copies go with this power of a document's size.
TILT = 0.25
#: Strata to a doubling of size, bins of a stratum's ranks, and corrections of the samples' sizes.
STEPS, BINS, CORRECTIONS = 2, 1 << 10, 2
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> list[float]:
    """Targets of sources given in order: shares of all words by weight, stopped at ``most`` times a
    source's size, the excess shared again by weight among the rest until none is above."""
    total = sum(n for _, n in sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        per = left / sum(weight[i] for i in free)
        over = {i for i in free if per * weight[i] > most * sizes[i][1]}
        if not over:
            for i in free:
                out[i] = per * weight[i]
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
        free -= over
    return out


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` of each source, by rounds of plain aggregation.

    Sources in order of code point with null last, which ranges of sources give without one task that sorts
    them all. In each round the share per unit of weight follows
    from sums over all sources; sources above their limit are fixed there. A round fixes one source at
    least, and in practice a few rounds do; the rounds read a table with one row per source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    placed = stage_table(by.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "source-sizes")
    # a source's number is its place in its range of sources and the numbers of sources in the ranges before
    ranges = placed.groupBy(F.shiftright("__at", 33).alias("__range")).agg(F.count(F.lit(1)).alias("n"))
    before = ranges.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    now = placed.withColumn("__range", F.shiftright("__at", 33)).join(before, "__range").select("source", "source_size", turn.alias("weight"), F.lit(None).cast("double").alias("fixed"))
    now = stage_table(now, "source-weights")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left, weight = now.agg(F.lit(float(total)) - F.coalesce(F.sum("fixed"), F.lit(0.0)), F.sum(F.when(F.col("fixed").isNull(), F.col("weight")))).first()
        if not weight:
            break
        per = left / weight
        over = F.col("fixed").isNull() & (F.lit(per) * F.col("weight") > F.lit(float(most)) * F.col("source_size"))
        if not now.where(over).limit(1).count():
            now = now.withColumn("fixed", F.coalesce("fixed", F.lit(per) * F.col("weight")))
            break
        now = stage_table(now.withColumn("fixed", F.when(over, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("fixed"))), "source-targets")
    return stage_table(now.select("source", "source_size", F.col("fixed").alias("target")), "source-targets")


def expected_factor(strata: list[tuple[float, float]], target: float, most: int = MOST_COPIES) -> float:
    """The factor c for which copies of min(most, c * size ** tilt) come to ``target`` words; infinite where all
    documents are at the most.

    ``strata``: of each stratum, the largest documents first, the sum of sizes and the sum of size ** (1 + tilt). The
    documents of a stratum are taken to reach the most together.
    """
    left, free = target, sum(t for _, t in strata)
    for words, tilted in strata:
        c = left / free if free > 0 else math.inf
        if c * tilted <= most * words:
            return c
        left, free = left - most * words, free - tilted
    return math.inf


def first_sizes(strata: list[tuple[int, float, float]]) -> list[int]:
    """Sample sizes of strata (documents that may be taken, their expected number and words), the largest documents
    first. What rounding leaves short or over goes to the next stratum."""
    out, due = [], 0.0
    for n, number, words in strata:
        due += words
        mean = words / number if number > 0 else 0.0
        out.append(min(n, max(0, math.floor(due / mean + 0.5))) if mean else 0)
        due -= out[-1] * mean
    return out


def corrected_sizes(strata: list[tuple[int, int, float]], short: float) -> list[int]:
    """Sample sizes of strata (documents, sample size, mean words) after whole documents were added, or taken away
    where ``short`` is negative, from the largest strata down, without passing ``short``."""
    out = []
    for n, k, mean in strata:
        step = max(-k, min(n - k, int(short / mean) if mean else 0))
        short -= step * mean
        out.append(k + step)
    return out


_ONE = 1 << 30  # copies are counted in units of 1 / _ONE, so that no rounding differs between runs


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text = F.col(f"`{text_col}`").cast("string")
    size = word_count(text)
    return [F.col(f"`{source_col}`").cast("string").alias("__source"), size.alias("__size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text).alias("__key")]


def _ranked(rows: DataFrame, factors: DataFrame, tilt: float, bins: int) -> DataFrame:
    """``rows`` (__source, __size, __key and others) with target and source_size, and of each document its stratum,
    whole copies, the chance of one more (in 1 / _ONE), its Pareto rank and that rank's bin."""
    # one row per source, under the planner's own threshold for a broadcast and joined by shuffle beyond
    rows = rows.join(factors, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    copies = F.least(F.col("__factor") * F.pow(F.col("__size").cast("double"), F.lit(tilt)), F.lit(float(MOST_COPIES)))
    rows = rows.withColumn("__copies", F.when(F.col("__size") > 0, F.floor(copies * _ONE + 0.5)).otherwise(0).cast("long"))
    rows = rows.withColumn("__stratum", F.floor(F.log2(F.greatest("__size", F.lit(1)).cast("double")) * STEPS).cast("int"))
    rows = rows.withColumn("__whole", F.shiftright("__copies", 30)).withColumn("__chance", F.col("__copies").bitwiseAND(F.lit(_ONE - 1)))
    # random odds over inclusion odds, each within (0, 1)
    u = (F.pmod(F.col("__key"), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    rank = F.when(F.col("__chance") > 0, u / (1 - u) * (F.lit(_ONE) - F.col("__chance")) / F.col("__chance"))
    rows = rows.drop("__copies").withColumn("__rank", rank)
    # ranks lie in (0, inf); r / (1 + r) spreads them over bins without changing their order
    return rows.withColumn("__bin", F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * bins), F.lit(bins - 1)).cast("int"))


def _per_source(rows: DataFrame, f, kind: str) -> DataFrame:
    """``f`` of each source's rows, of which there is one for each stratum, the largest documents first."""

    def run(part):
        return f(part.sort_values("__stratum", ascending=False))

    return rows.groupBy("__source").applyInPandas(run, kind)


def _cuts(ranked: DataFrame, bins: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where a stratum's sample ends: the rank and key of its last document, how many of the rows that equal it are
    taken and how many there are, and the sample's words. ``bins``: rows and words by stratum and bin."""
    by = Window.partitionBy("__source", "__stratum")
    before = by.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bound = [F.col("__source").eqNullSafe(F.col("s")), F.col("__stratum") == F.col("h")]
    wanted = sizes.where("k > 0").select(F.col("__source").alias("s"), F.col("__stratum").alias("h"), "k")
    run = bins.join(wanted, bound).select("s", "h", "k", "__bin", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words"))
    edge = stage_table(run.where("below < k and below + n >= k").select("s", "h", F.col("__bin").alias("b"), (F.col("k") - F.col("below")).alias("k"), "words"), "mix-edges")
    inner = ranked.join(edge, [*bound, F.col("__bin") == F.col("b")])
    order = by.orderBy("__rank", "__key")
    # the bin where the sample ends, in order: the 1/bins share of a stratum
    inner = inner.withColumn("i", F.row_number().over(order)).withColumn("first", F.rank().over(order))
    inner = inner.withColumn("equal", F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)))
    inner = inner.withColumn("upto", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = inner.where("i = k").select("s", "h", F.col("__rank").alias("cut_rank"), F.col("__key").alias("cut_key"), (F.col("i") - F.col("first") + 1).alias("some"), "equal", (F.col("words") + F.col("upto")).alias("words"))
    return stage_table(last, "mix-cuts")


def _plan(sized: DataFrame, tilt: float, bins: int) -> tuple[DataFrame, DataFrame]:
    """From a written table with __source, __size and __key: the sources' factors, sizes and targets, and the cuts of
    all strata."""
    per = source_targets(sized.select(F.col("__source").alias("source"), F.col("__size").alias("size")))
    goal = per.select(F.col("source").alias("__s"), "source_size", "target")
    stratum = F.floor(F.log2(F.col("__size").cast("double")) * STEPS).cast("int")
    # whole numbers, for sums that don't depend on their order
    tilted = F.sum(F.floor(F.pow(F.col("__size").cast("double"), F.lit(1 + tilt)) * 16).cast("long"))
    strata = sized.where("__size > 0").groupBy("__source", stratum.alias("__stratum")).agg(F.sum("__size").alias("words"), tilted.alias("tilted"))

    def solve(part):
        import pandas as pd

        c = expected_factor([(w, t / 16) for w, t in zip(part["words"], part["tilted"])], part["target"].iloc[0])
        return pd.DataFrame({"__s": part["__source"].iloc[:1], "__factor": [c]})

    solved = _per_source(strata.join(goal, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s"), solve, "__s string, __factor double")
    factors = goal.join(solved.withColumnRenamed("__s", "__t"), F.col("__s").eqNullSafe(F.col("__t")), "left").select("__s", "source_size", "target", F.coalesce("__factor", F.lit(0.0)).alias("__factor"))
    factors = stage_table(factors, "mix-factors")
    ranked = _ranked(sized, factors, tilt, bins).where("__size > 0")
    counted = ranked.groupBy("__source", "__stratum", "__bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__size").alias("words"), F.sum(F.col("__whole") * F.col("__size")).alias("whole"),
        F.sum(F.shiftright("__chance", 10)).alias("number"), F.sum(F.shiftright("__chance", 16) * F.col("__size")).alias("expected"), F.first("target").alias("target"),
    )
    counted = stage_table(counted, "mix-bins")
    in_bins = counted.where("__bin is not null")
    by = counted.groupBy("__source", "__stratum").agg(F.sum(F.when(F.col("__bin").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.sum("whole").alias("whole"), F.sum("number").alias("number"), F.sum("expected").alias("expected"), F.first("target").alias("target"))
    columns = "__source string, __stratum int, n long, k long, mean double, rest double"

    def start(part):
        number, expected = part["number"] / (1 << 20), part["expected"] / (1 << 14)
        part = part.assign(k=first_sizes(list(zip(part["n"], number, expected))), mean=(expected / number.where(number > 0)).fillna(0.0), rest=part["target"] - part["whole"].sum())
        return part[[x.split()[0] for x in columns.split(", ")]]

    def correct(part):
        short = part["rest"].iloc[0] - part["words"].sum()
        return part.assign(k=corrected_sizes(list(zip(part["n"], part["k"], part["mean"])), short))[[x.split()[0] for x in columns.split(", ")]]

    sizes = stage_table(_per_source(by, start, columns), "mix-sizes")
    for left in range(CORRECTIONS, -1, -1):
        cuts = _cuts(ranked, in_bins, sizes)
        if not left:
            break
        now = sizes.join(cuts.select("s", "h", "words"), [F.col("__source").eqNullSafe(F.col("s")), F.col("__stratum") == F.col("h")], "left").drop("s", "h").fillna(0, ["words"])
        fresh = stage_table(_per_source(now, correct, columns), "mix-sizes")
        changed = fresh.join(sizes.select(F.col("__source").alias("s"), F.col("__stratum").alias("h"), F.col("k").alias("was")), [F.col("__source").eqNullSafe(F.col("s")), F.col("__stratum") == F.col("h")]).where("k <> was")
        if not changed.limit(1).count():
            break
        sizes = fresh
    return factors, cuts


def _taken(rows: DataFrame, factors: DataFrame, cuts: DataFrame, tilt: float, bins: int) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    own = rows.columns
    ends = cuts.select("s", "h", "cut_rank", "cut_key", "some", "equal")
    out = _ranked(rows, factors, tilt, bins).join(ends, [F.col("__source").eqNullSafe(F.col("s")), F.col("__stratum") == F.col("h")], "left")
    at = (F.col("__rank") == F.col("cut_rank")) & (F.col("__key") == F.col("cut_key"))
    before = (F.col("__rank") < F.col("cut_rank")) | (F.col("__rank") == F.col("cut_rank")) & (F.col("__key") <= F.col("cut_key"))
    open_end = F.coalesce(at & (F.col("some") < F.col("equal")), F.lit(False))

    def with_copies(part: DataFrame, extra: Column) -> DataFrame:
        return part.withColumn("copies", F.col("__whole") + F.when(F.col("__size") > 0, F.coalesce(extra.cast("long"), F.lit(0))).otherwise(0)).select(*(F.col(f"`{c}`") for c in own), "source_size", "target", "copies")

    done = with_copies(out.where(~open_end), before)
    if not cuts.where("some < equal").limit(1).count():
        return done
    # rows equal in id and text of which some are taken: any of them
    number = F.row_number().over(Window.partitionBy("__source", "__stratum", "__key").orderBy(F.lit(1)))
    return done.unionByName(with_copies(out.where(open_end).withColumn("__i", number), F.col("__i") <= F.col("some")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, tilt: float = TILT, bins: int = BINS) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words) of every document.

    Null and empty texts have size 0 and take nothing; null sources are a source of their own, the
    last; ranks depend on id and text alone, so reruns agree, and of rows equal in both some may be taken once
    more than others; an empty table gives an empty result. Other columns are not read.
    """
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_sized(docs, id_col, text_col, source_col, seed))
    sized = stage_table(sized, "mix-documents")
    factors, cuts = _plan(sized, tilt, bins)
    return _taken(sized, factors, cuts, tilt, bins).select("doc_id", F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, tilt: float = TILT, bins: int = BINS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, all columns unchanged.

    Texts stay where they are read. Null and empty texts take nothing and so go; null sources are a source of their
    own; repeated rows are taken as often together as ``mix`` says; columns may have any names that don't begin with
    two underscores; an empty table gives an empty result.
    """
    columns = docs.columns
    extra = _sized(docs, id_col, text_col, source_col, seed)
    factors, cuts = _plan(stage_table(docs.select(*extra), "mix-documents"), tilt, bins)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), *extra)
    out = _taken(packed, factors, cuts, tilt, bins).where("copies > 0")
    out = out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__n"))
    return out.select(*(F.col("__row").getField(c).alias(c) for c in columns))
