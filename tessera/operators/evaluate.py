"""Evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("double"))


def score_validation(scores: DataFrame, col: str = "score") -> DataFrame:
    """Scores clamped to 1..5: number, mean (2 decimals), shares at 4 and 3 or more (percent, 1 decimal)."""
    s = F.greatest(F.least(F.col(col), F.lit(5)), F.lit(1))
    return scores.where(F.col(col).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 2).alias("mean"), F.round(100 * share(s >= 4), 1).alias("pct_4"), F.round(100 * share(s >= 3), 1).alias("pct_3"))


def score_histogram(scores: DataFrame, col: str = "score", low: int = 0, high: int = 5) -> DataFrame:
    """Counts of the whole scores; others count in the mean alone."""
    return scores.where((F.col(col) == F.floor(col)) & F.col(col).between(low, high)).groupBy(F.col(col).cast("int").alias("score")).agg(F.count(F.lit(1)).alias("n"))


def judge_stats(results: DataFrame, col: str = "score") -> DataFrame:
    """All, evaluated and failed rows; mean, largest, smallest; rates of 5 and of 4 to 5 over the evaluated."""
    s = F.col(col)
    return results.agg(F.count(F.lit(1)).alias("total"), F.count(s).alias("evaluated"), F.count_if(s.isNull()).alias("failed"), F.round(F.avg(s), 4).alias("mean"), F.max(s).alias("max_score"), F.min(s).alias("min_score"), F.round(F.count_if(s == 5) / F.nullif(F.count(s), F.lit(0)), 4).alias("rate_5"), F.round(F.count_if(s >= 4) / F.nullif(F.count(s), F.lit(0)), 4).alias("rate_4_5"))


def set_metrics(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Adds exact match, precision, recall and F1 of two arrays as sets. Both empty: 1; one empty: 0."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g)).cast("double")
    both, one = (F.size(p) == 0) & (F.size(g) == 0), (F.size(p) == 0) | (F.size(g) == 0)
    precision = F.when(both, 1.0).when(one, 0.0).otherwise(hit / F.size(p))
    recall = F.when(both, 1.0).when(one, 0.0).otherwise(hit / F.size(g))
    out = rows.withColumn("em", (both | (~one & (hit == F.size(p)) & (hit == F.size(g)))).cast("double")).withColumn("precision", precision).withColumn("recall", recall)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro_metrics(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("em", "precision", "recall", "f1")))


def judge_means(results: DataFrame) -> DataFrame:
    """Mean diagnosis score; the overall scores' sum over the number of diagnosis scores."""
    n = F.nullif(F.count("diagnosis_score"), F.lit(0))
    return results.agg(F.round(F.sum("diagnosis_score") / n, 6).alias("diagnosis_mean"), F.round(F.sum("overall_score") / n, 6).alias("overall_mean"))


def choice_accuracy(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy in percent over all rows: a missing verdict counts as wrong. ``partial``: wrong multiple choices with
    some right letter and no wrong one (columns verdict, multi, answer, gold)."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    some = (F.size(F.array_intersect(letters("answer"), letters("gold"))) > 0) & (F.size(F.array_except(letters("answer"), letters("gold"))) == 0)
    part = (F.col("verdict") == F.lit(False)) & F.col("multi") & F.coalesce(some, F.lit(False))
    return results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if("verdict").alias("correct"), F.count_if(part).alias("partial"), F.round(100 * share(F.col("verdict")), 4).alias("accuracy"))


def entity_recall(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Adds the share of gold names that were predicted; 0 without gold."""
    g = F.array_distinct(gold)
    return rows.withColumn("entity_recall", F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(g, F.array_distinct(pred))) / F.size(g)))


def reduction(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Characters before and after cleaning, the reduction in percent, and texts that came back empty."""
    a, b = F.sum(F.length(before)), F.sum(F.length(F.coalesce(F.col(after), F.lit(""))))
    return rows.agg(a.cast("long").alias("before_chars"), b.cast("long").alias("after_chars"), F.round(100 * (1 - b / F.nullif(a, F.lit(0))), 4).alias("reduction_pct"), F.count_if(F.coalesce(F.col(after), F.lit("")) == "").alias("failed"))


def retention(rows: DataFrame, by: str, before: str = "before", after: str = "after", least: float = 0.7) -> DataFrame:
    """Of each category the share of characters that stayed, and if that is enough."""
    ratio = F.sum(F.length(F.coalesce(F.col(after), F.lit("")))) / F.nullif(F.sum(F.length(before)), F.lit(0))
    return rows.groupBy(by).agg(F.round(ratio, 6).alias("ratio")).withColumn("ok", F.col("ratio") >= least)


def group_advantage(rows: DataFrame, group: str, reward: str = "reward", eps: float = 1e-4) -> DataFrame:
    """Adds the reward less its group's mean over the group's deviation, as two aggregates and a join: no group has to
    be in one task."""
    stats = rows.groupBy(group).agg(F.avg(reward).alias("__m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("__s"))
    return rows.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def metric_curve(metrics: DataFrame, window: int = 10) -> DataFrame:
    """Step, reward and its trailing mean."""
    w = Window.orderBy("step").rowsBetween(-(window - 1), 0)  # one row per logged step of a run
    return metrics.where("reward is not null").select("step", "reward", F.round(F.avg("reward").over(w), 6).alias("smoothed"))


def trainable(examples: DataFrame) -> DataFrame:
    """Examples with an entity and a relation."""
    return examples.where((F.size("entities") > 0) & (F.size("relationships") > 0))
