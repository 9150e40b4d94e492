"""Token budgets: prefixes, bins, batches, proportional shares."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(rows: DataFrame, cost: Column, budget: int | Column, order: list[Column], group: list[str] | None = None, per_item: int = 1) -> DataFrame:
    """The longest prefix of each group whose costs, and ``per_item`` each, stay within the budget. Costs aren't
    negative, so the running sum never falls and a filter on it is a prefix."""
    w = Window.partitionBy(*(group or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return rows.withColumn("__used", F.sum(cost + per_item).over(w)).where((F.col("__used") <= limit) & (limit > 0)).drop("__used")


def pack_groups(items: Column, budget: int, per_item: int = 1) -> Column:
    """Ordered items (structs with ``id`` and ``tokens``) in consecutive groups, each the longest prefix within the
    budget, one item at least."""

    def step(acc: Column, x: Column) -> Column:
        cost = x["tokens"].cast("long") + per_item
        fits = (acc["used"] + cost <= budget) & (acc["used"] > 0)
        group = F.when((acc["group"] < 0) | ~fits, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.array_append(acc["out"], F.struct(x["id"].alias("id"), group.alias("group"))).alias("out"), group.alias("group"), F.when(fits, acc["used"] + cost).otherwise(cost).alias("used"))

    start = F.struct(F.array().cast("array<struct<id:string,group:int>>").alias("out"), F.lit(-1).alias("group"), F.lit(0).cast("long").alias("used"))
    return F.aggregate(items, start, step, lambda acc: acc["out"])


def pack_stream(rows: DataFrame, budget: int, per_item: int = 1) -> DataFrame:
    """``lang``, ``id``, ``group``: what ``pack_groups`` gives for all items of each ``lang`` (columns ``lang``, ``ord``,
    ``id``, ``tokens``) by ``ord``, then id. The items of a language stream through a task in order, so a language of any size is
    packed in constant memory; where a group begins depends on all before it."""

    def run(batches):
        fresh, key, group, used = True, None, 0, 0
        for batch in batches:
            langs, ids, tokens = (batch.column(c).to_pylist() for c in ("lang", "id", "tokens"))
            groups = []
            for lang, n in zip(langs, tokens):
                cost = n + per_item
                if fresh or lang != key:
                    fresh, key, group, used = False, lang, 0, cost
                elif 0 < used and used + cost <= budget:
                    used += cost
                else:
                    group, used = group + 1, cost
                groups.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.string()), pa.array(groups, pa.int32())], names=["lang", "id", "group"])

    return rows.repartition("lang").sortWithinPartitions("lang", "ord", "id").mapInArrow(run, "lang string, id string, group int")


def batches(rows: DataFrame, size: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows in order."""
    w = Window.partitionBy(*(group or [])).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def top_n(rows: DataFrame, n: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """The first n rows, of each group if there is one."""
    if not group:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def split_budget(budget: int | Column, nodes: Column, edges: Column) -> tuple[Column, Column]:
    """A budget shared between nodes and edges by their numbers."""
    total = F.nullif(nodes + edges, F.lit(0))
    whole = F.lit(budget) if isinstance(budget, int) else budget
    first = F.coalesce(F.floor(whole * nodes / total), F.lit(0)).cast("int")
    return first, whole - first
