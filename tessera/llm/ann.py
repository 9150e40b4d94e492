"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform) and falls to the nearest signed axis of each; its code in a table is the axes of a few
rotations, as many at any size of the table. A query probes the codes whose axes lie nearest to it and
reranks what it finds by exact cosine. In Spark, vectors and probes meet in a join by table and bucket (a
code without its last axis); buckets of many vectors, copies say, are split into parts and those of many
probes into blocks, so no group outgrows a task. The share of codes that a query probes falls with a
power of the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import stage_table

#: Vectors of a part and probes of a block, at most about.
PART, BLOCK = 8192, 16384
#: Tables; and the share of a table's codes that a query probes, SHARE * (vectors / 500) ** -FALL.
TABLES, SHARE, FALL = 4, 0.2, 0.25
#: Axes of a code.
AXES = 2
_ROWS = 256  # queries that are scored at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


class Rotation:
    """A pseudo-random rotation of vectors with ``dims`` components, padded to a power of two."""

    def __init__(self, dims: int, seed: int):
        self.n = 1 << max(0, (dims - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, self.n))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n))
        out[:, : x.shape[1]] = x
        for s in self.signs:
            out = hadamard(out * s)
        return out


def axis(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: i for +e_i, n + i for -e_i."""
    i = np.abs(turned).argmax(1)
    return np.where(turned[np.arange(len(turned)), i] >= 0, i, i + turned.shape[1])


def share_of(vectors: int) -> float:
    """The share of a table's codes that a query probes."""
    return min(1.0, SHARE * (max(vectors, 1) / 500) ** -FALL)


def rotations(dims: int, table: int, axes: int, seed: int) -> list[Rotation]:
    return [Rotation(dims, seed + 101 * table + k) for k in range(axes)]


def codes(unit: np.ndarray, turns: list[Rotation]) -> np.ndarray:
    """The code of each unit vector: its axes as the digits of a number."""
    out = np.zeros(len(unit), np.int64)
    for r in turns:
        out = out * (2 * r.n) + axis(r(unit))
    return out


def probes(unit: np.ndarray, turns: list[Rotation], share: float) -> list[np.ndarray]:
    """Of each unit vector the codes to look into: those with the largest sums of components along their axes.

    Axes are added one by one; a code among the best m begins with one of the best m beginnings, so no more are kept.
    """
    most = [1]
    for r in turns:
        most.append(most[-1] * 2 * r.n)
    m = max(1, math.ceil(share * most[-1]))
    signed = [np.concatenate([t, -t], 1) for t in (r(unit) for r in turns)]
    out = []
    for i in range(len(unit)):
        code, total = np.zeros(1, np.int64), np.zeros(1)
        for s in signed:
            total = (total[:, None] + s[i]).ravel()
            code = (code[:, None] * s.shape[1] + np.arange(s.shape[1])).ravel()
            if len(total) > m:
                best = np.argpartition(-total, m - 1)[:m]
                total, code = total[best], code[best]
        out.append(code)
    return out


def nearest(ids: np.ndarray, vectors: np.ndarray, last: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries (as rows), vectors and cosines of the k nearest to each query among the vectors whose last axis it allows. Ties
    go to the smaller id; rows that share an id are one vector, the nearest of them."""
    norms, query_norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    unit, found, single = vectors / norms[:, None], [], len(np.unique(ids)) == len(ids)
    for at in range(0, len(queries), _ROWS):
        mine = slice(at, at + _ROWS)
        mask = allowed[mine][:, last] & (query_ids[mine][:, None] != ids[None, :])
        rough = np.where(mask, (queries[mine] / query_norms[mine][:, None]) @ unit.T, -np.inf)
        if len(ids) > k and single:
            bound = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            mask &= rough >= bound[:, None] - 1e-9
        row, col = np.nonzero(mask)
        score = np.empty(len(row))
        for x in range(0, len(row), 1 << 15):  # one order of summation for all: equal vectors get equal scores
            part = slice(x, x + (1 << 15))
            score[part] = np.einsum("ij,ij->i", vectors[col[part]], queries[mine][row[part]]) / (norms[col[part]] * query_norms[mine][row[part]])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        if not single:
            first = np.sort(np.unique(np.stack([row, ids[col]], 1), axis=0, return_index=True)[1])
            row, col, score = row[first], col[first], score[first]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        found.append((row[keep] + at, ids[col[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def _distinct(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The first of rows that are equal in id and vector."""
    whole = np.concatenate([ids.astype("<i8").view(np.uint8).reshape(len(ids), 8), np.ascontiguousarray(rows).view(np.uint8).reshape(len(ids), -1)], 1)
    return np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_index=True)[1]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, part: int = PART, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found for each row where ``is_query``.

    Vectors that are null, zero, or hold null or non-finite components take no part; vectors of different
    lengths only meet their own kind. A query is no candidate of its own; rows that repeat an id are one
    vector, the nearest of them. A query that found fewer than k looks into all codes of a table, so it gets all there
    are. Copies are all indexed, and of those that tie the smaller ids win. Empty tables give an empty result; other
    columns are not read.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    item = pa.float32() if kind == "array<float>" else pa.float64()
    v = F.col(f"`{vector_col}`").cast(kind)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query")).where(_usable(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v")).agg(F.count(F.lit(1)), F.sum(F.col("is_query").cast("long"))).collect()  # one row for each length of vectors
    counts, queried = {n: c for n, c, _ in lengths}, sum(q or 0 for _, _, q in lengths)

    def by_length(batch: pa.RecordBatch):
        ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(column.offsets.to_numpy())
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            own = column.take(pa.array(at))
            raw = own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
            wide = raw.astype(np.float64)
            yield n, ids[at], raw, wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]

    def arrays(raw: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1) * raw.shape[1], pa.int32()), pa.array(np.ascontiguousarray(raw).ravel(), item))

    point_schema = pa.schema([("dims", pa.int32()), ("t", pa.int32()), ("bucket", pa.int64()), ("last", pa.int32()), ("vec_id", pa.int64()), ("v", pa.list_(item))])
    probe_schema = pa.schema([("dims", pa.int32()), ("t", pa.int32()), ("bucket", pa.int64()), ("axes", pa.binary()), ("vec_id", pa.int64()), ("v", pa.list_(item))])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, raw, unit in by_length(batch):
                for t in range(tables):
                    turns = rotations(n, t, AXES, seed)
                    code, width = codes(unit, turns), 2 * turns[-1].n
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), n), pa.int32()), pa.array(np.full(len(ids), t), pa.int32()), pa.array(code // width), pa.array(code % width, pa.int32()), pa.array(ids), arrays(raw)], schema=point_schema)

    def probing(everywhere: bool):
        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, ids, raw, unit in by_length(batch):
                    for t in range(1 if everywhere else tables):
                        turns = rotations(n, t, AXES, seed)
                        width = 2 * turns[-1].n
                        for at in range(0, len(ids), 64):
                            mine = slice(at, at + 64)
                            found = probes(unit[mine], turns, 1.0 if everywhere else share_of(counts[n]))
                            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                            code = np.concatenate(found)
                            place, which = np.unique(np.stack([row, code // width], 1), axis=0, return_inverse=True)
                            bits = np.zeros((len(place), width), np.uint8)
                            bits[which.ravel(), code % width] = 1
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), n), pa.int32()), pa.array(np.full(len(place), t), pa.int32()), pa.array(place[:, 1]), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()), pa.array(ids[mine][place[:, 0]]), arrays(raw[mine][place[:, 0]])], schema=probe_schema)

        return probed

    key = ["dims", "t", "bucket"]
    points = rows.select("vec_id", "v").mapInArrow(coded, f"dims int, t int, bucket long, last int, vec_id long, v {kind}")
    # a query takes milliseconds to probe and is small, so queries are dealt by number and not by bytes
    tasks = max(1, math.ceil(queried / 4096), min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(queried / 64)))
    queries = rows.where("is_query").select("vec_id", "v").dropDuplicates(["vec_id", "v"]).repartition(tasks)
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def visit(own: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(own) or not len(asked):
            return result.empty_table()
        ids, matrix = own["vec_id"].to_numpy(), _matrix(own["v"])
        first = _distinct(ids, matrix)
        width = 2 * Rotation(matrix.shape[1], 0).n
        last = own["last"].to_numpy()[first]
        allowed = np.unpackbits(np.frombuffer(b"".join(asked["axes"].to_pylist()), np.uint8).reshape(len(asked), -1), axis=1)[:, :width].astype(bool)
        query_ids = asked["vec_id"].to_numpy()
        row, found, score = nearest(ids[first], matrix[first], last, query_ids, _matrix(asked["v"]), allowed, k)
        return pa.Table.from_arrays([pa.array(query_ids[row]), pa.array(found), pa.array(score)], schema=result)

    def searched(who: DataFrame, everywhere: bool) -> DataFrame:
        visits = who.mapInArrow(probing(everywhere), f"dims int, t int, bucket long, axes binary, vec_id long, v {kind}")
        # parts and blocks of each bucket with vectors: one row per bucket. A query visits it once at most, so where
        # all queries are one block, its probes needn't be counted
        size = points.groupBy(*key).count().withColumnRenamed("count", "n")
        size = size.withColumn("m", F.lit(1)) if queried <= block else size.join(visits.groupBy(*key).count().withColumnRenamed("count", "m"), key)
        size = stage_table(size.select(*key, F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "buckets")
        side = lambda df: df.join(size, key)
        own = side(points).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        look = side(visits).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        by = [*key, "part", "block"]
        got = own.select(*by, "last", "vec_id", "v").groupBy(*by).cogroup(look.select(*by, "axes", "vec_id", "v").groupBy(*by)).applyInArrow(visit, "query_id long, vec_id long, score double")
        return got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    found = stage_table(ranked(searched(queries, False)), "nearest")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = stage_table(queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"), "short-of-neighbours")
    if short.limit(1).count():
        more = stage_table(ranked(searched(short, True)), "nearest-of-all")
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> float:
    """The share of the exact nearest k that ``found`` holds, for tables that fit into one process."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), is_query.alias("q")).where(_usable(F.col("v"))).toPandas()
    x = np.array(rows["v"].tolist())
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids = rows["i"].to_numpy()
    got = {(a, b) for a, b in found.select("query_id", "vec_id").collect()}
    hits = total = 0
    for i in np.flatnonzero(rows["q"].to_numpy()):
        score = x @ x[i]
        score[i] = -2
        best = np.lexsort((ids, -score))[:k]
        total += len(best)
        hits += sum((ids[i], ids[j]) in got for j in best)
    return hits / max(total, 1)
