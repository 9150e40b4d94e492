"""Key-value, vector and graph stores as tables in a folder.

A store is a folder of written segments and of numbered manifests, each of which names the segments of one
version. A version is written whole before its manifest appears, by a rename that either happens or
doesn't; readers take the newest manifest, so they never see half a version, and a crash in between leaves
the version before. What neither of the last two manifests names is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, retrieval
from tessera.operators.alignment import hydrate, skip_existing

#: Segments of a version beyond which an append merges them into one.
MOST_SEGMENTS = 16


class TableStore:
    """Rows by key. ``schema`` includes the key."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, at = self._files(), self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self) -> list[int]:
        return [int(x) for x in self._names("manifests") if x.isdigit()]

    def _segments(self, version: int) -> list[str]:
        stream = self._files().open(self._at(f"manifests/{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode().split()
        finally:
            stream.close()

    def _current(self) -> list[str]:
        versions = self._versions()
        return self._segments(versions[-1]) if versions else []

    def _publish(self, segments: list[str]) -> None:
        """Make ``segments`` the current version, then delete what the last two don't name."""
        fs, versions = self._files(), self._versions()
        number = versions[-1] + 1 if versions else 0
        draft, final = self._at(f"manifests/.draft-{uuid.uuid4().hex}"), self._at(f"manifests/{number:012d}")
        out = fs.create(draft, False)
        out.write(bytearray("\n".join(segments).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"another writer has published version {number} of {self.path}")
        named = {x for v in versions[-1:] for x in self._segments(v)} | set(segments)
        for v in versions[:-1]:
            fs.delete(self._at(f"manifests/{v:012d}"), False)
        for x in self._names("segments"):
            if x not in named:
                fs.delete(self._at(f"segments/{x}"), True)

    def _write(self, rows: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/segments/{name}")
        return name

    def all(self) -> DataFrame:
        now = self._current()
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/segments/{x}" for x in now)) if now else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> None:
        """The store holds ``rows`` and nothing else."""
        self._publish([self._write(rows)])

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys aren't stored; what is stored isn't written again, but for a merge of many segments."""
        now = self._current()
        if len(now) >= MOST_SEGMENTS:
            self.replace(self.all().unionByName(rows))
        else:
            self._publish([*now, self._write(rows.select(*self.all().columns))])

    def keys(self) -> DataFrame:
        return self.all().select(self.key)

    def get(self, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """Rows of the ids (columns key and pos) in their order, nulls for the missing."""
        rows = self.all()
        return hydrate(ids, rows.select(self.key, *fields) if fields else rows, self.key)

    def missing(self, ids: DataFrame) -> DataFrame:
        """The ids that aren't stored."""
        return skip_existing(ids.select(self.key), self.all(), self.key)

    def upsert(self, rows: DataFrame) -> None:
        self.replace(graph.upsert(self.all(), rows, [self.key]).select(*self.all().columns))

    def put(self, rows: DataFrame, group: str) -> None:
        """Store ``rows`` in place of all that have one of their values of ``group``. Rows of new values are appended; only
        where a value is stored already (a run that is tried again) is the store written anew."""
        there = self.all().join(rows.select(group).distinct(), group, "left_semi")
        if there.limit(1).count():
            self.replace(self.all().join(rows.select(group).distinct(), group, "left_anti").unionByName(rows.select(*self.all().columns)))
        else:
            self.append(rows)

    def drop(self) -> None:
        self.replace(self.spark.createDataFrame([], self.schema))


class VectorStore(TableStore):
    """Vectors with metadata: exact cosine search, or by random projections."""

    def __init__(self, spark: SparkSession, path: str, meta: str = ""):
        super().__init__(spark, path, "id string, vector array<float>" + (f", {meta}" if meta else ""), "id")

    def query(self, vector: list[float], k: int = 20, threshold: float | None = 0.2) -> DataFrame:
        found = retrieval.vector_topk(self.all(), vector, k, threshold)
        return found.join(self.all().drop("vector"), "id").orderBy(F.desc("score"), "id")

    def query_approximate(self, vector: list[float], k: int = 20) -> DataFrame:
        return retrieval.lsh_topk(self.all(), vector, k)


class GraphStore:
    """Nodes and undirected edges."""

    def __init__(self, spark: SparkSession, path: str, node_fields: str = "type string, description string", edge_fields: str = "weight double, description string"):
        self.nodes = TableStore(spark, f"{path}/nodes", f"node string, {node_fields}", "node")
        self.edges = TableStore(spark, f"{path}/edges", f"src string, tgt string, {edge_fields}", "src")

    def has_nodes(self, ids: DataFrame) -> DataFrame:
        return ids.join(self.nodes.keys(), "node", "left_semi")

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        flat = pairs.withColumn("a", F.least("src", "tgt")).withColumn("b", F.greatest("src", "tgt"))
        known = self.edges.all().select(F.col("src").alias("a"), F.col("tgt").alias("b"))
        return flat.join(known, ["a", "b"], "left_semi").select("src", "tgt")

    def degrees(self, ids: DataFrame) -> DataFrame:
        """0 for nodes without edges."""
        return ids.join(graph.simple_degrees(self.edges.all()), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def node_edges(self, ids: DataFrame) -> DataFrame:
        return graph.node_edges(ids, self.edges.all())

    def upsert_nodes(self, rows: DataFrame) -> None:
        self.nodes.upsert(rows)

    def upsert_edges(self, rows: DataFrame) -> None:
        ordered = rows.withColumn("__a", F.least("src", "tgt")).withColumn("tgt", F.greatest("src", "tgt")).withColumn("src", F.col("__a")).drop("__a")
        self.edges.replace(graph.upsert(self.edges.all(), ordered, ["src", "tgt"]).select(*self.edges.all().columns))
