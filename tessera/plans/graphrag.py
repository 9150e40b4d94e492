"""Graph-based retrieval: an index of documents, chunks, a graph and communities, and queries on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import doc_id, entity_vector_id
from tessera.functions.parsing import records, salvage
from tessera.functions.text import report_markdown, strip
from tessera.operators import chunking, community, dedup, graph, retrieval
from tessera.session import stage_table
from tessera.sources.stores import TableStore

REPORT = "title string, summary string, rating double, findings array<struct<summary string, explanation string>>"
#: What a query without any result answers.
NO_RESULT = "Sorry, I'm not able to provide an answer to that question."


@dataclass(frozen=True)
class QueryParam:
    mode: str = "global"
    only_need_context: bool = False
    level: int = 2
    top_k: int = 20
    naive_max_tokens: int = 12000
    local_unit_tokens: int = 4000
    local_edge_tokens: int = 4800
    local_report_tokens: int = 3200
    global_min_rating: float = 0.0
    global_max_communities: int = 512
    global_max_tokens: int = 16384


@dataclass
class GraphRAG:
    """``extract``, ``report`` and ``answer`` are column functions around a model (prompt to reply), ``embed`` one from text
    to array<float>. ``glean`` asks for what an extraction has missed (content and reply so far to a further reply), up
    to ``gleanings`` times, and ``more`` if it should be asked again (the same to "yes" or another word). Tables live under
    ``folder``, in stores that ``store`` makes from a session, a path, a schema and a key."""

    spark: SparkSession
    folder: str
    extract: Callable[[Column], Column]
    embed: Callable[[Column], Column] | None = None
    report: Callable[[Column], Column] | None = None
    answer: Callable[[Column], Column] | None = None
    chunk: Callable[[DataFrame], DataFrame] = chunking.token_chunks
    glean: Callable[[Column, Column], Column] | None = None
    more: Callable[[Column, Column], Column] | None = None
    gleanings: int = 1
    report_tokens: int = 12000
    store: Callable[[SparkSession, str, str, str], TableStore] = TableStore

    def _store(self, name: str, schema: str, key: str) -> TableStore:
        return self.store(self.spark, f"{self.folder}/{name}", schema, key)

    @property
    def docs(self) -> TableStore:
        return self._store("docs", "doc_id string, text string", "doc_id")

    @property
    def chunks(self) -> TableStore:
        return self._store("chunks", "chunk_id string, doc_id string, chunk_order_index int, tokens int, content string", "chunk_id")

    @property
    def mentions(self) -> TableStore:
        return self._store("mentions", "entity_name string, entity_type string, description string, source_id string, ord long", "entity_name")

    @property
    def relations(self) -> TableStore:
        return self._store("relations", "src string, tgt string, description string, weight double, source_id string, ord long", "src")

    @property
    def clusters(self) -> TableStore:
        return self._store("clusters", "node string, level int, cluster string", "node")

    @property
    def reports(self) -> TableStore:
        return self._store("reports", f"cluster string, level int, nodes array<string>, chunk_ids array<string>, occurrence double, report string, rating double", "cluster")

    @property
    def vectors(self) -> TableStore:
        return self._store("vectors", "id string, kind string, name string, text string, vector array<float>", "id")

    def _replies(self, chunks: DataFrame) -> DataFrame:
        """``chunk_id``, ``reply``: the extraction of each chunk and what gleaning adds to it. Each round is a written table, so
        that a model is asked once."""
        now = stage_table(chunks.select("chunk_id", "content", self.extract(F.col("content")).alias("reply"), F.lit("yes").alias("again")), "replies")
        for i in range(self.gleanings if self.glean else 0):
            going = now.where("again = 'yes'")
            added = stage_table(going.select("chunk_id", "content", F.concat("reply", self.glean(F.col("content"), F.col("reply"))).alias("reply")), "gleaned")
            last = i == self.gleanings - 1 or self.more is None
            word = F.lit("no") if last else F.lower(F.regexp_replace(strip(self.more(F.col("content"), F.col("reply"))), "^[\"']+|[\"']+$", ""))
            now = stage_table(now.where("again <> 'yes'").unionByName(added.withColumn("again", F.coalesce(word, F.lit("no")))), "replies")
            if last or not now.where("again = 'yes'").limit(1).count():
                break
        return now.select("chunk_id", "reply")

    def insert(self, texts: DataFrame) -> bool:
        """Index new documents (column ``text``); False if there are none.

        What is stored is skipped by content hash. Mentions and relations are kept by chunk and put in place of
        what an earlier try may have left of the same chunks; a chunk counts as stored after them and a document after all,
        so a run that is tried again gives the same graph. Only new rows are written, and only entities whose
        text is new are embedded; clusters and reports are made from the whole graph.
        """
        fresh = texts.select(doc_id(F.col("text")).alias("doc_id"), "text").where("text is not null").dropDuplicates(["doc_id"])
        fresh = stage_table(self.docs.missing(fresh).join(fresh, "doc_id"), "new-docs")
        if not fresh.limit(1).count():
            return False
        made = chunking.dedup_chunks(self.chunk(fresh)).drop("copies")
        made = stage_table(self.chunks.missing(made).join(made, "chunk_id"), "new-chunks")
        entities, relations = records(self._replies(made))
        mentions = entities.select("entity_name", "entity_type", "description", F.col("chunk_id").alias("source_id"), F.col("pos").cast("long").alias("ord"))
        links = relations.select("src", "tgt", "description", "weight", F.col("chunk_id").alias("source_id"), F.col("pos").cast("long").alias("ord"))
        self.mentions.put(stage_table(mentions, "mentions"), "source_id")
        self.relations.put(stage_table(links, "relations"), "source_id")
        self._embed(made)
        self.chunks.append(made.select(*self.chunks.all().columns))
        self._cluster()
        self.docs.append(fresh.select("doc_id", "text"))
        return True

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = dedup.merge_nodes(self.mentions.all())
        edges, nodes = dedup.merge_edges(self.relations.all(), nodes)
        return nodes, edges

    def _embed(self, chunks: DataFrame) -> None:
        if self.embed is None:
            return
        nodes, _ = self.graph()
        rows = nodes.select(entity_vector_id(F.col("entity_name")).alias("id"), F.lit("entity").alias("kind"), F.col("entity_name").alias("name"), F.concat("entity_name", F.lit(" "), F.col("description")).alias("text"))
        rows = rows.unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), F.col("chunk_id").alias("name"), F.col("content").alias("text")))
        fresh = stage_table(rows.join(self.vectors.all().select("id", "text"), ["id", "text"], "left_anti"), "new-texts")
        if fresh.limit(1).count():
            self.vectors.put(stage_table(fresh.select("id", "kind", "name", "text", self.embed(F.col("text")).alias("vector")), "new-vectors"), "id")

    def _cluster(self) -> None:
        nodes, edges = self.graph()
        edges = stage_table(edges, "graph-edges")
        self.clusters.replace(community.hierarchical_communities(edges.select("src", "tgt", "weight")) if edges.limit(1).count() else self.clusters.all())
        if self.report is None:
            return
        cited = nodes.select(F.col("entity_name").alias("node"), F.explode("source_ids").alias("chunk_id"))
        table = stage_table(community.assemble(self.clusters.all(), edges, cited), "communities")
        members = self.clusters.all().join(nodes.select(F.col("entity_name").alias("node"), F.col("entity_type").alias("type"), "description"), "node").join(graph.simple_degrees(edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        ranked = graph.edge_degrees(edges, graph.simple_degrees(edges))
        members, inside = stage_table(members, "members"), stage_table(table.select("level", "cluster", F.explode("edges").alias("e")).select("level", "cluster", F.col("e.a").alias("src"), F.col("e.b").alias("tgt")).join(ranked, ["src", "tgt"]), "inside")
        children = stage_table(community.sub_communities(self.clusters.all()).select("parent", "child"), "children")
        # the deepest level first, so that a community can be told by the reports of its parts
        done = None
        for level in sorted((r[0] for r in table.select("level").distinct().collect()), reverse=True):
            here, own = F.col("level") == level, table.where(F.col("level") == level)
            contexts = community.describe(members.where(here), inside.where(here), self.report_tokens, None if done is None else children.join(done.select(F.col("cluster").alias("child"), "report", "rating", "occurrence", F.col("nodes").alias("child_nodes"), F.col("edges").alias("child_edges")), "child"))
            told = contexts.select("cluster", salvage(self.report(F.col("context")), "object", REPORT).alias("r"))
            text = F.coalesce(report_markdown(F.col("r.title"), F.col("r.summary"), F.coalesce("r.findings", F.array().cast("array<struct<summary:string,explanation:string>>"))), F.lit(""))
            made = stage_table(own.join(told, "cluster", "left").select("cluster", "level", "nodes", "edges", "chunk_ids", "occurrence", text.alias("report"), F.col("r.rating").alias("rating")), f"reports-{level}")
            done = made if done is None else done.unionByName(made)
        if done is not None:
            self.reports.replace(done.drop("edges"))

    def _hits(self, vector: list[float], kind: str, k: int, threshold: float | None = 0.2) -> DataFrame:
        found = retrieval.vector_topk(self.vectors.all().where(F.col("kind") == kind), vector, k, threshold)
        return found.join(self.vectors.all().select("id", "name"), "id")

    def query(self, vector: list[float] | None, param: QueryParam = QueryParam()):
        """The context of a query (``local``: four tables; ``naive``, ``global``: one), or, with a model and without
        ``only_need_context``, its answer as a one-row table."""
        if param.mode == "naive":
            hits = self._hits(vector, "chunk", param.top_k).select(F.col("name").alias("id"), "score")
            got = retrieval.naive_context(hits, self.chunks.all(), param.naive_max_tokens)
            return got if param.only_need_context or self.answer is None else got.select(F.when(F.col("context") == "", NO_RESULT).otherwise(self.answer(F.col("context"))).alias("answer"))
        if param.mode == "local":
            nodes, edges = self.graph()
            cited = nodes.select(F.col("entity_name").alias("node"), F.explode("source_ids").alias("chunk_id"))
            ranked = self._hits(vector, "entity", param.top_k)
            from pyspark.sql import Window

            hits = ranked.select(F.col("name").alias("node"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("ord"))  # top_k rows
            sections = retrieval.local_context(hits, nodes.select(F.col("entity_name").alias("node"), F.col("entity_type").alias("type"), "description"), edges, cited, self.chunks.all(), self.clusters.all(), self.reports.all().select("cluster", "rating", "report"), param.level, param.local_report_tokens, param.local_unit_tokens, param.local_edge_tokens)
            if param.only_need_context or self.answer is None:
                return sections
            text = retrieval.render(sections["entities"], [F.col("ord")], [("node", True), ("type", True), ("description", True), ("rank", False)])
            return text.select(self.answer(F.col("section")).alias("answer"))
        table = self.reports.all().where(F.col("level") <= param.level)
        points = retrieval.global_points(table, self.answer, param.global_max_tokens, param.global_max_tokens, param.global_max_communities, param.global_min_rating)
        if param.only_need_context:
            return points
        joined = points.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("score", "description")), asc=False), lambda x: x["description"]), "\n").alias("c"))
        return joined.select(F.when(F.col("c") == "", NO_RESULT).otherwise(self.answer(F.col("c"))).alias("answer"))
