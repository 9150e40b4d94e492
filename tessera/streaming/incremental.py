"""Incremental runs: streams of files or rows through the same functions as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import doc_id
from tessera.sources.stores import TableStore


def stream_texts(spark: SparkSession, path: str, schema: str = "text string", fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def insert_stream(stream: DataFrame, insert: Callable[[DataFrame], object], checkpoint: str):
    """A query that feeds each micro-batch to ``insert``. An insert skips what is stored, so a batch that is run again
    after a failure adds nothing twice."""
    return stream.writeStream.foreachBatch(lambda rows, _: insert(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_new(rows: DataFrame, store: TableStore, work: Callable[[DataFrame], DataFrame], retry: Column | None = None) -> DataFrame:
    """Rows whose key isn't stored, or whose stored result is to be retried, through ``work``, and stored."""
    done = store.all() if retry is None else store.all().where(~F.coalesce(retry, F.lit(False)))
    fresh = rows.join(done.select(store.key), store.key, "left_anti")
    out = work(fresh)
    store.upsert(out)
    return store.all()


def new_documents(rows: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Documents by content hash that aren't known, each once."""
    keyed = rows.withColumn("key", doc_id(F.col(text))).dropDuplicates(["key"])
    return keyed.join(known.select("key"), "key", "left_anti")
