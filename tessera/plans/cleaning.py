"""Cleaning documents with a model: in chunks, merged again, verified and audited."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parsing import first_json_of
from tessera.functions.text import drop_repeated_paragraphs, prefix, strip
from tessera.operators import chunking
from tessera.session import stage_table

#: Characters of the original and of the cleaned text that a verification looks at.
SAMPLE = 3500


def clean_documents(docs: DataFrame, clean: Callable[[Column], Column], verify: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 3500, overlap: int = 150) -> DataFrame:
    """``doc_id``, ``text``, ``chunks``, ``failed`` (numbers of chunks), ``before_chars``, ``after_chars``, ``verification``.

    ``clean`` asks a model about one chunk; a chunk without a reply (null) stays as it is and counts as failed. The replies
    are joined in order and paragraphs that chunks share are left out. ``verify`` asks about samples of the original and of
    the result; the first JSON object of its reply is kept. Chunks and replies are written tables, so a model is asked once.
    Documents without text have an empty one and no chunks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    chunks = stage_table(chunking.paragraph_chunks(rows, size=size, overlap=overlap), "cleaning-chunks")
    replies = stage_table(chunks.select("doc_id", "chunk_order_index", "content", clean(F.col("content")).alias("reply")), "cleaning-replies")
    part = F.struct("chunk_order_index", F.coalesce(strip(F.col("reply")), "content").alias("text"), F.col("reply").isNull().alias("failed"))
    merged = replies.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    numbers = F.transform(F.filter("parts", lambda p: p["failed"]), lambda p: p["chunk_order_index"])
    merged = merged.select("doc_id", drop_repeated_paragraphs(joined, separator="\n\n").alias("cleaned"), F.size("parts").alias("chunks"), numbers.alias("failed"))
    out = rows.join(merged, "doc_id", "left").select("doc_id", F.col("text").alias("original"), F.coalesce("cleaned", F.lit("")).alias("text"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("failed", F.array().cast("array<int>")).alias("failed"))
    out = out.withColumns({"before_chars": F.coalesce(F.length("original"), F.lit(0)), "after_chars": F.length("text")})
    if verify is None:
        return out.drop("original").withColumn("verification", F.lit(None).cast("string"))
    said = stage_table(out.withColumn("said", verify(prefix(F.coalesce("original", F.lit("")), SAMPLE), prefix(F.col("text"), SAMPLE))), "cleaning-verified")
    return said.select("doc_id", "text", "chunks", "failed", "before_chars", "after_chars", first_json_of(F.col("said")).alias("verification"))
