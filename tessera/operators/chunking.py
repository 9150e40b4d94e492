"""Splitting texts into chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.hashing import chunk_id
from tessera.functions.text import strip, tokens


def windows(token_array: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` tokens that start every ``size - overlap``; the last may be pure overlap. The tokens are a lambda's
    variable, so that they are split once and not for each window."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.slice(t, s + 1, F.lit(size)))

    return F.element_at(F.transform(F.array(token_array), cut), 1)


def token_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1200, overlap: int = 100, encode=tokens, joiner: str = " ") -> DataFrame:
    """``chunk_id``, ``doc_id``, ``chunk_order_index``, ``tokens``, ``content`` of fixed token windows. ``encode``: text column to array
    of strings."""
    # the outer form, as the plain one adds a filter that evaluates its argument once more
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(windows(encode(F.col(text_col)), size, overlap)).alias("chunk_order_index", "t")).where("t is not null")
    out = rows.select("doc_id", "chunk_order_index", F.size("t").alias("tokens"), strip(F.array_join("t", joiner)).alias("content"))
    return out.select(chunk_id(F.col("content")).alias("chunk_id"), "*")


def dedup_chunks(chunks: DataFrame) -> DataFrame:
    """Equal contents are one chunk, that of the last document."""
    last = chunks.groupBy("chunk_id").agg(F.max(F.struct("doc_id", "chunk_order_index", "tokens", "content")).alias("c"), F.count(F.lit(1)).alias("copies"))
    return last.select("chunk_id", "c.*", "copies")


def sentences(text: Column, marks: str = "。！？\n") -> Column:
    """Parts between sentence marks, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, f"[{marks}]"), strip), lambda s: s != "")


def _split_keep(text: str, separators: Sequence[str]) -> list[str]:
    """Pieces that end with a separator; of separators at one place the longest counts."""
    import re

    pattern = "|".join(re.escape(s) for s in sorted(separators, key=len, reverse=True))
    out, at = [], 0
    for m in re.finditer(pattern, text):
        out.append(text[at : m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return [x for x in out if x]


def _merge(pieces: list[list[str]], size: int, overlap: int) -> list[list[str]]:
    """Pieces gathered to chunks of at most ``size``. A lone oversize chunk is cut into windows; of several, each
    gets the end of the one before and is cut to the size, but the first stays as it is."""
    chunks: list[list[str]] = []
    now: list[str] = []
    for p in pieces:
        if now and len(now) + len(p) > size:
            chunks.append(now)
            now = []
        now = now + p
    if now:
        chunks.append(now)
    if len(chunks) == 1 and len(chunks[0]) > size:
        only, step = chunks[0], max(1, size - overlap)
        return [only[i : i + size] for i in range(0, len(only), step)]
    if len(chunks) > 1 and overlap:
        return [chunks[0], *((a[-overlap:] + b)[:size] for a, b in zip(chunks, chunks[1:]))]
    return chunks


def separator_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, overlap: int = 128, separators: Sequence[str] = V.SEPARATORS) -> DataFrame:
    """Chunks at separators, in code points as the offline tokens. Greedy gathering is a sequential fold, so
    it runs in Arrow batches."""
    wanted = tuple(separators)

    @F.pandas_udf("array<string>")
    def split(texts):
        import pandas as pd

        return pd.Series([["".join(c) for c in _merge([list(p) for p in _split_keep(t or "", wanted)], size, overlap)] for t in texts])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split(F.col(text_col))).alias("chunk_order_index", "content"))
    return rows.select(chunk_id(F.col("content")).alias("chunk_id"), "doc_id", "chunk_order_index", F.length("content").alias("tokens"), "content")


def _sentence_chunks(text: str, size: int, overlap: int) -> list[str]:
    import re

    out: list[str] = []
    now = ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n+", text))):
        if len(paragraph) > size:
            if now:
                out.append(now)
                now = ""
            for s in filter(None, re.split(r"(?<=[。！？.!?])", paragraph)):
                if len(s) > size:
                    if now:
                        out.append(now)
                        now = ""
                    out += [s[i : i + size] for i in range(0, len(s), size - overlap)]
                elif len(now) + len(s) > size:
                    out.append(now)
                    now = now[-overlap:] + s if len(s) + overlap <= size else s
                else:
                    now += s
            if now:
                out.append(now)
                now = ""
        elif now and len(now) + len(paragraph) + 1 > size:
            out.append(now)
            now = paragraph
        else:
            now = f"{now}\n{paragraph}" if now else paragraph
    return [*out, now] if now else out


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3500, overlap: int = 150) -> DataFrame:
    """Paragraphs packed to ``size`` characters; longer ones by sentence with overlap, and by length where a
    sentence is too long."""

    @F.pandas_udf("array<string>")
    def split(texts):
        import pandas as pd

        return pd.Series([_sentence_chunks(t or "", size, overlap) for t in texts])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split(F.col(text_col))).alias("chunk_order_index", "content"))
    return rows.select("doc_id", "chunk_order_index", F.length("content").alias("n_chars"), "content")
