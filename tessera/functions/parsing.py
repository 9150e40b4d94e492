"""Parsing model replies: records, JSON and QA blocks, tolerant of noise around them."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import vocabulary as V
from tessera.functions.text import clean_str, float_or, graph_name, split_markers, strip


def records(replies: DataFrame, text_col: str = "reply", key_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Entities and relations in delimited replies.

    Records are split at the record and completion marks; the attributes between the outer parentheses at
    the tuple delimiter. An entity has 4 attributes or more, a relation 5 or more, the first of which names
    the kind in quotes. Blank entity names are dropped. A relation's weight is its last attribute, or 1.
    """
    parts = replies.select(F.col(key_col).alias("chunk_id"), F.posexplode(split_markers(F.col(text_col), [V.RECORD_DELIMITER, V.COMPLETION])).alias("pos", "record"))
    inner = F.regexp_extract("record", r"\((.*)\)", 1)
    rows = parts.where(F.col("record").rlike(r"\((.*)\)")).select("chunk_id", "pos", split_markers(inner, [V.TUPLE_DELIMITER]).alias("a"))
    at = lambda i: F.try_element_at("a", F.lit(i))
    entities = rows.where((F.size("a") >= 4) & (at(1) == '"entity"')).select("chunk_id", "pos", graph_name(at(2)).alias("entity_name"), graph_name(at(3)).alias("entity_type"), clean_str(at(4)).alias("description")).where(strip(F.col("entity_name")) != "")
    relations = rows.where((F.size("a") >= 5) & (at(1) == '"relationship"')).select("chunk_id", "pos", graph_name(at(2)).alias("src"), graph_name(at(3)).alias("tgt"), clean_str(at(4)).alias("description"), float_or(at(-1)).alias("weight"))
    return entities, relations


def salvage(x: Column, kind: str, schema: str) -> Column:
    """The outermost JSON ``array`` or ``object`` in a text; null if it doesn't parse."""
    pattern = r"(?s)\[.*\]" if kind == "array" else r"(?s)\{.*\}"
    return F.from_json(F.nullif(F.regexp_extract(x, pattern, 0), F.lit("")), schema)


def unfence(x: Column) -> Column:
    """Without code fences."""
    return strip(F.regexp_replace(x, r"```(?:json)?", ""))


def judge_reply(x: Column) -> Column:
    """``score`` and ``reason`` of a judge's JSON; null unless 0 <= score <= 5."""
    got = salvage(unfence(x), "object", "score double, reason string")
    return F.when(got["score"].between(0, 5), got)


_PAIR = re.compile(r'"?([\w]+)"?\s*:\s*("(?:[^"\\]|\\.)*"|[^,{}\[\]]+)')


def first_json(text: str | None) -> str | None:
    """The first complete JSON object by its braces, as canonical JSON; else what key-value pairs give."""
    if text is None:
        return None
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                try:
                    return json.dumps(json.loads(text[start : i + 1].replace("\n", "")), ensure_ascii=False, sort_keys=True)
                except ValueError:
                    break
    pairs = {k: literal(v.strip()) for k, v in _PAIR.findall(text)}
    return json.dumps(pairs, ensure_ascii=False, sort_keys=True) if pairs else None


def literal(x: str):
    """null, true, false, integer, float or text."""
    bare = x.strip().strip('"')
    fixed = {"null": None, "true": True, "false": False}
    if x.lower() in fixed:
        return fixed[x.lower()]
    for kind in (int, float):
        try:
            return kind(x)
        except ValueError:
            pass
    return bare


@F.pandas_udf(StringType())
def first_json_of(texts):
    """Batches of ``first_json``: a brace stack has no form among the built-in functions."""
    return texts.map(first_json, na_action="ignore")


def literal_kind(x: Column) -> Column:
    """null, boolean, integer, float or string, as ``literal`` tells them."""
    low = F.lower(strip(x))
    return F.when(low == "null", "null").when(low.isin("true", "false"), "boolean").when(low.rlike(r"^[-+]?[0-9]+$"), "integer").when(low.try_cast("double").isNotNull(), "float").otherwise("string")


def qa_items(replies: DataFrame, text_col: str = "reply", key_col: str = "community_id") -> DataFrame:
    """``qa_id`` and the parts of each complete question block; id: md5 of the question."""
    block = replies.select(F.col(key_col).alias("community_id"), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)<qa>(.*?)</qa>"), F.lit(1))).alias("pos", "qa"))

    def tag(name: str) -> Column:
        return strip(F.regexp_extract("qa", f"(?s)<{name}>(.*?)</{name}>", 1))

    out = block.select(
        "community_id", "pos", F.coalesce(F.nullif(tag("type"), F.lit("")), F.lit("reasoning")).alias("type"), tag("question").alias("question"), tag("thought").alias("thought"), tag("answer").alias("answer"),
        F.nullif(tag("distractor"), F.lit("")).alias("distractor"), F.transform(F.regexp_extract_all("qa", F.lit(r"(?s)<triple>(.*?)</triple>"), F.lit(1)), strip).alias("evidence"),
    )
    return out.where("question <> '' and answer <> ''").select(F.md5("question").alias("qa_id"), "*")
