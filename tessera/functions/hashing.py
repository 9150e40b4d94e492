"""Content hashes and reproducible uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import strip


def doc_id(text: Column) -> Column:
    return F.concat(F.lit("doc-"), F.md5(strip(text)))


def chunk_id(text: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.md5(text))


def entity_vector_id(name: Column) -> Column:
    return F.concat(F.lit("ent-"), F.md5(name))


def export_id(name: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.md5(name), 1, 12))


def prompt_key(prompt: Column) -> Column:
    return F.md5(prompt)


def args_key(*args: Column) -> Column:
    """A key of several values: md5 of their canonical JSON."""
    return F.md5(F.to_json(F.struct(*(a.alias(f"a{i}") for i, a in enumerate(args)))))


def uniform(key: Column, seed: str = "") -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
