"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample in Spark; the log-probability matrix (languages by
buckets) is broadcast. A batch of texts becomes one sparse matrix, texts by buckets in compressed rows,
which is multiplied by it one language at a time, so that no more than one number per n-gram is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_SLICE = 1 << 18  # characters that are looked at in one go
_HELD = 256  # languages that a task counts at once
_TABLE: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """For each code point its lower-case letter, or 32 if it is no letter. Built once in a process."""
    if not _TABLE:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(out)
    return _TABLE[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _parts(texts: list[str | None], longest: int) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Texts in parts of bounded size: strings, the text of each, and the characters at its start that only complete
    n-grams. Texts are set apart by a character that is no letter at either end."""
    strings, owner, lead, held = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), _SLICE):
            # a slice starts with what n-grams that end in it need of the one before
            first, last = max(0, at - longest + 1), min(len(text), at + _SLICE)
            edge = at < longest - 1  # the text's beginning is in reach
            strings.append(" " * edge + text[first:last] + " " * (last == len(text)))
            owner.append(i)
            lead.append(at - first + edge if at else 0)
            held += last - first
            if held >= _SLICE:
                yield strings, owner, lead
                strings, owner, lead, held = [], [], [], 0
    if strings:
        yield strings, owner, lead


def sparse_rows(texts: list[str | None], orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts by hash buckets of their character n-grams, as compressed sparse rows in bounded pieces: each row's text, where
    it starts, and the bucket of each of its n-grams (each counts 1). Rows aren't empty; a text may have several.

    Letters are folded to lower case. N-grams that begin and end with what isn't a letter say nothing and are left
    out; the edges of words count.
    """
    fold, longest = _folding(), max(orders)
    for strings, owner, lead in _parts(texts, longest):
        part = fold[_points("".join(strings))]
        lengths = np.array([len(x) for x in strings])
        stops = np.cumsum(lengths)
        row = np.repeat(np.arange(len(strings), dtype=np.int32), lengths)
        begin = np.repeat((stops - lengths + np.array(lead)).astype(np.int32), lengths)
        wide, letter, place = part.astype(np.uint64), part != 32, np.arange(len(part), dtype=np.int32)
        for n in orders:
            count = len(part) - n + 1
            if count <= 0:
                continue
            end = slice(n - 1, n - 1 + count)
            used = np.flatnonzero((letter[:count] | letter[end]) & (row[:count] == row[end]) & (place[end] >= begin[end]))
            if not len(used):
                continue
            h = np.full(len(used), n, np.uint64)
            for k in range(n):
                h = (h ^ wide[used + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            mine = row[used]
            starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            yield np.array(owner)[mine[starts]], starts, (h >> np.uint64(64 - bits)).astype(np.int64)


def buckets(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of one text."""
    for _, _, found in sparse_rows([text], orders, bits):
        yield found


@dataclass(frozen=True)
class NaiveBayes:
    """``log_p``: languages by buckets; ``prior``: log shares of the training rows."""

    languages: list[str]
    log_p: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int
    weight: int  # evidence counts as at most so many n-grams, for scores that aren't all 0 or 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Ties go to the language whose name sorts first."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        if self.languages:
            for owner, starts, found in sparse_rows(texts, self.orders, self.bits):
                np.add.at(n, owner, np.diff(np.append(starts, len(found))))
                for i in range(len(self.languages)):
                    np.add.at(total[:, i], owner, np.add.reduceat(self.log_p[i][found], starts))
        told = n > 0
        best, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        if told.any():
            sums, seen = total[told], n[told][:, None]
            best[told] = np.argmax(sums + self.prior, axis=1)
            tempered = sums * (np.minimum(seen, self.weight) / seen) + self.prior
            odds = np.exp(tempered - tempered.max(1, keepdims=True))
            scores[told] = odds[np.arange(len(odds)), best[told]] / odds.sum(1)
        return [self.languages[b] if t else UNDETERMINED for b, t in zip(best, told)], scores


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 20_000, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.5, weight: int = 100, seed: int = 7) -> NaiveBayes:
    """Fit on a sample of about ``max_rows`` labelled rows (the documented bound; all, if fewer).

    Rows without text or label are left out. The sample is by a hash of text and label, so that it does
    not depend on partitions; labels are sorted, so ties between languages go to the first. What
    reaches the driver is one vector of 2**bits counts for each language in the bounded sample; a task holds
    _HELD of them at most.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = labelled.where(F.col(f"`{lang_col}`").isNotNull()).count()
    if total > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) < math.ceil(max_rows / total * (1 << 20)))
    size = 1 << bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def given():
            out = pa.RecordBatch.from_pydict({"lang": [*sums], "docs": [docs[k] for k in sums], "counts": [v.tobytes() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("counts", pa.binary())]))
            sums.clear()
            docs.clear()
            return out

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                if len(sums) >= _HELD and lang not in sums:
                    yield given()
                acc = sums.setdefault(lang, np.zeros(size, np.int64))
                mine = [t.as_py() for t, x in zip(batch.column(0), langs) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(mine)
                for _, _, found in sparse_rows(mine, orders, bits):
                    acc += np.bincount(found, minlength=size)
        if sums:
            yield given()

    def add(t: pa.Table) -> pa.Table:
        acc = sum(np.frombuffer(x.as_py(), np.int64) for x in t["counts"])
        return pa.table({"lang": t["lang"][:1], "docs": [sum(t["docs"].to_pylist())], "counts": [acc.tobytes()]})

    kind = "lang string, docs long, counts binary"
    found = sorted(rows.mapInArrow(count, kind).groupBy("lang").applyInArrow(add, kind).collect())
    if not found:
        return NaiveBayes([], np.zeros((0, size)), np.zeros(0), orders, bits, weight)
    counts = np.array([np.frombuffer(x["counts"], np.int64) for x in found], np.float64)
    docs = np.array([x["docs"] for x in found], np.float64)
    log_p = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * size)
    return NaiveBayes([x["lang"] for x in found], log_p, np.log(docs / docs.sum()), orders, bits, weight)


def held_out(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3, is 1. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: NaiveBayes, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``. Null texts and texts without letters: ``und``, 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(texts):
        import pandas as pd

        names, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores}, columns=["lang_pred", "score"])

    with_result = docs.select(*(F.col(f"`{c}`") for c in keep), score(F.col(f"`{text_col}`").cast("string")).alias("__found"))
    return with_result.select(*(F.col(f"`{c}`") for c in keep), F.col("__found.lang_pred").alias("lang_pred"), F.col("__found.score").alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of each document, learned from the labelled documents that aren't held out.

    Null texts and texts without a letter are ``und`` with score 0; a tie goes to the language that sorts first;
    repeated rows give repeated results; an empty table gives an empty result; with no labelled row at all every document is ``und``; other
    columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))))
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more, all columns unchanged.

    Learned from the labels of ``docs`` itself. Null texts and texts without a letter can't be told and go;
    repeated rows stay or go together; without any label nothing can be told and nothing goes; an empty table stays
    empty; columns may have any names.
    """
    model = fit(docs, text_col, lang_col)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        names, scores = shared.value.predict(texts.tolist())
        return pd.Series([n != UNDETERMINED and p >= least for n, p in zip(names, scores)], dtype=bool)

    return docs.where(kept(F.col(f"`{text_col}`").cast("string")))
