"""Lexical retrieval packing: whole corpora cut into windows of related documents.

Documents are tokenised once. Lexically close documents are brought next to each other by a min-hash
order; runs of that order are shards of bounded size. Each shard has a BM25 inverted index with term
statistics of the whole corpus. A seed document asks it for unused neighbours, which fill the seed's
window greedily; the last one is cut where the window ends and its rest is the next seed, so that no
window but a partition's last has room left, and that one is dealt out to windows of a power of two.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stage_table

END_ID = 1  # closes each document
WINDOW = 2048
#: Tokens that a shard's index covers, and tokens that a partition holds.
SHARD_TOKENS, PARTITION_TOKENS = 1 << 20, 1 << 23
#: BM25's parameters.
K1, B = 1.2, 0.75
_UNIT = 2.0**-32
_DENSE = 2048  # documents of a shard up to which scores for common terms are held for all pairs

_ENCODERS: dict[str, tuple] = {}


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """Text to uint32 ids without special tokens. ``ranks_path``: the same vocabulary as ranks, which
    encodes several times faster; texts that hold a special token's string go to the tokenizer itself."""
    if json_path not in _ENCODERS:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(json_path)
        special = [x.content for x in own.get_added_tokens_decoder().values()]
        fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[json_path] = own, fast, special
    own, fast, special = _ENCODERS[json_path]

    def encode(text: str) -> np.ndarray:
        if fast is None or any(x in text for x in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode, own.get_vocab_size()


def _vocabulary(name: str) -> tuple[str, str | None, str | None]:
    import os

    import public_tokenizers as public

    ranks = public.path(f"{name}.tiktoken")
    return public.path(f"{name}.json"), (ranks if os.path.exists(ranks) else None), public.PATTERN


def _width(vocabulary_size: int) -> type:
    return np.uint16 if vocabulary_size <= 1 << 16 else np.uint32


_TOKENS = "kind int, doc_id long, n long, ids binary, near long, tie long"


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """Rows of kind 0: a document's ids (little-endian uint32 narrowed to uint16 where the vocabulary
    allows), their number and its place in the min-hash order; one row of kind 1 per task: the numbers of
    that task's documents which hold each id."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("near", pa.int64()), ("tie", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = _encoder(*_vocabulary(vocabulary))
        size, narrow = max(size, END_ID + 1), _width(size)
        df = np.zeros(size, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            weight = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                held = np.sort(ids.astype(narrow), kind="stable")  # a radix sort for half-width ids
                df[held[np.flatnonzero(np.diff(held, prepend=held[:1] + narrow(1)))]] += 1
                wide = ids.astype(np.uint64)
                pairs = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + wide[1:] * np.uint64(0xC2B2AE3D27D4EB4F) if len(ids) > 1 else wide
                pairs = (pairs ^ pairs >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
                raw = ids.astype(narrow).tobytes()
                # the minimum falls with length, so it is hashed once more: the order then says nothing of length
                near = int(pairs.min()) * 0x94D049BB133111EB % (1 << 64)
                near = (near ^ near >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
                rows.append((0, key, len(ids), raw, (near ^ near >> 32) >> 1, zlib.crc32(raw, (key or 0) & 0xFFFFFFFF)))
                weight += len(raw)
                if weight > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        yield pa.RecordBatch.from_pylist([{"kind": 1, "ids": df.tobytes()}], schema=schema)

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, _TOKENS)


class Shard:
    """A BM25 inverted index over some documents, with the corpus's idf."""

    def __init__(self, bags: list[np.ndarray], idf: np.ndarray, mean: float):
        lengths = np.array([len(x) for x in bags])
        # (document, term) codes in half the width where both allow it
        short = len(bags) <= 1 << 16 and bags[0].dtype == np.uint16
        kind, shift, mask = (np.uint32, 16, 0xFFFF) if short else (np.uint64, 32, 0xFFFFFFFF)
        codes = np.sort(np.repeat(np.arange(len(bags), dtype=kind), lengths) << kind(shift) | np.concatenate(bags).astype(kind))
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        tf = np.diff(np.append(starts, len(codes)))
        doc, self.term = (codes[starts] >> kind(shift)).astype(np.int64), (codes[starts] & kind(mask)).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / mean)
        # whole multiples of a small unit, so that sums are exact in any order
        self.weight = np.rint(idf[self.term] * tf * (K1 + 1) / (tf + norm[doc]) / _UNIT)
        self.doc_at = np.searchsorted(doc, np.arange(len(bags) + 1))
        order = np.argsort(self.term, kind="stable")
        self.postings, self.scores = doc[order], self.weight[order]
        terms = self.term[order]
        self.terms, first = np.unique(terms, return_index=True)
        self.first, self.stop = first, np.append(first[1:], len(terms))
        self.size = len(bags)
        # a term that only one document has tells of no other; those that many have are scored for all seeds at once
        count = self.stop - self.first
        self.listed, self.common = count > 1, None
        if self.size <= _DENSE:
            often = np.flatnonzero(count * 8 > self.size)
            self.listed[often] = False
            column = np.full(len(self.terms), -1)
            column[often] = np.arange(len(often))
            at = column[np.repeat(np.arange(len(self.terms)), count)]
            there = at >= 0
            weights = np.zeros((self.size, len(often)))
            weights[self.postings[there], at[there]] = self.scores[there]
            held = np.zeros((self.size, len(often)))
            held[self.postings[there], at[there]] = 1
            self.common = held @ weights.T

    def neighbours(self, seed: int) -> np.ndarray:
        """Each document's score for all of the seed's terms."""
        at = np.searchsorted(self.terms, self.term[self.doc_at[seed] : self.doc_at[seed + 1]])
        at = at[self.listed[at]]
        first, count = self.first[at], self.stop[at] - self.first[at]
        run = np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)
        scores = np.bincount(self.postings[run], weights=self.scores[run], minlength=self.size)
        return (scores if self.common is None else scores + self.common[seed]) * _UNIT


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of (document, start, length). All but the last are full."""
    shard = Shard(ids, idf, mean)
    unused = np.ones(len(ids), bool)
    left = len(ids)
    nxt = 0
    carried: tuple[int, int] | None = None  # a document's rest
    while carried or left:
        if carried:
            seed, at = carried
        else:
            while not unused[nxt]:
                nxt += 1
            seed, at = nxt, 0
            unused[seed] = False
            left -= 1
        carried = None
        room = window
        take = min(room, len(ids[seed]) - at)
        pieces = [(seed, at, take)]
        room -= take
        if take < len(ids[seed]) - at:
            carried = seed, at + take
        elif room and left:
            scores = np.where(unused, shard.neighbours(seed), -1.0)
            while room and left:
                best = int(np.argmax(scores))  # ties: the first in the shard's order
                scores[best] = -1.0
                unused[best] = False
                left -= 1
                take = min(room, len(ids[best]))
                pieces.append((best, 0, take))
                room -= take
                if take < len(ids[best]):
                    carried = best, take
        yield pieces


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone; null ids stay null; repeated rows are packed each;
    documents of any length are cut into pieces; an empty table gives an empty result. Sequence ids are
    a partition's number and a count, the same whenever a lost task runs again. Other columns are not
    read. ``window`` must be a power of two.
    """
    tokens = stage_table(tokenise(docs, id_col, text_col, vocabulary), "tokens")
    rows = tokens.where("kind = 0")
    number, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    narrow = _width(_encoder(*_vocabulary(vocabulary))[1])
    term_schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def add(batches):
        acc = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_py(), np.int64)
                acc = v.copy() if acc is None else acc + v
        if acc is not None:
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(acc[at], pa.int64())], schema=term_schema)

    # one row for each id of the vocabulary at most
    counts = tokens.where("kind = 1").select("ids").mapInArrow(add, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    idf = np.zeros(int(counts["term"].max()) + 1 if len(counts) else 1)
    idf[counts["term"].to_numpy(np.int64)] = np.log1p((number - counts["df"].to_numpy() + 0.5) / (counts["df"].to_numpy() + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((idf, total / max(number, 1)))
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        sequence = TaskContext.get().partitionId() << 32
        keys: list = []
        ids: list[np.ndarray] = []
        weight = 0
        tail: list[tuple] = []  # pieces of windows that aren't full: (key, ids, start, length)

        def row(key, own, start, length, sequence, offset):
            return key, start, length, zlib.crc32(own[start : start + length].astype("<u4").tobytes()), len(own), sequence, offset

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        def flush():
            nonlocal sequence
            rows = []
            for pieces in fill(ids, idf, mean, window):
                if sum(x[2] for x in pieces) < window:
                    tail.extend((keys[d], ids[d], a, n) for d, a, n in pieces)
                    continue
                offset = 0
                for d, a, n in pieces:
                    rows.append(row(keys[d], ids[d], a, n, sequence, offset))
                    offset += n
                sequence += 1
            return rows

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(raw.as_py(), narrow)
                keys.append(key)
                ids.append(own)
                weight += len(own)
                if weight >= SHARD_TOKENS:
                    if rows := flush():
                        yield batch_of(rows)
                    keys, ids, weight = [], [], 0
        rows = flush() if ids else []
        # what the shards left over: full windows, then windows of falling powers of two
        room = offset = 0
        left = sum(x[3] for x in tail)
        for key, own, a, n in tail:
            while n:
                if not room:
                    sequence += bool(offset)
                    room, offset = min(window, 1 << left.bit_length() - 1), 0
                take = min(n, room)
                rows.append(row(key, own, a, take, sequence, offset))
                a, n, room, offset, left = a + take, n - take, room - take, offset + take, left - take
        if rows:
            yield batch_of(rows)

    parts = max(1, math.ceil(total / PARTITION_TOKENS))
    parts = max(parts, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / SHARD_TOKENS)))
    dealt = rows.repartitionByRange(parts, "near", "tie", "doc_id").sortWithinPartitions("near", "tie", "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(run, _PIECES)
