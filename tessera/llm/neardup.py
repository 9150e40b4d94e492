"""N-gram Jaccard join with parity sketches.

A document is its set of distinct word shingles. Shingles are XOR-hashed into a sketch of some parts:
each shingle flips bits of one part, so the number of parts in which two sketches differ, and the
Hamming distance of a parity bit sketch, are at most the size of the sets' symmetric difference. The
Jaccard threshold bounds that difference within a band of set sizes. With more parts than the bound
some parts must be equal (pigeonhole), so documents meet by equal parts in a join per size band. What
meets is filtered by the bit sketch's Hamming distance, which for large sets is that of a sketch as wide as the
set, and verified on the exact sets.

Copies with equal sets are one node. Links are first looked for between the members of a part's group
and a pivot of the group, then between those that this left in different components and the group's most central
member; last, across components only, between all others, each pair by the first of the keys that it shares. So
large groups of near copies aren't expanded to pairs, and no link that joins components is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import stage_table, unstage

SHINGLE = 4
PERCENT = 85
BITS = 1024  # of every set's sketch; larger sets have one of at least as many bits as shingles besides
#: Documents that a verification may look up by a broadcast of their ids (24 bytes each); more are joined by a shuffle of the texts.
BROADCAST = 1 << 20
PIVOTS = 4  # orders of nodes by which the pivots of keys are chosen
EARLIER = 8  # keys of a node, before a key, by which a pair is known to have met before
GROWTH = 1.5  # of a band's upper size over its lower size
_CHUNK = 1 << 20  # bytes of text that are hashed in one go
_MET = 1 << 20  # sets that a task remembers, so as not to give their keys again

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER]
_PLACES = [_RANDOM.integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _places(n: int) -> np.ndarray:
    """Random odd multipliers of a byte's place in its word."""
    while len(_PLACES[0]) < n:
        _PLACES[0] = np.concatenate([_PLACES[0], _mix(_PLACES[0] + np.uint64(len(_PLACES[0]))) | np.uint64(1)])
    return _PLACES[0]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of ``size`` words.

    Words are runs of bytes other than space and U+0009 to U+000D with A-Z lower-cased. With fewer words
    than ``size`` all of them are one shingle; without words there is none.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SEPARATORS[joined]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    lengths = stops - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    words = np.add.reduceat(_BYTE[joined[inside]] * _places(int(lengths.max()))[place], first)
    words = _mix(words + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    of = np.searchsorted(ends, starts, side="right")
    at = np.searchsorted(of, np.arange(len(texts) + 1))
    steps = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(size)]
    n = len(words) - size + 1
    grams = _mix(sum(words[k : k + n] * steps[k] for k in range(size))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for i in range(len(texts)):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(_mix(np.array([sum(int(w) * int(s) for w, s in zip(words[a:b], steps)) + b - a & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _bands(limit: int) -> list[int]:
    """The lower sizes of bands, up to the first above ``limit``."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def part_keys(hashes: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Keys of the sketch's parts by which linked documents meet.

    A document is in its size band's group, and in the one below if a document there could be linked to
    it. A group's sketches have as many parts as the group's largest difference, one more, and some to
    spare; at least one more than the spare parts of two linked sketches are equal. So parts with few
    shingles, which would meet by chance, are left out while they are no more than the spare ones: an
    equal part holds as many shingles in both, and one of those left in by both is equal.
    """
    n, out = len(hashes), []
    bands = _bands(n)
    own = len(bands) - 2
    groups = [own, own - 1] if own and n * percent <= 100 * (bands[own] - 1) else [own]
    mixed = _mix(hashes + np.uint64(0xA0761D6478BD642F)) if n else hashes
    for g in groups:
        top = max(bands[g] + 1, int(bands[g] * GROWTH)) - 1
        apart = most_apart(top, top * 100 // percent, percent)
        if not apart:
            continue  # only equal sets are linked
        spare = apart // 3 + 1
        parts = apart + 1 + spare
        # the hashes are sorted, so a part is a run of them
        part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(part, minlength=parts)
        few = np.cumsum(np.bincount(counts))  # parts with at most so many shingles
        least = int(np.searchsorted(few, spare, side="right"))
        begin = np.cumsum(counts) - counts
        kept = np.flatnonzero(counts >= least)
        xored = np.zeros(parts, np.uint64)
        filled = np.flatnonzero(counts)
        if len(filled):
            xored[filled] = np.bitwise_xor.reduceat(mixed, begin[filled])
        keys = _mix(xored[kept] ^ _mix(kept.astype(np.uint64) + np.uint64((g + 1) << 32)))
        out += keys.view(np.int64).tolist()
    return out


def parity_bits(hashes: np.ndarray, bits: int = BITS) -> list[int]:
    """A sketch of so many parity bits (a power of two), as signed 64-bit words. Halves that are XORed give the sketch of
    half as many bits."""
    odd = np.bincount((hashes >> np.uint64(3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_bits(hashes: np.ndarray) -> list[int] | None:
    """A sketch with at least a bit for each shingle; None where BITS are as many. In BITS bits, large sets that have nothing
    in common differ no more than linked ones may; in this they do."""
    return parity_bits(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > BITS else None


def _sig(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _node(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts (column 1) in runs of bounded size, each with the row that it begins at."""
    first, texts, weight = 0, [], 0
    for text in batch.column(1):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        texts.append(raw)
        weight += len(raw)
        if weight >= _CHUNK:
            yield first, texts
            first, texts, weight = first + len(texts), [], 0
    if texts:
        yield first, texts


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``version`` (a hash of the text: an id may come with several), ``n``, ``sig`` (null for an empty set),
    ``node``, and, for the first copy of a set that a task meets, ``keys``, ``bits`` and ``wide``."""
    kind = "doc_id long, version long, n long, sig binary, node long, keys array<long>, bits array<long>, wide array<long>"
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64()))])

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            for first, texts in _chunks(batch):
                rows = []
                for hashes in shingle_sets(texts, size):
                    if not len(hashes):
                        rows.append((0, None, None, None, None, None))
                        continue
                    sig = _sig(hashes)
                    node, fresh = _node(sig), sig not in met
                    if fresh and len(met) < _MET:
                        met.add(sig)
                    rows.append((len(hashes), sig, node, *((part_keys(hashes, percent), parity_bits(hashes), wide_bits(hashes)) if fresh else (None, None, None))))
                ids = [batch.column(i).slice(first, len(texts)) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[2:]))], schema=schema)

    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version")).mapInArrow(run, kind)


def _meet(keyed: DataFrame) -> DataFrame:
    """``key``, ``node``, ``pivot`` of all nodes whose part key another node has.

    Rows come in the order of keys, so a group of any size streams through its task; a pivot is the
    group's member with the least hash (of those in the group's first batch) under one of PIVOTS orders, so that the
    keys of a group of near copies have few pivots among them.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("pivot", pa.int64())])

    def run(batches):
        held = None  # the last group so far: key, pivot, the only node (None once there are more)
        for batch in batches:
            key, node = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            rank = _mix(node.astype(np.uint64) ^ _mix((key & (PIVOTS - 1)).astype(np.uint64) + np.uint64(1)))
            order = np.lexsort((node, rank, key))
            key, node = key[order], node[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[fresh], node[fresh]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            pivot = np.repeat(node[begin], size)
            many = np.repeat(size > 1, size)
            extra = []
            if held and held[0] == key[0]:
                pivot[: size[0]] = held[1]
                if held[2] is not None and (node[: size[0]] != held[2]).any():
                    extra = [(held[0], held[2], held[1])]
                    held = (*held[:2], None)
                many[: size[0]] = held[2] is None
                state = held
            else:
                state = None
            last = begin[-1]
            if state is None or len(begin) > 1:
                state = (int(key[last]), int(pivot[last]), int(node[last]) if size[-1] == 1 else None)
            held = state
            # a last group of one isn't told before the next batch
            out = [pa.array(np.concatenate([[x[i] for x in extra], c[many]]).astype(np.int64) if extra else c[many]) for i, c in enumerate((key, node, pivot))]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long, pivot long")


def _distance(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)))


def _near(a: str, b: str, percent: int) -> Column:
    """Set sizes and the bit sketches' distance allow a link. Columns n and bits with the suffixes."""
    low, high = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")
    both = F.col(f"n{a}") + F.col(f"n{b}")
    return (100 * low >= percent * high) & ((100 + percent) * _distance(f"bits{a}", f"bits{b}") <= (100 - percent) * both)


def _far_apart(x: Column, y: Column) -> Column:
    """The distance of two wide sketches, the wider one folded to the other's width. Linked sets are less than a power of
    two apart in size."""

    def folded(a: Column, width: Column) -> Column:
        half = F.zip_with(F.slice(a, 1, width), F.slice(a, width + 1, width), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > width, half).otherwise(a)

    width = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, width), folded(y, width), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)


def _still_near(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb) that wide sketches (``wide``: node, bits) allow to be linked; all pairs with a set that has none."""
    small = F.least("na", "nb") <= BITS
    for end in ("a", "b"):
        pairs = pairs.join(wide.select(F.col("node").alias(end), F.col("wide").alias(f"wide{end}")), end, "left")
    apart = (100 + percent) * _far_apart(F.col("widea"), F.col("wideb")) <= (100 - percent) * (F.col("na") + F.col("nb"))
    return pairs.where(small | apart).select("a", "b")


def _verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, size: int, repeated: bool) -> DataFrame:
    """Those of ``pairs`` (a, b) whose exact sets are linked. Only documents in pairs are hashed again; ``repeated``: rows
    of ``docs`` may be equal in id and text."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep", "version"), "node")
    wanted = stage_table(wanted, "wanted")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for first, texts in _chunks(batch):
                nodes = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([nodes, pa.array([x.view(np.int64) for x in shingle_sets(texts, size)], pa.list_(pa.int64()))], schema=schema)

    few = wanted.count() <= BROADCAST
    texts = docs.join(F.broadcast(wanted) if few else wanted, (docs["doc_id"] == wanted["rep"]) & (F.xxhash64(docs["text"]) == wanted["version"])).select("node", "text")
    sets = stage_table((texts.dropDuplicates(["node"]) if repeated else texts).mapInArrow(run, "node long, shingles array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = stage_table(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")
    unstage(wanted, sets)
    return links


def _open(live: DataFrame, found: DataFrame) -> DataFrame:
    """``key``, ``node``, ``component`` of the groups of keys whose members are in different components."""
    labelled = stage_table(live.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    out = stage_table(labelled.join(mixed, "key"), "open")
    unstage(labelled)
    return out


def _to_centres(open_rows: DataFrame) -> DataFrame:
    """``a``, ``b``: the nodes of a key's group with its most central one, where that is in another component.

    Central is what is in the groups of most keys: of near copies of one text those with the fewest changes, to which
    others have the shortest way.
    """
    rows = open_rows.join(open_rows.groupBy("node").agg(F.count(F.lit(1)).alias("keys")), "node")
    centres = rows.groupBy("key").agg(F.max(F.struct("keys", "node", "component")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.component").alias("its"))
    met = open_rows.join(centres, "key").where("component <> its")
    return met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _with_earlier(open_rows: DataFrame) -> DataFrame:
    """``open_rows`` and in ``earlier`` the EARLIER keys of the node before this one."""
    before = Window.partitionBy("node").orderBy("key").rowsBetween(-EARLIER, -1)
    return open_rows.withColumn("earlier", F.collect_list("key").over(before))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b`` and their sizes ``na``, ``nb``: nodes that share a key, are in different components and may be linked by
    their bit sketches. ``rows``: key, node, component, earlier, n, bits.

    Near copies share most of their keys. A pair is given at the first of them, and again only where none of the EARLIER
    keys before is shared.
    """

    def side(name: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"key{name}"), F.col("node").alias(name), *(F.col(c).alias(f"{c}{name}") for c in ("component", "earlier", "n", "bits")))

    met = (F.col("keya") == F.col("keyb")) & (F.col("a") < F.col("b")) & (F.col("componenta") != F.col("componentb"))
    return side("a").join(side("b"), met & _near("a", "b", percent) & ~F.arrays_overlap("earliera", "earlierb")).select("a", "b", "na", "nb")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found``, joined by further ``links``; both are unstaged."""
    pairs = links
    for end in ("a", "b"):  # what is joined already is one node now
        pairs = pairs.join(found.select(F.col("node").alias("__n"), "component"), F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("component", end)).drop("__n", "component")
    joined = stage_table(connected_components(pairs, "a", "b").withColumnsRenamed({"node": "__part", "component": "__whole"}), "joined-components")
    members = found.join(joined, F.col("component") == F.col("__part"), "left").select("node", F.coalesce("__whole", "component").alias("component"))
    # nodes that no link has touched before are their own part
    out = stage_table(members.unionByName(joined.join(found, F.col("__part") == F.col("node"), "left_anti").select(F.col("__part").alias("node"), F.col("__whole").alias("component"))), "components")
    unstage(found, links, joined)
    return out


def _classes(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame, bool]:
    """The sketches of all rows (doc_id, text); ``sig``, ``component`` (a node) and the set's first document (``rep``, ``version``)
    of all sets; and if any rows are equal in id and text."""
    sketched = stage_table(sketches(docs, percent=percent, size=size), "sketches")
    repeated = sketched.where("doc_id is not null").groupBy("doc_id", "version").count().where("count > 1").limit(1).count() > 0
    first = F.min(F.struct("doc_id", "version")).alias("first")
    nodes = sketched.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("node").alias("node"), first, F.min("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    nodes = stage_table(nodes.select("sig", "node", F.col("first.doc_id").alias("rep"), F.col("first.version").alias("version"), "n", "bits"), "nodes")
    keyed = sketched.where("doc_id is not null").select(F.explode("keys").alias("key"), "node")
    live = stage_table(_meet(keyed), "live")
    wide = stage_table(sketched.where("wide is not null and doc_id is not null").groupBy("node").agg(F.first("wide").alias("wide")), "wide")
    whole, sketched = sketched, stage_table(sketched.select("doc_id", "version", "n", "sig"), "rows")
    unstage(whole)
    traits = nodes.select("node", "n", "bits")

    def near(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(traits.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")), end)
        return pairs.where(_near("a", "b", percent)).select("a", "b", "na", "nb")

    stars = live.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    stars = stage_table(_still_near(near(stars), wide, percent), "star-pairs")
    links = _verify(stars, nodes, docs, percent, size, repeated)
    found = stage_table(connected_components(links, "a", "b"), "star-components")
    # what stars didn't join: members of a key's group that are in different components
    unstage(links)
    open_rows = _open(live, found)
    centred = stage_table(_still_near(near(_to_centres(open_rows)).join(stars, ["a", "b"], "left_anti"), wide, percent), "centre-pairs")
    if centred.limit(1).count():
        found = _joined(found, _verify(centred, nodes, docs, percent, size, repeated))
        unstage(open_rows)
        open_rows = _open(live, found)
    rows = stage_table(_with_earlier(open_rows).join(traits, "node"), "open-traits")
    across = _across(rows, percent).distinct().join(stars.unionByName(centred), ["a", "b"], "left_anti")
    across = stage_table(_still_near(across, wide, percent), "cross-pairs")
    unstage(live, open_rows, rows, stars, centred, wide)
    if across.limit(1).count():
        found = _joined(found, _verify(across, nodes, docs, percent, size, repeated))
    placed = stage_table(nodes.join(found, "node", "left").select("sig", "rep", "version", F.coalesce("component", "node").alias("component")), "placed")
    unstage(nodes, found, across)
    return sketched, placed, repeated


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def join_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    Two documents are linked when 100 * intersection >= percent * union of their sets of shingles of ``size`` words; a
    component is the smallest doc_id that links reach. Null, empty and blank texts have no shingles and are
    linked with nothing; a null doc_id stays null and so does its component; repeated rows give repeated
    results; an empty table gives an empty result; other columns are not read. Rows that share an id and differ in
    text are documents of their own, each with the links of its own text.
    """
    sketched, placed, _ = _classes(_source(docs, id_col, text_col), percent, size)
    # the smallest document of each component, then of each set
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = stage_table(placed.join(smallest, "component").select(F.col("sig").alias("__sig"), "component_id"), "classes")
    out = sketched.select("doc_id", "n", "sig").join(by_set, F.col("sig") == F.col("__sig"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each component, all columns unchanged.

    Of an id's texts in one component the one with the smallest hash stays; texts of an id in different components
    are different documents. Of rows equal in id and text one stays. Documents without shingles (null, empty and blank
    texts) are linked with nothing and stay; rows without an id stay as they are; an empty table stays empty; columns
    may have any names that don't begin with two underscores.
    """
    sketched, placed, repeated = _classes(_source(docs, id_col, text_col), percent, size)
    first = placed.groupBy("component").agg(F.min(F.struct("rep", "version")).alias("f")).select(F.col("f.rep").alias("__id"), F.col("f.version").alias("__version"))
    alone = sketched.where("sig is null and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
    kept = first.unionByName(alone.distinct())
    rows = docs.withColumns({"__doc": F.col(f"`{id_col}`").cast("long"), "__text": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})
    named = rows.join(kept, (F.col("__doc") == F.col("__id")) & (F.col("__text") == F.col("__version")), "left_semi")
    if repeated:
        named = named.dropDuplicates(["__doc", "__text"])
    return named.unionByName(rows.where(F.col(f"`{id_col}`").isNull())).drop("__doc", "__text")
