import hashlib
import random
import zlib

import pytest

from tessera.llm import media


def payloads():
    rng = random.Random(4)
    return [b"", b"a" * 64, bytes(range(256)) * 3, *(rng.randbytes(n) for n in (1, 63, 64, 65, 511, 512, 513, 4096, 4097, 65_536, 70_001))]


@pytest.mark.parametrize("raw", payloads(), ids=len)
def test_round_trip(raw):
    data = media.mux(raw or bytes(64))
    back, parsed = media.read_back(data)
    assert back == (raw or bytes(64))
    assert len(parsed["clusters"]) == len(parsed["cues"])
    for (ms, track, at), cluster in zip(parsed["cues"], range(len(parsed["clusters"]))):
        assert data[at : at + 4] == b"\x1f\x43\xb6\x75" and track == 1
        assert min(p[2] for p in parsed["packets"] if p[0] == cluster) == ms
    assert [p[2] for p in parsed["packets"]] == [i * 64 for i in range(len(parsed["packets"]))]


@pytest.mark.parametrize("kind", ["none", "xiph", "fixed", "ebml"])
def test_lacing(kind):
    frames = [b"x" * 300] if kind == "none" else [b"a" * 7] * 4 if kind == "fixed" else [b"a" * 700, b"b" * 3, b"", b"c" * 255, b"d" * 20_000, b"e"]
    body = media.lace(frames, 3, -5, kind)
    track, ticks, key, ranges = media._unlace(body, 0, len(body))
    assert (track, ticks, key) == (3, -5, True)
    assert [body[a : a + n] for a, n in ranges] == frames


def test_unknown_sizes():
    block = media._element(media.SIMPLE_BLOCK, media.lace([b"one"], 1, 7))
    cluster = lambda t: media._id(media.CLUSTER) + b"\x01" + b"\xff" * 7 + media._uint(media.TIMESTAMP, t) + block
    data = media._element(media.EBML, media._element(media.DOC_TYPE, b"matroska")) + media._id(media.SEGMENT) + b"\xff" + cluster(0) + cluster(1000)
    assert [(p[0], p[2]) for p in media.demux(data)["packets"]] == [(0, 7), (1, 1007)]
    assert media.read_back(data)[0] == b"oneone"


def test_malformed_files_are_told():
    data = media.mux(b"x" * 640)
    with pytest.raises(ValueError):
        media.demux(data[:-30])
    with pytest.raises(ValueError):
        media.demux(b"\x00" + data)


def test_digests(spark):
    long = "ü" * 200_000
    rows = [(1, "", 0), (2, None, 1), (3, "ab", 2), (3, "ab", 2), (None, long, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").withColumnRenamed("n_bytes", "payload_sha256")
    got = media.media_digests(docs).collect()
    assert len(got) == 5
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    assert by[1, 0]["payload_bytes"] == by[2, 0]["payload_bytes"] == 64 and by[1, 0]["media_sha256"] == by[2, 0]["media_sha256"]
    for key, text in (((3, 2), "ab"), ((None, 400_000), long)):
        raw = text.encode()
        raw += bytes(-len(raw) % 64)
        r = by[key]
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:]) and r["payload_bytes"] == len(raw)
    assert media.media_digests(docs.limit(0)).count() == 0


def test_packet_table(spark):
    docs = spark.createDataFrame([(1, "x" * 5000), (2, None)], "doc_id long, text string")
    files = media.text_to_media(docs)
    got = media.packet_table(files).collect()
    sizes = {r["id"]: sum(p["size"] for p in got if p["id"] == r["id"]) for r in got}
    assert sizes == {1: 5056, 2: 64}
    stored = {r["id"]: r["media"] for r in files.collect()}
    assert all(stored[1][p["offset"] : p["offset"] + p["size"]].strip(b"\0").strip(b"x") == b"" for p in got if p["id"] == 1)


def test_keyframes_of_block_groups():
    body = bytearray(media.lace([b"one"], 1, 0))
    for flag in (0x80, 0):
        body[3] = flag
        plain = media._element(media.BLOCK_GROUP, media._element(media.BLOCK, bytes(body)))
        referring = media._element(media.BLOCK_GROUP, media._element(media.BLOCK, bytes(body)) + media._element(media.REFERENCE_BLOCK, b"\xff"))
        simple = media._element(media.SIMPLE_BLOCK, bytes(body))
        data = media._element(media.SEGMENT, media._element(media.CLUSTER, media._uint(media.TIMESTAMP, 0) + plain + referring + simple))
        assert [p[-1] for p in media.demux(data)["packets"]] == [True, False, bool(flag)]


def test_any_changed_byte_is_told_or_parsed():
    data, rng = media.mux(bytes(range(256)) * 40), random.Random(6)
    for i in [*range(min(400, len(data))), *rng.sample(range(len(data)), 400)]:
        for value in (0, 1, 255, data[i] ^ 0x10):
            try:
                media.demux(data[:i] + bytes([value]) + data[i + 1 :])
            except media.Malformed:
                pass
    for i in range(0, len(data), 97):
        try:
            media.demux(data[:i])
        except media.Malformed:
            pass
    with pytest.raises(media.Malformed):
        media.demux(media._id(media.SEGMENT) * 0 + b"".join([media._id(media.BLOCK_GROUP) + b"\x01" + (10**6).to_bytes(7, "big")] * 5000) + bytes(10**6))


def test_cues_are_where_reading_begins():
    data = media.mux(random.Random(1).randbytes(400_000))
    parsed = media.demux(data)
    assert len(parsed["cues"]) > 3
    for ticks in (0, 1, 8192, 20_000, parsed["packets"][-1][2], 10**9):
        assert [p[1:] for p in media.packets_from(data, parsed, ticks)] == [p[1:] for p in parsed["packets"] if p[2] >= ticks]
    blind = bytes(parsed["cues"][2][2])  # nothing before the cue's cluster is looked at
    assert [p[1:] for p in media.packets_from(blind + data[len(blind) :], parsed, parsed["cues"][2][0])] == [p[1:] for p in parsed["packets"] if p[2] >= parsed["cues"][2][0]]


def test_tables_tell_malformed_files(spark):
    good = media.mux(b"a" * 640)
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:-30])), (3, None), (None, bytearray(b"\x00rubbish")), (1, bytearray(good))], "id long, media binary").selectExpr("*", "1 track", "2 error")
    got = media.packet_table(files).collect()
    assert sorted((r["id"] or 0, r["error"] is not None) for r in got) == [(0, True), *[(1, False)] * 4, (2, True)]
    cues = media.cue_table(files).collect()
    assert sorted((r["id"] or 0, r["timestamp_ms"], r["error"] is None) for r in cues if r["id"] == 1) == [(1, 0.0, True)] * 2 and sum(r["error"] is not None for r in cues) == 2
    assert media.packet_table(files.limit(0)).count() == media.cue_table(files.limit(0)).count() == 0
