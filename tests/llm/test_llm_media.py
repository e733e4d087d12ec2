"""Matroska: exact round trips, all lacings, foreign layouts, damage."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import matroska as mkv
from skarn.llm._shared import ship


def payload_of(data, track=1):
    own = [p for p in mkv.parsed(data)[0] if p.track == track]
    return b"".join(data[p.start : p.start + p.size] for p in own)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(payload):
    data = mkv.muxed(payload)
    assert payload_of(data) == payload
    packets, cues = mkv.parsed(data)
    assert [p.timestamp for p in packets] == sorted(p.timestamp for p in packets)
    assert all(data[at : at + 4] == mkv.CLUSTER.to_bytes(4, "big") for _, _, at in cues)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from([mkv.XIPH, mkv.EBML_LACING]))
def test_every_lacing_gives_its_packets_back(packets, kind):
    cluster = mkv.element(mkv.CLUSTER, mkv.number(mkv.TIMESTAMP, 70) + mkv.element(mkv.SIMPLE_BLOCK, mkv.block(3, -5, packets, kind)))
    data = mkv.element(mkv.SEGMENT, cluster)
    found = mkv.parsed(data)[0]
    assert [data[p.start : p.start + p.size] for p in found] == packets
    assert {(p.track, p.timestamp) for p in found} == {(3, 65)} and [p.frame for p in found] == list(range(len(packets)))


def test_foreign_layout():
    """Unknown sizes, block groups, voids, two tracks, unlaced and equal-sized blocks."""
    unknown = b"\x01\xff\xff\xff\xff\xff\xff\xff"
    group = mkv.element(mkv.BLOCK_GROUP, mkv.element(mkv.BLOCK, mkv.block(2, 7, [b"group"])) + mkv.number(0x9B, 20))
    body = mkv.number(mkv.TIMESTAMP, 1000) + mkv.element(0xEC, b"\0" * 9) + mkv.element(mkv.SIMPLE_BLOCK, mkv.block(200, 0, [b"ab", b"cd"])) + group
    data = mkv.element(mkv.EBML, b"") + mkv.SEGMENT.to_bytes(4, "big") + unknown + mkv.CLUSTER.to_bytes(4, "big") + unknown + body
    found = [(p.track, p.timestamp, p.frame, data[p.start : p.start + p.size]) for p in mkv.parsed(data)[0]]
    assert found == [(200, 1000, 0, b"ab"), (200, 1000, 1, b"cd"), (2, 1007, 0, b"group")]


def test_damage_is_an_error():
    data = mkv.muxed(b"x" * 500)
    with pytest.raises(mkv.FormatError):
        mkv.parsed(data[:-3])
    with pytest.raises(mkv.FormatError):
        mkv.parsed(b"\0" + data)


def test_rows(spark):
    ship(spark)
    texts = [None, "", "é" * 32, "é" * 33, "long " * 50_000, "same", "same"]
    df = spark.createDataFrame([(k, t, "m") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    media = mkv.media_of(df)
    got = {r["doc_id"]: r for r in mkv.payload_digests(media).collect()}
    files = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"]) == (zlib.crc32(padded[-64:]), len(files[k]))
        assert r["media_sha256"] == hashlib.sha256(files[k]).hexdigest()
    assert files[5] == files[6] and got[5]["feature"] == got[6]["feature"]
    table = mkv.packets_of(media).where("doc_id = 4").orderBy("timestamp", "frame").collect()
    assert b"".join(files[4][p["start"] : p["start"] + p["size"]] for p in table).rstrip(b"\0") == texts[4].encode()
    assert mkv.payload_digests(mkv.media_of(df.limit(0))).collect() == []
    random.seed(0)


UNKNOWN = b"\x01" + b"\xff" * 7


def open_ended(ident, content):
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + UNKNOWN + content


def test_live_recordings_of_many_clusters_of_unknown_size():
    clusters = b"".join(open_ended(mkv.CLUSTER, mkv.number(mkv.TIMESTAMP, k) + mkv.element(mkv.SIMPLE_BLOCK, mkv.block(1, 0, [b"ab"]))) for k in range(5000))
    tail = mkv.element(mkv.CUES, mkv.element(mkv.CUE_POINT, mkv.number(mkv.CUE_TIME, 3) + 2 * mkv.element(mkv.CUE_PLACE, mkv.number(mkv.CUE_TRACK, 1) + mkv.number(mkv.CUE_CLUSTER, 7))))
    data = mkv.element(mkv.EBML, b"") + open_ended(mkv.SEGMENT, clusters + tail)
    packets, cues = mkv.parsed(data)
    assert [p.timestamp for p in packets] == list(range(5000)) and {data[p.start : p.start + p.size] for p in packets} == {b"ab"}
    assert len(cues) == 2 and cues[0] == cues[1]


def test_references_scales_and_frame_times():
    track = mkv.element(mkv.TRACK, mkv.number(mkv.TRACK_NUMBER, 1) + mkv.number(mkv.FRAME_TIME, 250))
    info = mkv.element(mkv.INFO, mkv.number(mkv.TIMESTAMP_SCALE, 1000))
    plain = mkv.element(mkv.BLOCK, mkv.block(1, 2, [b"a", b"b", b"c"]))
    groups = mkv.element(mkv.BLOCK_GROUP, plain) + mkv.element(mkv.BLOCK_GROUP, plain + mkv.number(mkv.REFERENCE, 1))
    body = info + mkv.element(mkv.TRACKS, track) + mkv.element(mkv.CLUSTER, mkv.number(mkv.TIMESTAMP, 10) + groups)
    packets, _ = mkv.parsed(mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, body))
    assert [p.key for p in packets] == [True] * 3 + [False] * 3
    assert [p.time for p in packets] == [12_000, 12_250, 12_500] * 2 and {p.timestamp for p in packets} == {12}


@pytest.mark.parametrize("block", [b"", b"\x81", b"\x81\0", b"\x81\0\0", b"\x81\0\0\x02", b"\x81\0\0\x02\x05\xff\xff", b"\x81\0\0\x06\x03\x40", b"\x81\0\0\x04\x02abcd"])
def test_damaged_blocks_are_format_errors(block):
    """Cut in the head, in the sizes of a lace, and a lace that does not divide; another block follows each."""
    body = mkv.element(mkv.SIMPLE_BLOCK, block) + mkv.element(mkv.SIMPLE_BLOCK, mkv.block(1, 0, [b"x" * 300]))
    with pytest.raises(mkv.FormatError):
        mkv.parsed(mkv.element(mkv.SEGMENT, mkv.element(mkv.CLUSTER, body)))


def test_null_and_empty_files_have_nulls(spark):
    ship(spark)
    empty = mkv.element(mkv.EBML, b"") + mkv.element(mkv.SEGMENT, b"")
    df = spark.createDataFrame([(1, 5, None), (2, 0, bytearray(empty))], mkv.MEDIA)
    rows = {r["doc_id"]: r for r in mkv.payload_digests(df).collect()}
    assert rows[1]["n_bytes"] == 5 and rows[1]["media_bytes"] is None and rows[1]["feature"] is None
    assert rows[2]["payload_bytes"] == 0 and rows[2]["feature"] is None and rows[2]["media_bytes"] == len(empty)
