"""Matroska files as columns: writing sampled bytes, parsing files into packet tables, reading packets by byte range.

A file holds an EBML head and one segment with its information, one audio track of unsigned 8-bit samples at `RATE` a
second, clusters of simple blocks, and cues with the place of each cluster. A block holds up to `LACED` packets of one
track under one of the three lacings: of equal size, with sizes as runs of bytes, or with sizes as signed differences.

The parser reads any such file by its elements: identifiers and sizes of variable length, unknown sizes of segments and
clusters, blocks inside block groups, every lacing, several tracks and clusters; what it does not know it skips. It gives
one row per packet with track, timestamp, frame number, byte range and time in nanoseconds (timestamp by the scale of the
segment, later frames of a lace by the frame time of their track), so a payload is read by ranges of the stored bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skarn.llm._shared import text_slices, texts_of

RATE = 8000  # samples a second
PACKET = 480  # bytes of a packet: 60 milliseconds
LACED = 8  # packets of a block at most
BLOCKS = 8  # blocks of a cluster at most
ALIGN = 64  # payloads are padded to a multiple of this

# Element identifiers of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
RATE_ID, CHANNELS, DEPTH = 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE, FRAME_TIME = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x23E383
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size of variable length; all ones would mean an unknown size and is never written for a known one."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(content)) + content


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(packets: list[bytes], lacing: int) -> bytes:
    """The lacing part of a block: number of packets less one, sizes of all but the last, and the packets."""
    if lacing == NO_LACING:
        return packets[0]
    sizes = [len(p) for p in packets]
    head = bytes([len(packets) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(packets) > 1:
        head += size_bytes(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            step = now - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            head += size_bytes(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(packets)


def lacing_of(packets: list[bytes]) -> int:
    """None for one packet, equal sizes where they are equal, else differences, or runs where packets are short."""
    if len(packets) == 1:
        return NO_LACING
    if len({len(p) for p in packets}) == 1:
        return FIXED
    return XIPH if max(map(len, packets)) < 255 else EBML_LACING


def block(track: int, relative: int, packets: list[bytes], lacing: int | None = None) -> bytes:
    """A simple block of key frames; its timestamp counts from its cluster's."""
    kind = lacing_of(packets) if lacing is None else lacing
    return size_bytes(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + laced(packets, kind)


def muxed(payload: bytes) -> bytes:
    """A file with the payload as samples of one track; timestamps in milliseconds."""
    step = PACKET * 1000 // RATE
    packets = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXER, b"skarn") + element(WRITER, b"skarn"))
    audio = element(AUDIO, element(RATE_ID, np.array([RATE], ">f8").tobytes()) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(
        TRACKS,
        element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio),
    )
    clusters, cues, place = [], [], len(info) + len(tracks)
    for first in range(0, len(packets), LACED * BLOCKS):
        time, group = first * step, packets[first : first + LACED * BLOCKS]
        blocks = b"".join(
            element(SIMPLE_BLOCK, block(1, k * step, group[k : k + LACED])) for k in range(0, len(group), LACED)
        )
        clusters.append(element(CLUSTER, number(TIMESTAMP, time) + blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        place += len(clusters[-1])
    return head + element(SEGMENT, b"".join((info, tracks, *clusters, element(CUES, b"".join(cues)))))


@dataclass(slots=True)
class Packet:
    track: int
    timestamp: int
    frame: int  # place in its lace
    start: int
    size: int
    key: bool
    time: int = 0  # nanoseconds


class FormatError(ValueError):
    pass


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """(value, place after it) of a number of variable length; None for an unknown size."""
    if at >= len(data) or data[at] == 0:
        raise FormatError(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise FormatError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(identifier, first byte, end) of the content of each element between two places; an unknown size runs to the end."""
    while at < end:
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at, False)
        stop = end if size is None else at + size
        if stop > end:
            raise FormatError(f"element {ident:x} runs past its parent at byte {at}")
        yield ident, at, stop
        at = stop


def _lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(first byte, size) of each packet of a block."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise FormatError("a lace of equal sizes does not divide")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            before = at
            value, at = _vint(data, at, False)
            value = (1 << 7 * (at - before)) - 1 if value is None else value
            sizes.append(value if k == 0 else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise FormatError("a lace runs past its block")
    places = []
    for size in sizes:
        places.append((at, size))
        at += size
    return places


def _whole(data: bytes, span: tuple[int, int]) -> int:
    return int.from_bytes(data[slice(*span)], "big")


def parsed(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """(packets in file order, cues as (time, track, byte of the cluster)) of a file; FormatError if it is damaged.

    A packet of a block group is a key frame unless the group refers to another block. An element of unknown size ends
    where its parent does or where one begins that it cannot hold, so any number of such clusters may follow each other.
    """
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    segment, cluster, scale = 0, 0, 1_000_000
    frame_time: dict[int, int] = {}

    def frames(at: int, end: int, key: bool | None) -> None:
        track, at = _vint(data, at, False)
        if at + 3 > end or track is None:
            raise FormatError(f"a block ends at byte {end} before its head")
        time = cluster + int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        try:
            lace = _lace(data[:end], at + 3, end, flags >> 1 & 3) if flags >> 1 & 3 else [(at + 3, end - at - 3)]
        except IndexError as cause:
            raise FormatError(f"a lace runs past its block at byte {end}") from cause
        shown = bool(flags & 0x80) if key is None else key
        for k, (first, size) in enumerate(lace):
            packets.append(Packet(track, time, k, first, size, shown, time * scale + k * frame_time.get(track, 0)))

    def cue(first: int, stop: int) -> None:
        own = [(i, (a, b)) for i, a, b in elements(data, first, stop)]
        times = [_whole(data, span) for i, span in own if i == CUE_TIME]
        for place in (span for i, span in own if i == CUE_PLACE):
            held = {i: _whole(data, (a, b)) for i, a, b in elements(data, *place)}
            if not times or CUE_TRACK not in held or CUE_CLUSTER not in held:
                raise FormatError(f"a cue before byte {stop} lacks a time or place")
            cues.append((times[0], held[CUE_TRACK], segment + held[CUE_CLUSTER]))

    at, ends = 0, [len(data)]
    while True:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        if at >= len(data):
            return packets, cues
        ident, first = _vint(data, at, True)
        size, first = _vint(data, first, False)
        stop = ends[-1] if size is None else first + size
        if stop > ends[-1]:
            raise FormatError(f"element {ident:x} runs past its parent at byte {at}")
        at = stop
        if ident in (SEGMENT, CLUSTER, CUES, INFO, TRACKS):
            if ident == SEGMENT:
                segment, scale = first, 1_000_000
            elif ident == CLUSTER:
                cluster = 0
            if size is not None:
                ends.append(stop)
            at = first  # its elements come next
        elif ident == TIMESTAMP:
            cluster = _whole(data, (first, stop))
        elif ident == TIMESTAMP_SCALE:
            scale = _whole(data, (first, stop))
        elif ident == TRACK:
            own = {i: (a, b) for i, a, b in elements(data, first, stop)}
            if TRACK_NUMBER in own and FRAME_TIME in own:
                frame_time[_whole(data, own[TRACK_NUMBER])] = _whole(data, own[FRAME_TIME])
        elif ident == SIMPLE_BLOCK:
            frames(first, stop, None)
        elif ident == BLOCK_GROUP:
            group = list(elements(data, first, stop))
            for i, a, b in group:
                if i == BLOCK:
                    frames(a, b, all(j != REFERENCE for j, _, _ in group))
        elif ident == CUE_POINT:
            cue(first, stop)


def feature(samples: np.ndarray) -> str:
    """Least, greatest, sum and sum of squares of the samples, and how often they cross the middle."""
    wide = samples.astype(np.int64)
    above = wide >= 128
    crossed = int((above[1:] != above[:-1]).sum())
    return f"min={wide.min()};max={wide.max()};sum={wide.sum()};squares={(wide * wide).sum()};crossings={crossed}"


MEDIA = "doc_id long, n_bytes long, media binary"


def media_of(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a file.

    A null text is empty; equal texts give equal files. Rows that repeat are written each for itself; an empty table gives
    no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, text_column, 4 << 20):
                raw = [t.encode() for t in texts_of(rows, text_column)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(id_column).cast(pa.int64()),
                        pa.array([len(r) for r in raw], pa.int64()),
                        pa.array([muxed(r + b"\0" * (-len(r) % ALIGN or (0 if r else ALIGN))) for r in raw], pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "media"],
                )

    return df.select(id_column, text_column).mapInArrow(run, MEDIA)


PACKETS = "doc_id long, track long, timestamp long, frame long, start long, size long, key boolean, time long"


def packets_of(media: DataFrame) -> DataFrame:
    """The packet table of (doc_id, media): one row per packet with its byte range. A null file has no packets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "media", 4 << 20):
                out = [
                    (doc, p.track, p.timestamp, p.frame, p.start, p.size, p.key, p.time)
                    for doc, data in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "media")), strict=True)
                    if data is not None
                    for p in parsed(data)[0]
                ]
                columns = list(zip(*out, strict=True)) if out else [()] * 8
                kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "track", "timestamp", "frame", "start", "size", "key", "time"],
                )

    return media.select("doc_id", "media").mapInArrow(run, PACKETS)


DIGESTS = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def payload_digests(media: DataFrame, track: int = 1) -> DataFrame:
    """Read each file's payload by the byte ranges of one track's packets, and give digests and features of it.

    A null file gives nulls but for its doc_id and n_bytes; a payload without a sample has no feature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, "media", 4 << 20):
                out = []
                for doc, n, data in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    if data is None:
                        out.append((doc, n, *[None] * 6))
                        continue
                    own = sorted((p for p in parsed(data)[0] if p.track == track), key=lambda p: (p.timestamp, p.frame))
                    payload = b"".join(data[p.start : p.start + p.size] for p in own)
                    out.append(
                        (
                            doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data),
                            hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8)) if payload else None,
                        )
                    )
                kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [part.split()[0] for part in DIGESTS.split(", ")]
                columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGESTS)
