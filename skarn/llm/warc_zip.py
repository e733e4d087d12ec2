"""Web archives as ZIP packages: writing records, and reading them by byte range without extraction.

A package is a ZIP file with stored (uncompressed) members: `archive/data.warc.gz`, a WARC file whose records are gzip
members of their own, and `indexes/index.jsonl`, one line per record with its key and byte range in that member. One Spark
task writes one package as a stream.

The reader needs three ranges to find its way: the tail of the file with the end record (or the ZIP64 one it points to),
the central directory, and the local header of each member it wants. Then a record is one range read: its place in the
stored member plus the member's place in the package.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import scratch, stored, text_slices

LEAST = 1000  # bytes from which equal payloads are recorded once
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF

# Signatures and fixed parts of ZIP structures, without their variable ends.
LOCAL = "<4s5H3I2H"
CENTRAL = "<4s6H3I5H2I"
END = "<4s4H2IH"
END64 = "<4sQ2H2I4Q"
LOCATOR = "<4sIQI"


@dataclass
class Member:
    name: str
    size: int
    crc: int
    header: int  # place of its local header
    method: int = 0
    flags: int = 0


class ZipStream:
    """Writes stored members one after another; sizes are not known ahead and follow each member."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64
        self.open: Member | None = None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.open = Member(name, 0, 0, self.at)
        raw = name.encode()
        # bit 3: sizes follow the data; the ZIP64 field makes them 64-bit
        extra = struct.pack("<2H2Q", 1, 16, 0, 0)
        self._write(struct.pack(LOCAL, b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, BIG32, BIG32, len(raw), len(extra)) + raw + extra)

    def add(self, data: bytes) -> int:
        """Append to the open member; returns where the data begins in it."""
        place = self.open.size
        self.open.size, self.open.crc = place + len(data), zlib.crc32(data, self.open.crc)
        self._write(data)
        return place

    def end(self) -> None:
        own = self.open
        self._write(struct.pack("<4sI2Q", b"PK\x07\x08", own.crc, own.size, own.size))
        self.members.append(own)
        self.open = None

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, wide = m.name.encode(), self.force64 or m.size >= BIG32 or m.header >= BIG32
            extra = struct.pack("<2H3Q", 1, 24, m.size, m.size, m.header) if wide else b""
            size, header = (BIG32, BIG32) if wide else (m.size, m.header)
            self._write(
                struct.pack(CENTRAL, b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, header)
                + raw + extra
            )
        length, n = self.at - start, len(self.members)
        wide = self.force64 or self.at >= BIG32 or n >= BIG16
        if wide:
            place = self.at
            self._write(struct.pack(END64, b"PK\x06\x06", struct.calcsize(END64) - 12, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack(LOCATOR, b"PK\x06\x07", 0, place, 1))
            n, length, start = BIG16, BIG32, BIG32
        self._write(struct.pack(END, b"PK\x05\x06", 0, 0, n, n, length, start, 0))


class ArchiveError(ValueError):
    pass


def _range(file, at: int, size: int) -> bytes:
    data = file.read_at(size, at) if hasattr(file, "read_at") else (file.seek(at), file.read(size))[1]
    if len(data) != size:
        raise ArchiveError(f"cut off: {len(data)} of {size} bytes at {at}")
    return data


def directory(file, length: int) -> dict[str, Member]:
    """Members of a ZIP file by name, from its central directory, ZIP64 or not. Only the tail and directory are read."""
    fixed, locator = struct.calcsize(END), struct.calcsize(LOCATOR)
    tail_at = max(0, length - fixed - 65535 - locator)
    tail = _range(file, tail_at, length - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (len(tail) - k < fixed or k + fixed + struct.unpack_from(END, tail, k)[7] != len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)  # a signature inside the comment
    if k < 0:
        raise ArchiveError("no end of central directory")
    _, _, _, _, count, size, start, _ = struct.unpack_from(END, tail, k)
    if BIG16 == count or BIG32 in (size, start):
        if k < locator or tail[k - locator : k - locator + 4] != b"PK\x06\x07":
            raise ArchiveError("no ZIP64 locator")
        place = struct.unpack_from(LOCATOR, tail, k - locator)[2]
        head = struct.unpack(END64, _range(file, place, struct.calcsize(END64)))
        if head[0] != b"PK\x06\x06":
            raise ArchiveError("no ZIP64 end of central directory")
        count, size, start = head[7], head[8], head[9]
    central, at, members = _range(file, start, size), 0, {}
    for _ in range(count):
        if central[at : at + 4] != b"PK\x01\x02":
            raise ArchiveError(f"no directory entry at {start + at}")
        f = struct.unpack_from(CENTRAL, central, at)
        flags, method, crc, packed, size, n_name, n_extra, n_comment, header = f[3], f[4], f[7], f[8], f[9], f[10], f[11], f[12], f[16]
        at += struct.calcsize(CENTRAL)
        name = central[at : at + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = central[at + n_name : at + n_name + n_extra], at + n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = [x[0] for x in struct.iter_unpack("<Q", extra[4 : 4 + n // 8 * 8])]
                size = wide.pop(0) if size == BIG32 else size
                packed = wide.pop(0) if packed == BIG32 else packed
                header = wide.pop(0) if header == BIG32 else header
            extra = extra[4 + n :]
        members[name] = Member(name, size, crc, header, method, flags)
    return members


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has names and extra fields of its own length."""
    if member.method != 0 or member.flags & 1:
        raise ArchiveError(f"{member.name} is not stored as it is")
    size = struct.calcsize(LOCAL)
    head = struct.unpack(LOCAL, _range(file, member.header, size))
    if head[0] != b"PK\x03\x04":
        raise ArchiveError(f"no local header of {member.name}")
    return member.header + size + head[9] + head[10]


def record(kind: str, page: int | None, url: str | None, digest: str, refers: int | None, payload: bytes) -> bytes:
    """One WARC record as a gzip member; a revisit has no payload. The same input gives the same bytes."""
    name = lambda k: f"<urn:page:{'none' if k is None else k}>"
    heads = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(page)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers is not None:
        heads += [("WARC-Refers-To", name(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    heads += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return gzip.compress(text.encode() + payload + b"\r\n\r\n", 4, mtime=0)


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of a record's range."""
    data = gzip.decompress(raw)
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    heads = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(heads["content-length"])
    if len(rest) != size + 4:
        raise ArchiveError(f"a record of {len(rest)} bytes, {size} announced")
    return heads, rest[:size]


def _open(path: str, name: str, mode: str):
    from pyarrow.fs import FileSystem

    system, place = FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(place, recursive=True)
        return system.open_output_stream(f"{place}/{name}", compression=None)
    return system.open_input_file(f"{place}/{name}")


PACKAGES = "name string, length long, records long"


def write_packages(pages: DataFrame, path: str, least: int = LEAST) -> DataFrame:
    """Write (page_id, url, html) as packages under `path`; returns the stored list (name, length, records).

    Of pages with equal payloads of at least `least` bytes the one with the largest page_id is the response and the others
    revisit it; where that id repeats, its row with the smallest url and row number of its own kind is the response. All
    other pages are responses. A null html is an empty payload, a null url an empty one; a page without id is a response
    and is never referred to.
    """
    sized = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = sized.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
    # one row per text that occurs under several ids: others need no partner
    several = (
        keyed.where(f"n >= {least} and page_id is not null")
        .groupBy("digest")
        .agg(F.count("*").alias("c"), F.max("page_id").alias("response"))
        .where("c > 1")
        .select("digest", "response")
    )
    several = stored(several, "several")
    # only ids and digests travel to find the pages concerned, not their texts
    revisits = (
        keyed.where(f"n >= {least}").select("page_id", "digest").join(several, "digest").where("page_id <> response").select("page_id", "digest", "response").distinct()
    )
    marked = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, lines = TaskContext.get(), None, []
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.zip"
        for batch in batches:
            for rows in text_slices(batch, "payload", 8 << 20):
                for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    if out is None:
                        sink = _open(path, name, "wb")
                        out = ZipStream(sink)
                        out.begin(DATA)
                    raw = record("response" if refers is None else "revisit", page, url, digest, refers, b"" if refers is not None else payload)
                    place = out.add(raw)
                    lines.append((place, len(raw), page))
        if out is not None:
            out.end()
            out.begin(INDEX)
            for k in range(0, len(lines), 1000):
                out.add(b"".join(json.dumps({"offset": a, "length": n, "page": p}).encode() + b"\n" for a, n, p in lines[k : k + 1000]))
            out.end()
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "length": pa.array([out.at], pa.int64()), "records": pa.array([len(lines)], pa.int64())})

    return stored(marked.mapInArrow(write, PACKAGES), "packages")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, path: str) -> DataFrame:
    """One row per record of the listed packages: its headers, and size and SHA-1 of the payload that was read.

    A revisit gets size and digest from the response it refers to, in whichever package that is; its own digest header
    must agree.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def page(text: str | None) -> int | None:
            return None if text in (None, "<urn:page:none>") else int(text.removeprefix("<urn:page:").removesuffix(">"))

        for batch in batches:
            for name, length in zip(batch.column("name").to_pylist(), batch.column("length").to_pylist(), strict=True):
                with _open(path, name, "rb") as file:
                    members = directory(file, length)
                    index, data = members[INDEX], members[DATA]
                    lines = _range(file, data_start(file, index), index.size).splitlines()
                    start, out = data_start(file, data), []
                    for k, line in enumerate(lines):
                        at = json.loads(line)
                        heads, payload = read_record(_range(file, start + at["offset"], at["length"]))
                        digest = hashlib.sha1(payload).hexdigest()
                        named = heads["warc-payload-digest"].removeprefix("sha1:")
                        revisit = heads["warc-type"] == "revisit"
                        if not revisit and digest != named:
                            raise ArchiveError(f"payload of {heads['warc-record-id']} is damaged")
                        out.append(
                            (page(heads["warc-record-id"]), None if revisit else len(payload), named, heads["warc-type"], page(heads.get("warc-refers-to")))
                        )
                        if len(out) >= 5000 or k == len(lines) - 1:
                            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                            )
                            out = []

    spark = packages.sparkSession
    listed = packages.select("name", "length").collect()  # one row per package
    if not listed:
        return spark.createDataFrame([], RECORDS)
    each = spark.createDataFrame([tuple(r) for r in listed], "name string, length long").repartition(len(listed))
    records = stored(each.mapInArrow(read, RECORDS), "records")
    responses = (
        records.where("record_type = 'response'")
        .join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("payload_bytes").alias("full"))
    )
    return records.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages as packages in the shared folder and read every record back."""
    path = scratch(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, path, least), path)
