"""ZIP packages: own and foreign files, ZIP64, damage; archives against plain grouping."""

import hashlib
import io
import zipfile

import pytest

from skarn.llm import warc_zip as wz
from skarn.llm._shared import ship


def package(members, force64):
    out = io.BytesIO()
    stream = wz.ZipStream(out, force64)
    for name, chunks in members.items():
        stream.begin(name)
        for c in chunks:
            stream.add(c)
        stream.end()
    stream.close()
    return out.getvalue()


@pytest.mark.parametrize("force64", [False, True])
def test_packages_are_zip_files(force64):
    members = {"a/b.bin": [b"one", b"two" * 1000], "é.txt": [b""], "c": [b"PK\x05\x06" * 7]}
    data = package(members, force64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b"".join(c) for n, c in members.items()}
    file, found = io.BytesIO(data), wz.directory(io.BytesIO(data), len(data))
    for name, chunks in members.items():
        m = found[name]
        assert wz._range(file, wz.data_start(file, m), m.size) == b"".join(chunks)


def test_foreign_zip_with_comment_and_extra_fields():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        info = zipfile.ZipInfo("stored")
        info.extra = b"\x99\x99\x04\x00abcd"
        z.writestr(info, b"payload")
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a signature inside the comment" * 3
    data = out.getvalue()
    file, found = io.BytesIO(data), wz.directory(io.BytesIO(data), len(data))
    assert wz._range(file, wz.data_start(file, found["stored"]), 7) == b"payload"
    with pytest.raises(wz.ArchiveError):
        wz.data_start(file, found["packed"])
    with pytest.raises(wz.ArchiveError):
        wz.directory(io.BytesIO(data[:-5]), len(data) - 5)


def test_a_record_is_one_range_and_damage_shows():
    raw = wz.record("response", 5, "http://x/ y\r\nEvil: 1", "d", None, b"a\r\n\r\nb")
    heads, payload = wz.read_record(raw)
    assert payload == b"a\r\n\r\nb" and heads["warc-target-uri"] == "http://x/yEvil:1" and "evil" not in heads
    assert raw == wz.record("response", 5, "http://x/ y\r\nEvil: 1", "d", None, b"a\r\n\r\nb")
    with pytest.raises(Exception):
        wz.read_record(raw[:-9])


def test_archives(spark):
    ship(spark)
    big, other = "<p>é</p>" * 200, "<b>" * 400
    rows = [(k, f"u{k}", big, "r") for k in range(0, 60, 3)] + [(1, None, other, "r"), (2, "u", other, "r"), (4, "u", "tiny", "r"), (5, "u", "tiny", "r"), (7, "u", None, "r"), (8, "u", "", "r"), (10, "u", "x" * 999, "r"), (11, "u", "x" * 999, "r"), (12, "u", "x" * 1000, "r"), (None, "u", big, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(5)
    got = sorted((tuple(r) for r in wz.archived(df).collect()), key=str)
    best = {}
    for page, _, html, _ in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            best[html] = max(page, best.get(html, page))
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        to = best.get(html) if len(raw) >= 1000 and page is not None else None
        revisit = to is not None and to != page
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want, key=str)
    assert wz.archived(df.limit(0)).collect() == []
