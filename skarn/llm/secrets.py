"""Secrets in texts, also under layers of encoding.

Each text is a worklist that starts with the text itself. A layer is scanned with the patterns, and every run in it that
decodes is unwrapped into a further layer: percent codes, escapes of code points, base64, and gzip, zlib or hexadecimal
forms of these. The list ends at its fixpoint. A layer maps each of its characters to a span of the original text, so
findings at any depth are given as spans of that text: character by character where the encoding allows it, else as the
whole run. Of a run only the kinds that it holds at any depth matter, so equal content is scanned once and counts at every
place where it stands; a content that comes back under itself is not entered again, which breaks cycles.

Every text is scanned whole, and so is what a run inflates to, all members of it: piece by piece, in windows of about
`INFLATED` bytes that end where neither a finding nor an encoded run can stand. A window grows where there is no such place.
"""

from __future__ import annotations

import binascii
import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm._shared import text_slices, texts_of

INFLATED = 1 << 24  # bytes of a window, about
PIECE = 1 << 20  # bytes inflated at a time
LEVELS = 64  # of compression in compression: data may inflate to itself
KINDS = ("assign", "access", "hex")

# The patterns of the kinds, and the least length of what each finds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

PATTERNS = (
    ("assign", re.compile(ASSIGN, re.IGNORECASE | re.ASCII), 2),
    ("access", re.compile(ACCESS), 0),
    # a maximal run of at least the least length is what the plain pattern finds and keeps
    ("hex", re.compile(f"[0-9a-f]{{{LEAST['hex']},}}"), 0),
)

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
# \uXXXX, \u{X...}, \UXXXXXXXX, \xXX, &#N; and &#xN;
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# the same over several lines, the last of which may be short when nothing follows it (a lone word there goes with the run)
WRAPPED = re.compile(
    r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*+(?:(?<=[A-Za-z0-9+/_-]{16})\r?\n[ \t]*[A-Za-z0-9+/_-]{1,15}(?=[=\r\n\"'<]|\Z))?={0,2}"
)
BLANK = re.compile(r"[\r\n \t]+")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
HEXED = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
# a window may end after these
END = re.compile(rb"[,()<>!?|\[\]*@$^~`]|[A-Za-z0-9.,] (?=[A-Za-z0-9])")

Layer = tuple[str, list[int] | None, list[int] | None]  # text, and per character first and end in the original


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each kind's matches in one layer, leftmost and without overlap per kind."""
    out = []
    for kind, pattern, group in PATTERNS:
        if kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= LEAST[kind]:
                out.append((m.start(), m.end(), kind))
    return out


def _replaced(layer: Layer, runs: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with runs replaced by characters, each with its own place (first, end) in the layer."""
    text, firsts, ends = layer
    parts, new_firsts, new_ends, last = [], [], [], 0

    def plain(a: int, b: int) -> None:
        parts.append(text[a:b])
        new_firsts.extend(range(a, b) if firsts is None else firsts[a:b])
        new_ends.extend(range(a + 1, b + 1) if ends is None else ends[a:b])

    for start, end, chars in runs:
        plain(last, start)
        for char, a, b in chars:
            parts.append(char)
            new_firsts.append(a if firsts is None else firsts[a])
            new_ends.append(b if ends is None else ends[b - 1])
        last = end
    plain(last, len(text))
    return "".join(parts), new_firsts, new_ends


def _place(layer: Layer, start: int, end: int) -> tuple[int, int]:
    """The span of the original text that a run of a layer stands for."""
    _, firsts, ends = layer
    return (start, end) if firsts is None else (min(firsts[start:end]), max(ends[start:end]))


def _percent(layer: Layer) -> Layer | None:
    runs = []
    for m in PERCENT.finditer(layer[0]):
        raw, at, chars = bytes.fromhex(m[0].replace("%", "")), m.start(), []
        while raw:
            size = 1 if raw[0] < 0x80 else 2 if raw[0] >> 5 == 6 else 3 if raw[0] >> 4 == 14 else 4 if raw[0] >> 3 == 30 else 1
            try:
                chars.append((raw[:size].decode(), at, at + 3 * size))
            except UnicodeDecodeError:
                size = 1
                chars.append(("\ufffd", at, at + 3))
            raw, at = raw[size:], at + 3 * size
        runs.append((m.start(), m.end(), chars))
    return _replaced(layer, runs) if runs else None


def _escaped(layer: Layer) -> Layer | None:
    runs: list[tuple[int, int, list[tuple[str, int, int]]]] = []
    for m in ESCAPE.finditer(layer[0]):
        code = int(m[5]) if m[5] else int(next(g for g in m.groups() if g), 16)
        if code > 0x10FFFF:
            continue
        if 0xDC00 <= code < 0xE000 and runs and runs[-1][1] == m.start() and 0xD800 <= ord(runs[-1][2][0][0]) < 0xDC00:
            start, _, chars = runs.pop()
            code = 0x10000 + ((ord(chars[0][0]) - 0xD800) << 10) + code - 0xDC00
            runs.append((start, m.end(), [(chr(code), start, m.end())]))
        else:
            runs.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
    return _replaced(layer, runs) if runs else None


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] & 0x0F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What gzip or zlib data holds, member after member; bytes that are no member stay as they are."""
    engine, fresh = zlib.decompressobj(zlib.MAX_WBITS | 32), b""
    for piece in pieces:
        while True:
            try:
                out = engine.decompress(piece, PIECE)
            except zlib.error:
                yield fresh + piece
                yield from pieces
                return
            if out:
                yield out
            # as long as a member has given nothing, its bytes may turn out to be none
            fresh = b"" if out or engine.eof else fresh + piece
            if engine.eof:
                piece = engine.unused_data.lstrip(b"\0")
                engine = zlib.decompressobj(zlib.MAX_WBITS | 32)
                if not piece:
                    break
            else:
                piece = engine.unconsumed_tail
                if not piece and len(out) < PIECE:
                    break
    if fresh:
        yield fresh


def _inflated(pieces: Iterator[bytes], levels: int = LEVELS) -> Iterator[bytes]:
    head = b""
    for piece in pieces:
        head += piece
        if len(head) > 2:
            break
    pieces = chain((head,), pieces)
    return _inflated(_members(pieces), levels - 1) if levels and _packed(head) else pieces


def _windows(raw: bytes) -> Iterator[bytes]:
    """Decoded bytes, or what they inflate to, whole up to `INFLATED`, else in windows that cut nothing in two."""
    buffer, looked = bytearray(), 0
    for piece in _inflated(iter((raw,))):
        buffer += piece
        if len(buffer) >= INFLATED:
            cut = 0
            for m in END.finditer(buffer, looked):
                cut = m.end()
            looked = max(0, len(buffer) - 2)
            if cut:
                yield bytes(buffer[:cut])
                del buffer[:cut]
                looked = 0
    if buffer:
        yield bytes(buffer)


def _texts(raw: bytes) -> Iterator[str]:
    """Bytes as texts, whatever else stands among them: as UTF-8, as UTF-16 where every second byte is null."""
    starts = {0} | {m.start() for m in MAGIC.finditer(raw)}
    for start in sorted(starts):
        # inside other bytes only what inflates counts, the rest is read from the first byte on
        if start and not _begins(raw[start : start + PIECE]):
            continue
        for window in _windows(raw[start:]):
            yield window.decode(errors="replace")
            for first, code in ((0, "utf-16-be"), (1, "utf-16-le")):
                if 2 * window[first::2].count(0) > len(window) // 2:
                    yield window.decode(code, errors="replace")


def _begins(raw: bytes) -> bool:
    try:
        return bool(zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(raw, 1))
    except zlib.error:
        return False


def _decoded(run: str) -> Iterator[bytes]:
    """The bytes of a run of base64 from each of its first four characters on: what stands before it may touch it."""
    wide = run.rstrip("=").translate(URL_SAFE)
    for phase in range(4):
        size = len(wide) - phase
        size -= size % 4 == 1
        yield binascii.a2b_base64(wide[phase : phase + size] + "=" * (-size % 4))


def _unpacked(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, content) of the runs of base64 or hexadecimal digits, with all that their bytes hold as text."""
    for m in BASE64.finditer(text):
        for raw in _decoded(m[0]):
            for content in _texts(raw):
                yield m.start(), m.end(), content
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            if "\n" in m[0]:
                for raw in _decoded(BLANK.sub("", m[0])):
                    for content in _texts(raw):
                        yield m.start(), m.end(), content
    for m in HEXED.finditer(text):
        for content in _texts(bytes.fromhex(m[0])):
            yield m.start(), m.end(), content


URL_SAFE = str.maketrans("-_", "+/")


def _recoded(layer: Layer) -> Iterator[Layer]:
    """The layer with its percent codes, and with its escapes, as what they stand for."""
    if "%" in layer[0] and (inner := _percent(layer)):
        yield inner
    if ("\\" in layer[0] or "&#" in layer[0]) and (inner := _escaped(layer)):
        yield inner


def _inner(content: str) -> Iterator[str]:
    for _, _, inner in _unpacked(content):
        yield inner
    for layer in _recoded((content, None, None)):
        yield layer[0]


def _held(content: str, scanned: dict[bytes, tuple[set[str], set[bytes]]]) -> set[str]:
    """Kinds that the content of a run holds at any depth.

    `scanned` keeps, by digest, the kinds and the inner contents of each content; a content itself is held while its own
    inner ones are scanned, no longer.
    """
    stack: list[tuple[bytes, Iterator[str]]] = []

    def enter(own: str) -> bytes:
        name = blake2b(own.encode(errors="surrogatepass"), digest_size=16).digest()
        if name not in scanned:
            scanned[name] = {kind for _, _, kind in base_spans(own)}, set()
            stack.append((name, _inner(own)))
        return name

    top = enter(content)
    while stack:
        name, inner = stack[-1]
        if (own := next(inner, None)) is None:
            stack.pop()
        else:
            scanned[name][1].add(enter(own))
    kinds, seen, work = set(), {top}, [top]
    while work:
        own_kinds, below = scanned[work.pop()]
        kinds |= own_kinds
        work += below - seen
        seen |= below
    return kinds


def spans_of(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(spans of the text itself, all spans), each (start, end, kind) ordered by start, kind and end.

    Offsets count characters (code points) of the text, ends exclusive. A span found again in a decoded layer is listed
    once; equal runs at several places give a span each.
    """
    order = {k: i for i, k in enumerate(KINDS)}
    by_place = lambda s: (s[0], order[s[2]], s[1])
    base = sorted(base_spans(text), key=by_place)
    every, seen, work, scanned = set(base), set(), [(text, None, None)], {}
    while work:
        layer = work.pop()
        if layer[1] is not None:
            every.update((*_place(layer, a, b), kind) for a, b, kind in base_spans(layer[0]))
        for a, b, content in _unpacked(layer[0]):
            every.update((*_place(layer, a, b), kind) for kind in _held(content, scanned))
        for inner in _recoded(layer):
            mark = (inner[0], array("q", inner[1]).tobytes(), array("q", inner[2]).tobytes())
            if mark not in seen:
                seen.add(mark)
                work.append(inner)
    return base, sorted(every, key=by_place)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    joined: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    edges = [0, *(x for pair in joined for x in pair), len(text)]
    return mark.join(text[a:b] for a, b in [*pairwise(edges)][::2])


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of every row.

    The counts and `base` are those of the text itself, `spans` adds what decoded layers hold. A null text counts as
    empty and has no spans. Rows that repeat are scanned each for itself, an empty table gives no rows, other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, text_column, 4 << 20):
                both = [spans_of(t) for t in texts_of(rows, text_column)]
                counts = [pa.array([sum(s[2] == kind for s in b) for b, _ in both], pa.int64()) for kind in KINDS]
                lists = [pa.array([listed(x[k]) for x in both], pa.string()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(id_column), *counts, *lists],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
                )

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string"
    )


def redact(df: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret of the text, at any depth, replaced; a null text stays null."""
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, text_column, 4 << 20):
                texts = [t and redacted(t, spans_of(t)[1], mark) for t in rows.column(at).to_pylist()]
                columns = [*rows.columns]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, rows.schema.names)

    return df.mapInArrow(run, df.schema)


def digested(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
