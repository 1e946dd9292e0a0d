"""Media columns: magic bytes found by Aho-Corasick, structure confirmed by format validators.

`sniff` looks at a whole byte string and returns each medium that it holds: type, start and
length as the format's own structure gives them. A declared type is corrected by the medium
that begins at byte 0; media further in are carved. A magic number whose structure does not
hold is no medium. What lies inside a confirmed medium is not reported again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import small_batches, texts

UNIT, DECLARED = 576, "application/octet-stream"


class Medium(NamedTuple):
    kind: str
    start: int
    length: int


class Blob:
    """A byte string, where its markers are, and the places from which a structure has been found not to hold: each is looked at once, however many headers lead to it."""

    def __init__(self, data: bytes):
        self.data, self.view = data, memoryview(data)
        self.bad: set[tuple] = set()
        self._at: dict[bytes, list[int]] = {}
        self._zips: dict[int, int] | None = None
        self._headers: list[int] | None = None

    def all(self, marker: bytes) -> list[int]:
        """The places of a marker, in order."""
        if marker not in self._at:
            out, p = [], self.data.find(marker)
            while p >= 0:
                out.append(p)
                p = self.data.find(marker, p + 1)
            self._at[marker] = out
        return self._at[marker]

    def after(self, marker: bytes, p: int) -> int:
        """The first place of a marker at p or later, or -1."""
        own = self.all(marker)
        i = bisect_left(own, p)
        return own[i] if i < len(own) else -1

    def before(self, marker: bytes, p: int) -> int:
        """The last place of a marker that ends at p or earlier, or -1."""
        own = self.all(marker)
        i = bisect_right(own, p - len(marker)) - 1
        return own[i] if i >= 0 else -1

    def zips(self) -> dict[int, int]:
        """Where an archive begins, by its own end record, to where it ends; the first of several."""
        if self._zips is None:
            self._zips = {}
            for end in self.all(b"PK\x05\x06"):
                if end + 22 > len(self.data):
                    continue
                size, start, note = struct.unpack_from("<IIH", self.data, end + 12)
                if self.data[end - size : end - size + 4] == b"PK\x01\x02" and size <= end and end + 22 + note <= len(self.data):
                    self._zips.setdefault(end - size - start, end + 22 + note)
        return self._zips

    def pdf_headers(self) -> list[int]:
        """Headers that begin a file: with a version, not where a stream begins, and with an end of their own."""
        if self._headers is None:
            self._headers = []
            for p in self.all(b"%PDF-"):
                table = self.after(b"startxref", p)
                version = self.data[p + 5 : p + 6].isdigit() and self.data[p + 6 : p + 7] == b"."
                inside = self.data[max(0, p - 8) : p].rstrip(b"\r\n").endswith(b"stream")
                if version and not inside and 0 < table < self.after(b"%%EOF", table):
                    self._headers.append(p)
        return self._headers

    def fails(self, seen: list[tuple]) -> int:
        self.bad.update(seen)
        return 0


def _wav(b: Blob, at: int) -> int:
    """RIFF size, then chunk by chunk: fmt before data, each inside the file."""
    d = b.data
    if len(d) - at < 44 or d[at + 8 : at + 12] != b"WAVE":
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0] + 8
    if at + size > len(d):
        return 0
    p, seen = at + 12, []
    while p + 8 <= at + size:
        name, n = d[p : p + 4], struct.unpack_from("<I", d, p + 4)[0]
        if p + 8 + n > at + size or (not seen and name != b"fmt "):
            return 0
        seen.append(name)
        p += 8 + n + n % 2
    return size if seen[:1] == [b"fmt "] and b"data" in seen else 0


def _png(b: Blob, at: int) -> int:
    """IHDR first, each chunk's checksum right, up to IEND."""
    d, p, seen = b.data, at + 8, []
    while p + 12 <= len(d) and ("png", p) not in b.bad:
        n, name = struct.unpack_from(">I", d, p)[0], d[p + 4 : p + 8]
        if p == at + 8 and (name, n) != (b"IHDR", 13):
            return 0
        seen.append(("png", p))
        if p + 12 + n > len(d) or zlib.crc32(b.view[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            break
        p += 12 + n
        if name == b"IEND":
            return p - at
    return b.fails(seen)


def _bmp(b: Blob, at: int) -> int:
    """Declared size, pixel offset and header size agree with the pixels that width, height and depth need."""
    if len(b.data) - at < 54:
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b.data, at + 2)
    w, h, planes, depth, packed = struct.unpack_from("<iiHHI", b.data, at + 18)
    need = (w * depth + 31) // 32 * 4 * abs(h)
    ok = zero == 0 and header in (40, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and w > 0 and h != 0 and 14 + header <= offset
    return size if ok and (packed or offset + need <= size) and at + size <= len(b.data) else 0


def _gif(b: Blob, at: int) -> int:
    """Screen descriptor, then extension and image blocks up to the trailer."""
    d = b.data
    if len(d) - at < 14 or d[at + 3 : at + 6] not in (b"87a", b"89a"):
        return 0
    flags = d[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)
    seen: list[tuple] = []

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            if ("gif", p) in b.bad:
                return len(d)
            seen.append(("gif", p))
            p += d[p] + 1
        return p + 1

    images = 0
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at if images else 0
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            own = d[p + 9]
            p = blocks(p + 10 + (3 << ((own & 7) + 1) if own & 128 else 0) + 1)
            images += 1
        else:
            return b.fails(seen)
    return b.fails(seen)


def _jpeg(b: Blob, at: int) -> int:
    """Marker segments up to the scan, then entropy-coded bytes up to the end marker."""
    d, p, frame, seen = b.data, at + 2, False, []
    while p + 4 <= len(d) and d[p] == 0xFF and ("jpeg", p, frame) not in b.bad:
        seen.append(("jpeg", p, frame))
        kind, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if kind in (0x00, 0xFF, 0xD8, 0xD9) or n < 2:
            break
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        p += 2 + n
        if kind == 0xDA:
            if not frame:
                break
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d):
                m = d[p + 1]
                if m == 0xD9:
                    return p + 2 - at
                if m != 0 and not 0xD0 <= m <= 0xD7:
                    break
                p += 2
            else:
                break
    return b.fails(seen)


def _pdf(b: Blob, at: int) -> int:
    """A version, and the last %%EOF that follows a startxref and lies before the next file's header, so that later updates of one file stay with it.

    A header begins the next file if this one has ended before it, no stream begins with it, and it ends itself.
    """
    d = b.data
    if not d[at + 5 : at + 6].isdigit() or d[at + 6 : at + 7] != b".":
        return 0
    table = b.after(b"startxref", at)
    first = b.after(b"%%EOF", table) if table >= 0 else -1
    if first < 0:
        return 0
    own = b.pdf_headers()
    i = bisect_left(own, first + 5)
    return b.before(b"%%EOF", own[i] if i < len(own) else len(d)) + 5 - at


def _zip(b: Blob, at: int) -> int:
    """An end record whose directory starts where it says, counted from this header."""
    return b.zips().get(at, at) - at


def _gzip(b: Blob, at: int) -> int:
    """It inflates to its end, with the right checksum and size. What is no deflated data is told within a few bytes."""
    d = b.data
    if len(d) - at < 18 or d[at + 2] != 8 or d[at + 3] & 0xE0:
        return 0
    z, p, step = zlib.decompressobj(31), at, 64
    try:
        while p < len(d) and not z.eof:
            z.decompress(b.view[p : p + step])
            p, step = p + step, min(2 * step, 1 << 16)
    except zlib.error:
        return 0
    return min(p, len(d)) - len(z.unused_data) - at if z.eof else 0


VALIDATORS: dict[bytes, tuple[str, Callable[[Blob, int], int]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"BM": ("image/bmp", _bmp),
    b"GIF8": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic in VALIDATORS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(data: bytes, finder: ahocorasick.Automaton) -> list[Medium]:
    """The media of data, in order, none inside another."""
    blob, out, free = Blob(data), [], 0
    for end, magic in finder.iter(data.decode("latin-1")):
        at = end + 1 - len(magic)
        if at < free:
            continue
        kind, valid = VALIDATORS[magic]
        if n := valid(blob, at):
            out.append(Medium(kind, at, n))
            free = at + n
    return out


def correct(data: bytes, declared: str | None, finder: ahocorasick.Automaton) -> tuple[str | None, bool, list[Medium]]:
    """The type of what begins at byte 0 (else the declared one), whether that corrects the declaration, and the media further in."""
    media = sniff(data, finder)
    if media and media[0].start == 0:
        return media[0].kind, media[0].kind != declared, media[1:]
    return declared, False, media


def store_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; each byte is a sample."""
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * pad


def read_wav(data: bytes, medium: Medium) -> bytes:
    """The samples of a confirmed WAV."""
    p = medium.start + 12
    while True:
        n = struct.unpack_from("<I", data, p + 4)[0]
        if data[p : p + 4] == b"data":
            return data[p + 8 : p + 8 + n]
        p += 8 + n + n % 2


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = automaton()
    for b in small_batches(batches, 128):
        out: list[list] = [[] for _ in range(7)]
        for t in texts(b):
            t = t or b""
            data = store_wav(t + b"\xff" * (UNIT - len(t) if not t else -len(t) % UNIT))
            main = sniff(data, finder)[0]
            back = read_wav(data, main)
            own, _, inner = correct(back, DECLARED, finder)
            s = np.frombuffer(back, np.uint8)
            counts = np.bincount(s, minlength=256)
            level = counts @ np.arange(256) / len(s)
            share = counts[counts > 0] / len(s)
            feature = f"{main.kind};corrected={int(main.kind != DECLARED)};samples={len(s)};mean={level:.4f};entropy={-(share * np.log2(share)).sum():.4f};distinct={len(share)};content={own};embedded={len(inner)}" + "".join(f";{m.kind}@{m.start}+{m.length}" for m in inner)
            row = (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature)
            for c, v in zip(out, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def stored(docs: DataFrame) -> DataFrame:
    """Each text as an 8-bit WAV, declared as unknown bytes, sniffed, read back and described.

    Null text counts as empty: 576 bytes of 255. Null doc_ids and repeated rows keep their
    rows; an empty table gives an empty table; only doc_id and text are read. Texts that hold
    media themselves stay samples, inside the confirmed WAV; what is read back is sniffed too,
    and the feature has the type of what the text begins with (content) and each medium further
    in, with its place and length.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store, OUT)


_SNIFF_OUT = "type string, corrected boolean, media array<struct<kind:string,start:long,length:long>>"


def _sniffer(content: str, declared: str | None, keys: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        for b in small_batches(batches, 64):
            data = b.column(b.schema.get_field_index(content)).to_pylist()
            said = b.column(b.schema.get_field_index(declared)).to_pylist() if declared else [None] * len(data)
            got = [correct(d, s, finder) if d is not None else (s, False, []) for d, s in zip(data, said, strict=True)]
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_()), pa.array([[m._asdict() for m in g[2]] for g in got], pa.list_(item))], [*keys, "type", "corrected", "media"])

    return go


def sniff_column(df: DataFrame, content: str, declared: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Per row: the key columns, type (the declared one, corrected), corrected, media (carved: kind, start, length).

    Null content keeps the declared type and has no media; null declared types are filled in.
    """
    keys = keys or [c for c in df.columns if c not in (content, declared)]
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    cols = list(dict.fromkeys([*keys, content, *([declared] if declared else [])]))
    return df.select(*cols).mapInArrow(_sniffer(content, declared, keys), f"{fields}, {_SNIFF_OUT}")


def op8_media(spark, sf_dir: str) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
