"""Media columns: magic bytes found by an Aho-Corasick automaton, confirmed by format validators.

A hit of a magic string is only a candidate; the validator of its format walks the structure from
there and gives the length, or refuses. What is confirmed corrects the declared type and is carved.
"""

from __future__ import annotations

import functools
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import small_batches

UNKNOWN = "application/octet-stream"
#: Fixed values of the formats: magic string, its distance from the start, media type.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "application/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
BMP_HEADERS = {12, 40, 52, 56, 64, 108, 124}

#: media type, first byte, length, first byte and length of the sample data (0, 0 where the format packs it).
Found = tuple[str, int, int, int, int]


def _png(b: bytes, at: int) -> Found | None:
    pos, data = at + 8, (0, 0)
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + size > len(b) or zlib.crc32(memoryview(b)[pos + 4:pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return None
        if (kind == b"IHDR") != (pos == at + 8):
            return None
        if kind == b"IDAT" and data == (0, 0):
            data = (pos + 8 - at, size)
        pos += 12 + size
        if kind == b"IEND":
            return "image/png", at, pos - at, *data
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    pos, frame = at + 2, False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if kind in (0x00, 0xD8, 0xD9) or size < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if kind == 0xDA:  # entropy-coded data up to the next marker that is not a restart
            if not frame:
                return None
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0xD9:
                    return "image/jpeg", at, pos + 2 - at, 0, 0
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                elif b[pos + 1] == 0xFF:
                    pos += 1
                else:
                    break
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos, images = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
    while pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return ("image/gif", at, pos + 1 - at, 0, 0) if images else None
        if mark == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos += 11 + (3 << (local & 7) + 1 if local & 0x80 else 0)
            images += 1
        elif mark == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> Found | None:
    if at + 26 > len(b):
        return None
    size, spare, first, header = struct.unpack_from("<IIII", b, at + 2)
    if spare or header not in BMP_HEADERS or not 14 + header <= first <= size or at + size > len(b):
        return None
    planes = struct.unpack_from("<H", b, at + (22 if header == 12 else 26))[0]
    return ("image/bmp", at, size, first, size - first) if planes == 1 else None


def _riff(b: bytes, at: int) -> Found | None:
    if at + 12 > len(b):
        return None
    size, kind = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + size
    if kind not in RIFF_TYPES or end > len(b):
        return None
    pos, chunks, data = at + 12, set(), (0, 0)
    while pos + 8 <= end:
        name, length = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + length > end:
            return None
        if name == b"data" and data == (0, 0):
            data = (pos + 8 - at, length)
        chunks.add(name)
        pos += 8 + length + length % 2
    if pos not in (end, end + 1) or kind == b"WAVE" and not {b"fmt ", b"data"} <= chunks or not chunks:
        return None
    return RIFF_TYPES[kind], at, end - at, *data


def _flac(b: bytes, at: int) -> Found | None:
    """Length to the end of the bytes: frames carry no total length."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos], int.from_bytes(b[pos + 1:pos + 4], "big")
        if first and (kind & 0x7F or size != 34) or kind & 0x7F == 127:
            return None
        pos, first = pos + 4 + size, False
        if kind & 0x80:
            ok = pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xFC == 0xF8
            return ("audio/flac", at, len(b) - at, pos - at, len(b) - pos) if ok else None
    return None


def _ogg(b: bytes, at: int) -> Found | None:
    pos = at
    while pos + 27 <= len(b) and b[pos:pos + 4] == b"OggS" and b[pos + 4] == 0:
        flags, count = b[pos + 5], b[pos + 26]
        if pos == at and not flags & 2:
            return None
        pos += 27 + count + sum(b[pos + 27:pos + 27 + count])
        if pos > len(b):
            return None
        if flags & 4:
            return "application/ogg", at, pos - at, 0, 0
    return None


def _mp4(b: bytes, at: int) -> Found | None:
    pos, data, seen = at, (0, 0), set()
    while pos + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        head = 8
        if size == 1 and pos + 16 <= len(b):
            size, head = struct.unpack_from(">Q", b, pos + 8)[0], 16
        if size < head or pos + size > len(b) or not kind.isalnum():
            break
        if kind == b"mdat":
            data = (pos + head - at, size - head)
        seen.add(kind)
        pos += size
    return ("video/mp4", at, pos - at, *data) if b"ftyp" in seen and seen & {b"moov", b"mdat", b"moof"} else None


def _pdf(b: bytes, at: int) -> Found | None:
    if not (b[at + 5:at + 6].isdigit() and b[at + 6:at + 7] == b"."):
        return None
    stop = b.find(b"%PDF-", at + 5)
    last = b.rfind(b"%%EOF", at, stop if stop > 0 else len(b))
    if last < 0 or b.find(b"startxref", at, last) < 0:
        return None
    end = last + 5
    while end < len(b) and end < last + 7 and b[end] in b"\r\n":
        end += 1
    return "application/pdf", at, end - at, 0, 0


def _zip(b: bytes, at: int) -> Found | None:
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, where, note = struct.unpack_from("<IIH", b, end + 12)
        if at + where + size == end and b[at + where:at + where + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
            return "application/zip", at, end + 22 + note - at, 0, 0
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _gzip(b: bytes, at: int) -> Found | None:
    """One member, inflated in pieces that are thrown away; zlib checks its sum and length."""
    member, pos = zlib.decompressobj(31), at
    try:
        while not member.eof:
            if not member.unconsumed_tail and pos >= len(b):
                return None
            feed = member.unconsumed_tail or b[pos:pos + 65536]
            if not member.unconsumed_tail:
                pos += len(feed)
            member.decompress(feed, 65536)
    except zlib.error:
        return None
    return "application/gzip", at, pos - len(member.unused_data) - at, 0, 0


VALIDATORS = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac,
    "application/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, before, kind in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic) + before - 1, kind))
    found.make_automaton()
    return found


def sniff_bytes(b: bytes) -> list[Found]:
    """Confirmed media in order of their first byte, outermost first.

    Hits are tried from left to right. What lies inside confirmed media is reported as well, so an
    image inside an archive is carved from it.
    """
    out = []
    for last, (back, kind) in automaton().iter(b.decode("latin-1")):
        if last >= back and (found := VALIDATORS[kind](b, last - back)):
            out.append(found)
    return sorted(set(out), key=lambda f: (f[1], -f[2]))


SPANS = "array<struct<type:string,start:long,length:long,data_start:long,data_length:long>>"
_KIND = pa.list_(pa.struct([("type", pa.string()), *((n, pa.int64()) for n in ("start", "length", "data_start", "data_length"))]))


def _sniff(media: pa.Array) -> pa.Array:
    names = ("type", "start", "length", "data_start", "data_length")
    return pa.array([[dict(zip(names, f)) for f in sniff_bytes(m.as_py() or b"")] for m in media], _KIND)


def sniff(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """``df`` with three more columns for a binary media column.

    ``spans``: confirmed media with type, start, length and their sample data (relative to the start);
    ``media_type``: the type of the media that begins at byte 0, else the declared type where no
    format contradicts it, else ``application/octet-stream``; ``corrected``: whether it differs from
    the declared type. A declared type whose format has a validator and is not confirmed is not
    believed. Null and empty media have no spans; a null declaration counts as
    ``application/octet-stream``. Input columns of these names are replaced.
    """
    known = sorted({k for k in VALIDATORS if "/" in k} | set(RIFF_TYPES.values()))
    said = F.coalesce(F.col(declared), F.lit(UNKNOWN))
    head = F.filter("spans", lambda s: s["start"] == 0)
    seen = F.when(F.size(head) > 0, F.element_at(head, 1)["type"]).when(said.isin(known), F.lit(UNKNOWN)).otherwise(said)
    return (
        small_batches(df).withColumn("spans", arrow_udf(_sniff, SPANS)(F.col(media)))
        .withColumn("media_type", seen).withColumn("corrected", F.col("media_type") != said)
    )


def carve(df: DataFrame, media: str = "media", spans: str = "spans") -> DataFrame:
    """One row per confirmed medium: the columns of ``df`` without its spans, then ``type``, ``start``,
    ``length`` and the bytes as ``carved``. Rows without confirmed media give none."""
    each = df.withColumn("__s", F.explode(spans)).drop(spans)
    piece = F.expr(f"substring(`{media}`, cast(__s.start as int) + 1, cast(__s.length as int))")
    return each.select(
        *[F.col(c) for c in each.columns if c not in ("__s", "type", "start", "length", "carved")],
        F.col("__s.type").alias("type"), F.col("__s.start").alias("start"), F.col("__s.length").alias("length"), piece.alias("carved"),
    )


def sample_data(media: str = "media", spans: str = "spans") -> Column:
    """The sample data of the medium at byte 0, null where no such medium is confirmed."""
    first = F.element_at(F.filter(spans, lambda s: (s["start"] == 0) & (s["data_length"] > 0)), 1)
    at, size = first["data_start"].cast("int"), first["data_length"].cast("int")
    return F.when(F.size(F.filter(spans, lambda s: (s["start"] == 0) & (s["data_length"] > 0))) > 0, F.substring(F.col(media), at + 1, size))


def padded_payload(text: Column, unit: int) -> Column:
    """UTF-8 bytes of a text (null: none) with bytes 255 up to a positive multiple of ``unit``."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    size = F.octet_length(raw)
    want = F.greatest(F.lit(1), F.ceil(size / F.lit(unit))).cast("int") * F.lit(unit)
    return F.rpad(raw, want, F.unhex(F.lit("FF")))


def wav(payload: Column, rate: int = 8000) -> Column:
    """A mono 8-bit PCM file whose samples are the payload's bytes, one for one (even lengths only)."""
    size = F.octet_length(payload)

    def little(value: Column) -> Column:
        digits = F.lpad(F.hex(value.cast("long")), 8, "0")
        return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))

    fmt = struct.pack("<4s4sIHHIIHH4s", b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    return F.concat(F.lit(b"RIFF"), little(size + 36), F.lit(fmt), little(size), payload)


def _features(samples: pa.Array) -> pa.Array:
    out = []
    for s in samples:
        x = np.frombuffer(s.as_buffer(), np.uint8) if s.is_valid else np.zeros(0, np.uint8)
        if not len(x):
            out.append("samples=0")
            continue
        crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
        share = np.bincount(x, minlength=256) / len(x)
        entropy = -float(np.sum(share[share > 0] * np.log2(share[share > 0])))
        out.append(f"samples={len(x)};min={x.min()};max={x.max()};mean={x.mean():.4f};crossings={crossings};entropy={abs(entropy):.4f}")
    return pa.array(out, pa.string())


def sample_features(samples: Column) -> Column:
    """Count, range, mean, crossings of the middle and entropy of 8-bit samples (null: none)."""
    return arrow_udf(_features, "string")(samples)
