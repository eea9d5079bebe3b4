import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from cellweave.llm import media, queries


def png(data=b"\x00" * 4):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")


def wav(n=10):
    return b"RIFF" + struct.pack("<I", 36 + n) + struct.pack("<4s4sIHHIIHH4sI", b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + bytes(n)


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, m in enumerate(members):
            z.writestr(f"m{i}", m)
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b"\x2c" + bytes(8) + b"\x00" + b"\x02" + b"\x02\x44\x01" + b"\x00" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05abc\xff\xda\x00\x04ab" + b"12\xff\x003\xff\xd034" + b"\xff\xd9"
BMP = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + struct.pack("<iiHH", 1, 1, 1, 24) + bytes(28)
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF\n"
OGG = b"OggS\x00\x02" + bytes(20) + b"\x01\x05hello" + b"OggS\x00\x04" + bytes(20) + b"\x01\x02hi"
MP4 = struct.pack(">I4s", 16, b"ftyp") + b"isom" + bytes(4) + struct.pack(">I4s", 12, b"mdat") + b"data"
FLAC = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8" + bytes(5)
WHOLE = {
    "image/png": png(), "audio/wav": wav(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF,
    "application/ogg": OGG, "video/mp4": MP4, "audio/flac": FLAC, "application/zip": zipped(b"x"), "application/gzip": gzip.compress(b"y" * 200_000),
}


def test_each_format_is_confirmed_with_its_length():
    for kind, data in WHOLE.items():
        found = media.sniff_bytes(data)
        assert found and found[0][:3] == (kind, 0, len(data)), (kind, found)


def test_each_format_is_refused_when_cut_and_found_when_embedded():
    for kind, data in WHOLE.items():
        assert not [f for f in media.sniff_bytes(data[:-3] if kind != "audio/flac" else data[:20]) if f[0] == kind and f[1] == 0], kind
        tail = b"" if kind == "audio/flac" else b"\x00 tail"
        inside = [f for f in media.sniff_bytes(b"some text " + data + tail) if f[0] == kind]
        assert inside and inside[0][1] == 10 and (kind in ("audio/flac",) or inside[0][2] == len(data)), kind


def test_wrong_sums_and_random_bytes():
    broken = bytearray(png())
    broken[40] ^= 1
    assert not media.sniff_bytes(bytes(broken))
    random.seed(3)
    for _ in range(200):
        junk = b"".join(random.choice([b"RIFF", b"BM", b"PK\x03\x04", b"%PDF-", b"ftyp", b"OggS\x00\x02", b"\xff\xd8\xff", b"fLaC", bytes([random.randrange(256)])]) for _ in range(60))
        for kind, at, size, data_at, data_size in media.sniff_bytes(junk):
            assert 0 <= at and at + size <= len(junk) and data_at + data_size <= size


def test_columns(spark):
    both = zipped(png(), wav())  # stored without compression: the members can be carved
    rows = [(1, png(), "image/jpeg", "x"), (2, b"plain", "image/png", "x"), (3, b"plain", "text/plain", None), (4, None, None, "x"), (5, b"", "audio/wav", "x"), (6, both, "application/zip", "x"), (6, both, "application/zip", "x")]
    df = spark.createDataFrame(rows, "id int, media binary, declared string, type string")
    got = media.sniff(df)
    seen = {r["id"]: (r["media_type"], r["corrected"]) for r in got.collect()}
    assert seen == {
        1: ("image/png", True), 2: (media.UNKNOWN, True), 3: ("text/plain", False), 4: (media.UNKNOWN, False),
        5: (media.UNKNOWN, True), 6: ("application/zip", False),
    }
    carved = media.carve(got).collect()
    assert sorted(r["type"] for r in carved if r["id"] == 6) == sorted(2 * ["application/zip", "image/png", "audio/wav"])
    assert {bytes(r["carved"]) for r in carved if r["type"] == "image/png"} == {png()}
    assert media.sniff(df.limit(0)).count() == 0 and media.carve(got.limit(0)).count() == 0


def test_payloads_of_documents(spark, small):
    """The query against plain Python over whole texts."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_media"](spark, small).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(payload)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + struct.pack("<4s4sIHHIIHH4sI", b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
        assert r["media_sha256"] == hashlib.sha256(head + payload).hexdigest() and r["media_bytes"] == len(head + payload)


def test_padding_and_null_payloads(spark):
    df = spark.createDataFrame([(None,), ("",), ("a" * 576,), ("a" * 577,)], "text string")
    sizes = [r[0] for r in df.select(F.octet_length(media.padded_payload(F.col("text"), 576))).collect()]
    assert sizes == [576, 576, 576, 1152]
