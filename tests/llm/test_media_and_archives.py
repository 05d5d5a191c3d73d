import hashlib
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import flac, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def payloads():
    random = np.random.default_rng(3)
    yield from (bytes(64), b"\xff" * 4096, bytes(range(256)) * 20, b"the quick brown fox " * 300, random.integers(0, 256, 5000, np.uint8).tobytes())
    wave = 128 + 100 * np.sin(np.arange(9000) / 20)
    yield wave.astype(np.uint8).tobytes()
    yield b"a"
    yield b"ab"


def as_bytes(samples):
    return (samples + 128).astype(np.uint8).tobytes()


def test_streams_round_trip():
    held = list(payloads())
    streams = flac.encode_many(held)
    assert [as_bytes(s) for s in flac.decode_many(streams)] == held
    assert len(streams[5]) < 0.7 * len(held[5])


def test_bitwise_reader_agrees_with_frames_in_step():
    held = list(payloads())
    for raw, media in zip(held, flac.encode_many(held)):
        info, points, at = flac.read_metadata(media)
        out = []
        while at < len(media):
            head, size = flac.read_header(media, at)
            samples, bits = flac.read_subframe(media, at + head, size, info["bits"])
            out.append(samples)
            at += head + -(-bits // 8) + 2
        assert as_bytes(np.concatenate(out)) == raw and info["samples"] == len(raw)
        assert points[:, 0].tolist() == list(range(0, len(raw), flac.BLOCK))


def test_streams_without_seek_table():
    raw = b"the quick brown fox " * 300
    media = flac.encode_many([raw])[0]
    _, _, at = flac.read_metadata(media)
    bare = media[:4] + b"\x80" + media[5:42] + media[at:]
    assert as_bytes(flac.decode_many([bare])[0]) == raw


def put(*fields):
    """Bytes of (value, bits) fields."""
    bits = "".join(format(v & (1 << n) - 1, f"0{n}b") if n else "" for v, n in fields)
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize(
    "fields,expected",
    [
        ([(0, 8), (-3, 8)], [-3] * 4),  # constant
        ([(1 << 1, 8), (1, 8), (-2, 8), (3, 8), (-4, 8)], [1, -2, 3, -4]),  # verbatim
        ([(8 << 1, 8), (0, 2), (1, 4), (0, 4), (1, 1), (1, 2), (15, 4), (3, 5), (-4, 3), (2, 3)], [0, -1, -4, 2]),  # two partitions, one escaped
        ([((8 + 1) << 1, 8), (5, 8), (1, 2), (0, 4), (2, 5), (1, 1), (2, 2), (1, 1), (1, 2), (1, 1), (0, 2)], [5, 6, 5, 5]),  # five-bit parameter
        ([(0x20 << 1, 8), (4, 8), (7, 4), (1, 5), (2, 8), (0, 2), (0, 4), (0, 4), (1, 1), (1, 1), (1, 1)], [4, 4, 4, 4]),  # linear of order 1
        ([(1 << 1 | 1, 8), (1, 1), (1, 7), (2, 7), (3, 7), (-4, 7)], [2, 4, 6, -8]),  # a wasted bit
    ],
)
def test_every_kind_of_subframe(fields, expected):
    if expected == [0, -1, -4, 2]:  # the first partition holds 0 and -1 with parameter 0
        fields = [(8 << 1, 8), (0, 2), (1, 4), (0, 4), (1, 1), (1, 2), (15, 4), (3, 5), (-4, 3), (2, 3)]
    assert flac.read_subframe(put(*fields), 0, 4, 8)[0].tolist() == expected


def test_damage_is_found():
    media = bytearray(flac.encode_many([b"the quick brown fox " * 300])[0])
    for at in (len(media) - 1, len(media) - 100, flac.read_metadata(bytes(media))[2] + 5):
        broken = media.copy()
        broken[at] ^= 1
        with pytest.raises(flac.Damaged):
            flac.decode_many([bytes(broken)])


def test_media_columns(spark, odd, empty):
    df = odd.toDF(*[f"c{i}" for i in range(9)]).select(F.col("c0").alias("doc_id"), F.col("c1").alias("text"))
    held = df.withColumn("media", flac.to_media("text")).withColumn("read", flac.from_media("media"))
    for r in held.collect():
        raw = (r["text"] or "").encode()
        assert bytes(r["read"]["pcm"]) == raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    blocks = flac.pcm_blocks(df.where("doc_id = 7").withColumn("media", flac.to_media("text"))).orderBy("sample_offset").collect()
    joined = b"".join(bytes(b["pcm"]) for b in blocks)
    assert [b["sample_offset"] for b in blocks] == list(range(0, len(joined), 4096))
    assert bytes((x + 128) % 256 for x in joined).rstrip(b"\0").decode() == df.where("doc_id = 7").first()["text"]
    assert empty.select(flac.from_media(flac.to_media("text"))).count() == 0
    nothing = spark.createDataFrame([(None,)], "media binary")
    assert nothing.select(flac.from_media("media").alias("m")).first()["m"] is None and flac.pcm_blocks(nothing).count() == 0


def test_arc_versions():
    rows = [(1, "http://a/b c", b"<p>x\n\n</p>"), (None, None, b""), (3, "http://z", b"line\r\n\r\nWARC/1.1\r\n")]
    for version in ("1", "2"):
        found = list(warc.read_arc(warc.arc_file(rows, version, "n.arc", "20240102030405")))
        assert [f["URL"] for _, f, _ in found] == ["filedesc://n.arc", "http://a/b%20c", "urn:none", "http://z"]
        assert [warc.http_parts(block)[2] for _, _, block in found[1:]] == [r[2] for r in rows]
        assert all(len(f) == len(warc.ARC_FIELDS[version].split()) for _, f, _ in found)


def arc_of(*records):
    """An archive of version 1 from header lines without length, and blocks."""
    about = b"1 0 old crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    return b"".join(b"%s %d\n%s\n" % (line, len(block), block) for line, block in [(b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain", about), *records])


@pytest.mark.parametrize("line, url, kind", [
    ("http://a/x y 1.2.3.4 20010203040506 text/html; charset=utf-8 9", "http://a/x y", "text/html; charset=utf-8"),
    ("http://a/2001 - 20010203040506 text/html 9", "http://a/2001", "text/html"),
    ("http://a/20010101000000 20010101 2001:db8::1 20010203 a/b 9", "http://a/20010101000000 20010101", "a/b"),
])
def test_header_lines_with_blanks(line, url, kind):
    fields = warc.header_fields(line, warc.ARC_FIELDS["1"].split())
    assert (fields["URL"], fields["Content-type"], fields["Archive-length"]) == (url, kind, "9")
    with pytest.raises(ValueError):
        warc.header_fields("http://a 1.2.3.4 text/html 9", warc.ARC_FIELDS["1"].split())


def test_types_addresses_and_names_of_records(spark, tmp_path):
    page = b"HTTP/1.0 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    records = [(b"dns:a.example 10.0.0.1 19970102030405 text/dns", b"a.example. 1 IN A 10.0.0.2\n"), (b"http://a.example/ 10.0.0.2 19970102 text/html; charset=utf-8", page), (b"http://a.example/ 10.0.0.2 19970102 text/html", page), (b"ftp://a.example/f 0.0.0.0 199701020304 application/x-tar", b"\x00\xff")]
    archives = spark.createDataFrame([(arc_of(*records),)], "content binary")
    warc.write_warc(warc.convert(archives), str(tmp_path / "w"))
    held = [f for file in (tmp_path / "w").glob("*.gz") for f, _ in warc.read_warc(file.read_bytes())]
    told = [(f["WARC-Type"], f["Content-Type"], f.get("WARC-IP-Address"), f["WARC-Date"]) for f in held if f["WARC-Type"] != "warcinfo"]
    assert sorted(told, key=str) == sorted([
        ("resource", "text/dns", "10.0.0.1", "1997-01-02T03:04:05Z"), ("response", "application/http; msgtype=response", "10.0.0.2", "1997-01-02T00:00:00Z"),
        ("response", "application/http; msgtype=response", "10.0.0.2", "1997-01-02T00:00:00Z"), ("resource", "application/x-tar", None, "1997-01-02T03:04:00Z"),
    ], key=str)
    assert len({f["WARC-Record-ID"] for f in held}) == 5 and [f["WARC-Filename"] for f in held if f["WARC-Type"] == "warcinfo"] == ["old.arc"]
    back = {r["url"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert bytes(back["ftp://a.example/f"]["payload"]) == b"\x00\xff" and bytes(back["http://a.example/"]["payload"]) == b"hi"
    assert back["dns:a.example"]["payload_digest"] == hashlib.sha1(records[0][1]).hexdigest()


def test_pages_with_clashing_columns_and_a_long_one(spark):
    long = "é" * 10_000_000
    df = spark.createDataFrame([(1, "u", long, 0, 0, 0, 0), (2, "v", long, 0, 0, 0, 0), (2, "v", long, 0, 0, 0, 0)], "page_id long, url string, html string, key int, HTML int, record int, kind int")
    found = warc.archive_pages(df).select("key", "record_type", "refers_to", "payload_bytes", "record_id").collect()
    assert sorted(tuple(r)[:4] for r in found) == [(1, "revisit", 2, 20_000_000), (2, "response", None, 20_000_000), (2, "response", None, 20_000_000)]
    assert len({r["record_id"] for r in found}) == 3


@pytest.mark.parametrize("damage", [lambda c: c[:-20], lambda c: c.replace(b"20240102030405", b"x")])
def test_short_arc_fails(damage):
    content = warc.arc_file([(1, "http://a", b"0123456789" * 10)], "1", "n.arc", "20240102030405")
    with pytest.raises(ValueError):
        list(warc.read_arc(damage(content)))


def test_revisits(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (9, "u9", big), (3, "u", other), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, None, None), (None, "n", big), (7, "w", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\n"), (8, "a b", ""), (10, "r", other), (10, "r", other)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    for r in found:
        raw = next((h or "").encode() for k, _, h in rows if k == r["key"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    kinds = {(r["key"], r["record_type"], r["refers_to"]) for r in found}
    assert kinds == {(1, "revisit", 9), (2, "revisit", 9), (None, "revisit", 9), (9, "response", None), (3, "revisit", 10), (10, "response", None), *[(k, "response", None) for k in (4, 5, 6, 7, 8)]}
    assert {r["key"]: r["payload"] for r in found}[7] == rows[8][2].encode()
    responses = {r["record_id"] for r in found if r["record_type"] == "response"}
    assert all(i.startswith("<urn:uuid:") and i[24] == "5" and i[29] in "89ab" for i in responses)


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_header_number_coding():
    for number in (0, 127, 128, 2047, 2048, 65535, 65536, 2**21 - 1, 2**21, 2**26):
        head = flac.frame_header(number, 7)
        assert flac.read_header(head, 0) == (len(head), 7)
        if number < 0x110000 and not 0xD800 <= number < 0xE000:
            assert head[4 : 4 + len(chr(number).encode())] == chr(number).encode()
    assert struct.unpack(">H", head[-3:-1])[0] == 6


def test_long_streams_equal_those_made_at_once(monkeypatch):
    random = np.random.default_rng(3)
    payload = (random.integers(0, 40, 40_000).cumsum() % 251).astype(np.uint8).tobytes()
    whole = flac.encode_many([payload])[0]
    for step in (1024, 8192, 1 << 18):
        monkeypatch.setattr(flac, "STEP_BYTES", step)
        assert flac.encode([b"abc", payload, b"abc"]) == [*flac.encode_many([b"abc"]), whole, *flac.encode_many([b"abc"])]
        (samples,) = flac.decode_many([whole])
        assert (samples + 128).astype(np.uint8).tobytes() == payload
        wide = samples.astype(int)
        assert flac.feature_of(samples) == f"peak={abs(wide).max()};energy={(wide * wide).sum()};crossings={((wide[1:] < 0) != (wide[:-1] < 0)).sum()}"


MEASURED = """
import resource, sys
from tidemill.llm import flac, quality
text = " ".join(f"word{i % 9973}" for i in range(20_000_000 // 9))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if sys.argv[1] == "flac":
    raw = text.encode()
    (media,) = flac.encode([raw])
    (samples,) = flac.decode_many([media])
    assert len(samples) == len(raw) and flac.feature_of(samples)
else:
    x, counts = quality.encode_passages([text])
    assert counts.tolist() == [len(x)] and len(quality.Model.fresh().forward(x, counts)[0]) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("which", ["flac", "quality"])
def test_memory_of_a_text_of_20_megabytes(which):
    done = subprocess.run([sys.executable, "-c", MEASURED, which], capture_output=True, text=True, cwd=ROOT, check=True, env=os.environ | {"OPENBLAS_NUM_THREADS": "1"})
    assert int(done.stdout) < 300
