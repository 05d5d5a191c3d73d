"""Legacy ARC archives to WARC: parse, synthesise records, write archives, read them back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, pick, shared_dir, table, text_bytes

#: Field names of the URL-record line, by ARC version; fixed by the format.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_BYTES, FILE_BYTES, RECORDS_PER_FILE, LEAST_REVISIT, SALTS = 1 << 20, 16 << 20, 2000, 1000, 32
KEY_HEADER = b"X-Page-Id"
#: Record ids are name-based UUIDs (version 5) in the URL namespace.
NAMESPACE = uuid.NAMESPACE_URL
#: What stands between URL and content type of a header line: an address, or none known, and a date of 8 to 14 digits.
ADDRESS, DATE = re.compile(r"-|[0-9.]+|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*"), re.compile(r"\d{8}(\d\d){0,3}")

RECORD_SCHEMA = "record_id string, kind string, key long, url string, address string, date string, content_type string, payload_digest string, payload_bytes long, block_digest string, head binary, block binary"
READ_SCHEMA = "key long, url string, date string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def arc_file(rows: list[tuple[int | None, str | None, bytes]], version: str, name: str, date: str) -> bytes:
    """An ARC archive of HTTP responses; each response's headers carry its key."""
    names = ARC_FIELDS[version]
    about = f"{version} 0 tidemill\n{names}\n".encode()
    fixed = {"IP-address": "0.0.0.0", "Archive-date": date, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name}

    def line(url: str, kind: str, size: int) -> bytes:
        own = fixed | {"URL": url, "Content-type": kind, "Archive-length": str(size)}
        return " ".join(own[n] for n in names.split()).encode() + b"\n"

    out = [line(f"filedesc://{name}", "text/plain", len(about)), about, b"\n"]
    for key, url, body in rows:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if key is None else b"%s: %d\r\n" % (KEY_HEADER, key)) + b"Content-Length: %d\r\n\r\n" % len(body)
        out += [line(re.sub(r"\s", "%20", url or "") or "urn:none", "text/html; charset=utf-8", len(head) + len(body)), head, body, b"\n"]
    return b"".join(out)


def _archives(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, batch in enumerate(chunks(batches, "html", ARC_BYTES)):
            rows = [(k, u, (h or "").encode()) for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "html")))]
            made = [arc_file(half, v, f"part-{task}-{n}-{v}.arc", date) for v, half in (("1", rows[::2]), ("2", rows[1::2])) if half]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["content"])

    return run


def arc_archives(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """(content): ARC archives, alternately of version 1 and 2, of (key, url, html) rows."""
    return pages.select("key", "url", "html").mapInArrow(_archives(date), "content binary")


def header_fields(line: str, names: list[str]) -> dict[str, str]:
    """The fields of an ARC header line; URL and content type may hold blanks.

    They stand around an address and a date, and what follows the content type has no blanks, so
    the line is read from both sides of the date and from its end. A line that doesn't fit is a ValueError.
    """
    values = line.split(" ")
    behind = len(names) - names.index("Content-type") - 1
    for at in range(2, len(values) - behind - 1):
        if DATE.fullmatch(values[at]) and ADDRESS.fullmatch(values[at - 1]):
            kind = values[at + 1 : len(values) - behind]
            return dict(zip(names, [" ".join(values[: at - 1]), values[at - 1], values[at], " ".join(kind), *values[len(values) - behind :]]))
    raise ValueError(f"an ARC header line of {len(values)} fields holds no URL, address, date, type and {behind} more")


def read_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record, the version block first; that block names the fields."""
    end = content.index(b"\n")
    size = int(content[:end].split(b" ")[-1])
    about = content[end + 1 : end + 1 + size].decode("latin-1")
    version = about.split(" ", 1)[0]
    names = about.split("\n")[1].split() if "\n" in about.strip() else ARC_FIELDS[version].split()
    first = content[:end].decode("utf-8", "replace")
    try:
        yield 0, header_fields(first, names), content[end + 1 : end + 1 + size]
    except ValueError:  # the version line of an archive of version 2 may have the five fields of version 1
        yield 0, header_fields(first, ARC_FIELDS["1"].split()), content[end + 1 : end + 1 + size]
    at = end + 1 + size
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        end, start = content.index(b"\n", at), at
        fields = header_fields(content[at:end].decode("utf-8", "replace").removesuffix("\r"), names)
        at = end + 1 + int(fields["Archive-length"])
        if at > len(content):
            raise ValueError("an ARC record is shorter than declared")
        yield start, fields, content[end + 1 : at]


def record_kind(url: str, block: bytes) -> str:
    """The WARC type of an ARC record: its version block describes the archive, what HTTP answered is a response, all else a resource."""
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if block.startswith(b"HTTP/") and not re.match(r"(dns|ftp|gopher|whois):", url, re.I) else "resource"


def warc_date(stamp: str) -> str:
    """An ARC date of 8 to 14 digits; what is missing is the start of the day, hour or minute."""
    d = stamp.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, dict[bytes, bytes], bytes]:
    """Head (with its blank line), header fields by lower-case name, body."""
    head, blank, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:] if b": " in line)
    return head + blank, {k.lower(): v for k, v in fields.items()}, body


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields_of = [c.split() for c in RECORD_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    for batch in batches:
        for content in batch.column(0):
            rows, archive = [], ""
            for offset, fields, block in read_arc(content.as_py()):
                url, kind = fields["URL"], record_kind(fields["URL"], block)
                archive = url if kind == "warcinfo" else archive
                head, named, body = http_parts(block) if kind == "response" else (b"", {}, block)
                key = named.get(KEY_HEADER.lower(), b"")
                digest = base32(hashlib.sha1(body).digest())
                # Named by its place, so records that repeat id and payload differ, and the same archive gives the same names.
                name = uuid.uuid5(NAMESPACE, f"{archive}#{offset}:{digest}")
                kind_of = {"warcinfo": "text/plain", "response": "application/http; msgtype=response"}.get(kind, fields["Content-type"])
                address = fields["IP-address"]
                rows.append((f"<urn:uuid:{name}>", kind, int(key) if re.fullmatch(rb"-?\d+", key) else None, url, address if address not in ("-", "0.0.0.0") else None, warc_date(fields["Archive-date"]), kind_of, digest, len(body), base32(hashlib.sha1(block).digest()), head, block))
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields_of)], [n for n, _ in fields_of])


def convert(archives: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """ARC archives (one binary column) to WARC records: a string column ``record`` of bytes.

    A version block becomes a ``warcinfo``, an HTTP answer a ``response``, anything else, such as
    a DNS answer, a ``resource`` of its declared type; an address that is known is kept. Of
    responses with equal payloads of at least ``least_revisit`` bytes that of the largest key
    stays one; others revisit it, with their HTTP head but no body. The digests of
    payloads that occur more than once, with that key, meet the records by (digest, salt), so
    copies of one payload spread over tasks. Archives are parsed twice, for that table and for the
    records: keeping the parsed records would take more disk than parsing takes time.
    """
    records = archives.mapInArrow(_records, RECORD_SCHEMA)
    kept = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_revisit)).groupBy("payload_digest").agg(F.max(F.struct("key", "record_id")).alias("kept"), F.count(F.lit(1)).alias("n"))
    kept = kept.where("n > 1 and kept.key is not null").select("payload_digest", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(kept, ["payload_digest", "salt"], "left")
    revisit = (F.col("kind") == "response") & (F.col("payload_bytes") >= least_revisit) & F.col("kept").isNotNull() & ~F.col("key").eqNullSafe(F.col("kept.key"))
    block = F.when(revisit, F.col("head")).otherwise(F.col("block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    about = F.col("kind") == "warcinfo"
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        F.when(about, line("WARC-Filename", F.regexp_replace("url", "^filedesc:/*", ""))).otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-IP-Address", F.col("address")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        F.when(~revisit, line("WARC-Block-Digest", F.col("block_digest"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.when(revisit, line("WARC-Refers-To", F.col("kept.record_id"))),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("kept.key").cast("string"))),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(F.encode(head, "utf-8"), block).cast("string").alias("record"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as gzip archives; the separator is the two line ends that close a record."""
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of one archive, by declared lengths."""
    held = io.BytesIO(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    while first := held.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {}
        while (line := held.readline()).strip():
            name, _, value = line.decode("utf-8").strip().partition(": ")
            fields[name] = value
        block = held.read(int(fields["Content-Length"]))
        if len(block) != int(fields["Content-Length"]):
            raise ValueError("a WARC record is shorter than declared")
        yield fields, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["key", "url", "date", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in read_warc(content.as_py()):
                http = fields["WARC-Type"] in ("response", "revisit")
                _, named, body = http_parts(block) if http else (b"", {}, block)
                digest = fields["WARC-Payload-Digest"]
                key, to = named.get(KEY_HEADER.lower()), fields.get("X-Refers-To-Page-Id")
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (base32(hashlib.sha1(body).digest()) != digest or base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]):
                    raise ValueError(f"the digests of record {fields['WARC-Record-ID']} are wrong")
                size = int(named[b"content-length"]) if revisit else len(body)
                url = fields.get("WARC-Target-URI") or f"filedesc://{fields.get('WARC-Filename', '')}"
                bare = base64.b32decode(digest.removeprefix("sha1:")).hex()
                rows.append((key and int(key), url, fields["WARC-Date"], fields["WARC-Record-ID"], fields["WARC-Type"], to and int(to), size, bare, None if revisit else body))
                if len(rows) == 500:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC archives in a folder, those that describe archives as well; declared lengths and digests are verified."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ_SCHEMA)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages through ARC archives and the converter into WARC archives, read back.

    The archives lie in the shared folder. A null html is an empty payload, a null url
    ``urn:none``; a null id never becomes the response of a group with other ids; rows that
    repeat an id and a payload are all responses if theirs is the largest id, each under a name
    of its own. Further columns, whatever their names, are ignored. A page of any length is one
    record; files hold as many records as make ``FILE_BYTES`` of mean length, so one
    that holds many far longer ones is larger by them. No rows: no result.
    """
    rows = pick(pages, key=id_col, url=url_col, html=html_col).withColumn("key", F.col("key").cast("long"))
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    mean = text_bytes(rows, "html") // max(1, rows.count())  # a file is read back as one value
    write_warc(convert(arc_archives(rows)), path, max(1, min(RECORDS_PER_FILE, FILE_BYTES // max(1, mean))))
    return read_archives(pages.sparkSession, path).where("record_type <> 'warcinfo'")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
