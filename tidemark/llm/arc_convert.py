"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block that says how its header lines are laid out; a record
is a header line whose last field declares the length of what follows. Each record becomes a
WARC record with an identifier, a timestamp, a type and digests made from what ARC has. Of
records with equal payloads one stays a response and the others become revisits of it.

Archives are written and read by one task each, as streams of one record at a time. Between
archives only digests are shuffled; payloads never are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import input_file, output_file, park, scratch_path, slices, tasks_import

#: Fixed values of the formats: fields of a header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ITEM = b"X-Page-Id"


@dataclass
class ArcRecord:
    number: int  # in its file, from 0
    url: str
    ip: str
    date: str  # 14 digits
    content_type: str
    block: bytes
    declared: int

    def payload(self) -> tuple[bytes, bytes]:
        """The header of an HTTP message (empty for anything else) and what follows it."""
        if self.block.startswith(b"HTTP/"):
            end = self.block.find(b"\r\n\r\n")
            if end >= 0:
                return self.block[: end + 4], self.block[end + 4 :]
        return b"", self.block


def arc_bytes(url: str, date: str, block: bytes, version: int, content_type: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    fields = [re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "unknown:", ip, date, content_type]
    if version == 2:
        fields += ["200", "-", "-", "0", "-"]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_head(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 tidemark\n{ARC_FIELDS[version]}\n\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body


def _member(data: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def _stream(path: str) -> io.BufferedReader:
    source = input_file(path)
    packed = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=source) if packed else source, 1 << 20)


def parse_arc(stream: io.BufferedReader) -> Iterator[ArcRecord]:
    """The records of an ARC file, behind its version block.

    The version block fixes the number of fields; a URL may hold blanks, so fields are taken
    from the right. Lines that are no header are skipped. A block that the file ends in is
    given as far as it goes.
    """
    version, number = 0, 0
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if not version and line.startswith(b"filedesc://"):
            body = stream.read(int(line.rsplit(b" ", 1)[-1]))
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        fields = line.rsplit(b" ", len(ARC_FIELDS[version or 1].split()) - 1)
        if len(fields) < 5 or not fields[-1].isdigit() or not re.fullmatch(rb"\d{14}", fields[2]):
            continue
        text = [f.decode("utf-8", "replace") for f in fields]
        declared = int(fields[-1])
        yield ArcRecord(number, text[0], text[1], text[2], text[3], stream.read(declared), declared)
        number += 1


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def to_warc(record: ArcRecord, archive: str, original: dict | None) -> bytes:
    """The WARC record of an ARC record; ``original`` (id, url, date, item) makes it a revisit."""
    head, payload = record.payload()
    http = bool(head)
    kind = "revisit" if original else "response" if http or record.url.startswith("dns:") else "resource"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(archive, record.number)),
        ("WARC-Date", warc_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    block = record.block
    if original:
        block = head
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original["id"])]
        headers += [("WARC-Refers-To-Target-URI", original["url"]), ("WARC-Refers-To-Date", warc_date(original["date"]))]
        if original["item"] is not None:
            headers.append(("X-Refers-To-Item", str(original["item"])))
    if len(record.block) < record.declared:
        headers.append(("WARC-Truncated", "length"))
    headers.append(("WARC-Block-Digest", f"sha1:{digest(block)}"))
    headers.append(("Content-Type", "application/http; msgtype=response" if http else record.content_type))
    return warc_bytes(headers, block)


def parse_warc(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-cased) and block of every record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1") if found else None


def _write_arc(batches, folder: str, date: str, roll: int):
    part = TaskContext.get().partitionId()
    version, target, path, n, size = 1 + part % 2, None, None, 0, 0
    schema = pa.schema([("archive", pa.string()), ("n_records", pa.int64())])
    for batch in slices(batches, 256):
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
            if target is None:
                path, target = output_file(folder, f"pages-{part:06d}.arc.gz")
                target.write(_member(arc_head(path.rsplit("/", 1)[-1], date, version)))
                n = size = 0
            payload = (html or "").encode("utf-8", "surrogatepass")
            head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
            if page_id is not None:
                head += ITEM + b": %d\r\n" % page_id
            data = _member(arc_bytes(url or "", date, head + b"\r\n" + payload, version))
            target.write(data)
            n, size = n + 1, size + len(data)
            if size >= roll:
                target.close()
                yield pa.RecordBatch.from_pylist([{"archive": path, "n_records": n}], schema)
                target = None
    if target is not None:
        target.close()
        yield pa.RecordBatch.from_pylist([{"archive": path, "n_records": n}], schema)


def write_arc(pages: DataFrame, date: str = "20000101000000", roll: int = 256 << 20) -> DataFrame:
    """Pages (page_id, url, html) as ARC files of both versions, one HTTP response each; a null
    html is empty. A file ends when it has ``roll`` bytes. Returns archive, n_records."""
    spark = pages.sparkSession
    tasks_import(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    folder = scratch_path(spark, "arc")
    return park(rows.mapInArrow(partial(_write_arc, folder=folder, date=date, roll=roll), "archive string, n_records long"), "arc-files")


RECORDS = "archive string, number long, url string, date string, item long, n_bytes long, digest string"


def _survey(batches):
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            rows = []
            with _stream(archive) as stream:
                for record in parse_arc(stream):
                    head, payload = record.payload()
                    item = http_field(head, ITEM)
                    rows.append((archive, record.number, record.url, record.date, int(item) if item else None, len(payload), digest(payload)))
                    if len(rows) == 5000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def survey(archives: DataFrame) -> DataFrame:
    """One row per record of the ARC files (column archive): its place, url, date, item and payload digest."""
    tasks_import(archives.sparkSession)
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(_survey, RECORDS)


def find_revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """Records whose payload another record has too and that are not its response: archive, number, and
    the response's place, url, date and item. The response is the one with the highest item, then place.

    Equal payloads may be a third of all records. Each (digest, salt) is reduced to its highest
    record in the map tasks, then each digest; the answer goes back to the salts, so that no
    task joins all records of a digest.
    """
    place = F.struct("item", "archive", "number", "url", "date")
    salted = records.filter(F.col("n_bytes") >= least).withColumn("salt", F.pmod(F.xxhash64("archive", "number"), F.lit(64)))
    by_salt = salted.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.max(place).alias("top"))
    by_digest = by_salt.groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top")).filter("n > 1")
    answers = by_salt.select("digest", "salt").join(by_digest.select("digest", "top"), "digest")
    joined = salted.join(answers, ["digest", "salt"])
    return joined.filter("archive <> top.archive or number <> top.number").select("archive", "number", F.col("top"))


def _convert(left: pa.Table, right: pa.Table, folder: str) -> pa.Table:
    schema = pa.schema([("warc", pa.string()), ("n_records", pa.int64()), ("n_revisits", pa.int64())])
    if not left.num_rows:
        return schema.empty_table()
    archive = left.column("archive")[0].as_py()
    originals = dict(zip(right.column("number").to_pylist(), right.column("top").to_pylist()))
    path, target = output_file(folder, archive.rsplit("/", 1)[-1].replace(".arc", ".warc"))
    n = revisits = 0
    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, -1)), ("WARC-Date", "2000-01-01T00:00:00Z")]
    target.write(_member(warc_bytes([*info, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")))
    with _stream(archive) as stream:
        for record in parse_arc(stream):
            top = originals.get(record.number)
            original = top and {"id": record_id(top["archive"], top["number"]), "url": top["url"], "date": top["date"], "item": top["item"]}
            target.write(_member(to_warc(record, archive, original)))
            n, revisits = n + 1, revisits + bool(original)
    target.close()
    return pa.Table.from_pylist([{"warc": path, "n_records": n, "n_revisits": revisits}], schema)


def convert(archives: DataFrame, records: DataFrame, least: int = 0) -> DataFrame:
    """Write a WARC file for each ARC file; returns warc, n_records, n_revisits.

    ``records`` is the archives' survey, as a table. Payloads smaller than ``least`` are never
    revisits. A task gets one archive and the places of its revisits."""
    spark = archives.sparkSession
    tasks_import(spark)
    revisits = find_revisits(records, least)
    folder = scratch_path(spark, "warc")
    # as many partitions as archives, which small rows must not be merged into fewer
    n = max(1, archives.count())
    left, right = archives.select("archive").repartition(n, "archive"), revisits.repartition(n, "archive")
    written = left.groupBy("archive").cogroup(right.groupBy("archive")).applyInArrow(
        partial(_convert, folder=folder), "warc string, n_records long, n_revisits long"
    )
    return park(written, "warc-files")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = []
            with _stream(path) as stream:
                for fields, block in parse_warc(stream):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = ArcRecord(0, "", "", "", "", block, 0).payload()
                    stated = fields["warc-payload-digest"].partition(":")[2]
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and digest(payload) != stated:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                    size = int(http_field(head, b"Content-Length") or 0) if revisit else len(payload)
                    item, refers = http_field(head, ITEM), fields.get("x-refers-to-item")
                    rows.append((int(item) if item else None, size, stated, fields["warc-type"], int(refers) if refers else None, fields["warc-target-uri"]))
                    if len(rows) == 5000:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(warcs: DataFrame) -> DataFrame:
    """One row per record of the WARC files (column warc), its digest checked against its payload."""
    tasks_import(warcs.sparkSession)
    return warcs.select("warc").repartition(max(1, warcs.count())).mapInArrow(_read, READ)
