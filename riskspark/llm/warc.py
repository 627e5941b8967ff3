"""Legacy archive converter: ARC files to WARC files, and readers of both.

An ARC file begins with a version block (``filedesc://``) whose second line names the version and
whose third names the fields of every record's header line: five in version 1, ten in version 2.
A header line is followed by as many bytes as its last field declares, then a line feed. Each
record becomes a WARC record with a date from the 14-digit time stamp, a type from its content
(``filedesc`` is warcinfo, an HTTP message is response, anything else resource), block and payload
digests, and an identifier derived from address, date and digest, so a repeated conversion gives
the same record. WARC files are members of one gzip record each.

Files go to the shared folder, under a name that their attempt alone uses. The names that an attempt has
written are its task's output, so only those of attempts that succeeded are in the table of files, and
only they are read. A conversion turns one ARC file into one WARC file.

Defined cases: null payloads are empty; null addresses are empty; a truncated record (fewer bytes
than declared) raises an error rather than passing for a short one; empty tables write no files
and read back as no rows; repeated rows are repeated records, of which the last one is the response.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import arrow_fs, keep
from riskspark.session import scratch_path

ROLL_BYTES = 8 << 20
#: of gzip: between size (ARC and WARC files are both on disk) and time
LEVEL = 5
#: fields of a header line (fixed values of the format)
ARC_FIELDS = {"1": "URL IP-address Archive-date Content-type Archive-length",
              "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_DATE = "20240101000000"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Rolling:
    """Writes gzip files of about ROLL_BYTES (one member a record) to a folder of any file system that Arrow opens;
    ``written`` are the addresses of the files and their numbers of records."""

    def __init__(self, folder: str, suffix: str, head: bytes = b"", roll: int | None = ROLL_BYTES) -> None:
        context = TaskContext.get()
        self.mark = f"{context.partitionId():06d}-{context.taskAttemptId()}" if context else "000000-0"
        self.address, self.suffix, self.head, self.roll = folder, suffix, head, roll
        self.fs, self.folder = arrow_fs(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.size, self.records, self.written = None, 0, 0, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.mark}-{uuid.uuid4().hex[:12]}{self.suffix}"
            self.out, self.size, self.records = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0, 0
            if self.head:
                self.out.write(gzip.compress(self.head, LEVEL, mtime=0))
        member = gzip.compress(record, LEVEL, mtime=0)
        self.out.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.roll and self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.written.append((f"{self.address}/{self.name}", self.records))
            self.out = None

    def rows(self) -> pa.RecordBatch:
        """The files that are whole, as rows of FILE_ROWS."""
        out, self.written = self.written, []
        return pa.record_batch({"path": pa.array([p for p, _ in out], pa.string()), "records": pa.array([n for _, n in out], pa.int64())})


FILE_ROWS = "path string, records long"


def _stream(path: str):
    """The uncompressed bytes of a file, as they are read."""
    fs, name = arrow_fs(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=fs.open_input_stream(name, compression=None)), 1 << 16)


def _spread(files: DataFrame) -> DataFrame:
    """A file a row, dealt to all tasks."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def http_message(payload: bytes, content_type: str = "text/html") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def version_block(version: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    tail = "text/plain" + (" 200 - - 0 archive.arc" if version == "2" else "")
    return f"filedesc://archive.arc 0.0.0.0 {ARC_DATE} {tail} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: str, url: str, block: bytes, date: str = ARC_DATE, content_type: str = "text/html") -> bytes:
    between = f" 200 {digest(block)} - 0 archive.arc" if version == "2" else ""
    return f"{quote(url, safe=':/?#[]@!$&()*+,;=%~-._')} 0.0.0.0 {date} {content_type}{between} {len(block)}\n".encode() + block + b"\n"


def write_arc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes rows (url, payload binary) as ARC files; version 1 and 2 by turns of the task number. Returns the files (FILE_ROWS)."""

    def run(batches):
        out = None
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    version = "12"[TaskContext.get().partitionId() % 2]
                    out = Rolling(folder, ".arc.gz", version_block(version))
                out.add(arc_record(version, r["url"] or "", http_message(r["payload"] or b"")))
            if out is not None and out.written:
                yield out.rows()
        if out is not None:
            out.close()
            yield out.rows()

    return keep(pages.select("url", "payload").mapInArrow(run, FILE_ROWS), "arc_files")


def parse_arc(stream) -> Iterator[dict]:
    """Records of an uncompressed ARC stream, its version block first."""
    fields: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\n").split(" ")
        if not fields:  # the version block; its own header has the fields of either version
            body = stream.read(int(parts[-1]))
            version, names = body.decode().split("\n")[:2]
            fields = names.split(" ")
            if names != ARC_FIELDS.get(version.split(" ")[0]):
                raise ValueError(f"unknown ARC version line {version!r}")
            yield {"URL": parts[0], "Archive-date": parts[2], "Content-type": "text/plain", "block": body}
            continue
        if len(parts) != len(fields):
            raise ValueError(f"an ARC header of {len(parts)} fields, {len(fields)} declared: {line[:200]!r}")
        head = dict(zip(fields, parts, strict=True))
        block = stream.read(int(head["Archive-length"]))
        if len(block) != int(head["Archive-length"]):
            raise ValueError(f"a truncated ARC record: {line[:200]!r}")
        yield head | {"block": block}


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(url: str, date: str, kind: str, block: bytes, content_type: str, refers: tuple[str, str] | None = None, place: str = "") -> bytes:
    """One WARC record; ``refers`` (address and date of the response) makes it a revisit of that payload. ``place`` (where
    the record stood) keeps the identifiers of repeated records apart."""
    payload = payload_of(block)
    hashed = digest(payload)
    if refers:
        kind, block = "revisit", block[: len(block) - len(payload)]
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {kind} {hashed} {place}')}>"),
            ("WARC-Date", _iso(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{hashed}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if refers:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", refers[0]), ("WARC-Refers-To-Date", _iso(refers[1]))]
    head += [("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record: {line[:200]!r}")
            continue
        head = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]):
            raise ValueError(f"a truncated WARC record: {head}")
        yield head, block


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``size``."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _read(files: DataFrame, rows_of, fields: str) -> DataFrame:
    """``rows_of`` (path of a file) of every file."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _batches(rows_of(path), schema)

    return _spread(files.select("path")).mapInArrow(run, fields)


ARC_ROWS = "path string, place long, url string, date string, content_type string, block binary"


def read_arc(files: DataFrame) -> DataFrame:
    """(path, place, url, date, content_type, block) of every record of ARC files (a table with their paths), version blocks included."""
    def rows(path):
        for i, r in enumerate(parse_arc(_stream(path))):
            yield path, i, r["URL"], r["Archive-date"], r["Content-type"], r["block"]

    return _read(files, rows, ARC_ROWS)


def index_arc(files: DataFrame) -> DataFrame:
    """(path, place, url, date, size, sum) of every record of ARC files: its payload's length and digest, without the payload."""
    def rows(path):
        for i, r in enumerate(parse_arc(_stream(path))):
            payload = payload_of(r["block"])
            yield path, i, r["URL"], r["Archive-date"], len(payload), digest(payload)

    return _read(files, rows, "path string, place long, url string, date string, size long, sum string")


def convert(files: DataFrame, revisits: DataFrame, folder: str) -> DataFrame:
    """Each ARC file as one WARC file; ``revisits`` (path, place, refers_to_url, refers_to_date) names the records that
    become revisits. Only those names are moved; a task reads its ARC files itself. Returns the files (FILE_ROWS)."""
    named = revisits.groupBy("path").agg(F.collect_list(F.struct("place", "refers_to_url", "refers_to_date")).alias("refers"))  # of one file's records

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                refers = {x["place"]: (x["refers_to_url"], x["refers_to_date"]) for x in r["refers"] or []}
                out, origin = Rolling(folder, ".warc.gz", roll=None), r["path"].rpartition("/")[2]
                for i, a in enumerate(parse_arc(_stream(r["path"]))):
                    http = a["block"].startswith(b"HTTP/")
                    kind = "warcinfo" if a["URL"].startswith("filedesc:") else "response" if http else "resource"
                    out.add(warc_record(a["URL"], a["Archive-date"], kind, a["block"], "application/http; msgtype=response" if http else a["Content-type"],
                                        refers.get(i) if kind == "response" else None, f"{origin} {i}"))
                out.close()
                yield out.rows()

    return keep(_spread(files.select("path").join(named, "path", "left")).mapInArrow(run, FILE_ROWS), "warc_files")


WARC_ROWS = "type string, url string, date string, payload_digest string, payload_bytes long, refers_to_url string, payload binary"


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """(type, url, date, payload_digest, payload_bytes, refers_to_url, payload) of every record of WARC files; the digest
    is recomputed where the payload is there, and must agree with the header."""
    def rows(path):
        for head, block in parse_warc(_stream(path)):
            payload = payload_of(block)
            stated = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            size = len(payload)
            if head["WARC-Type"] == "revisit":
                size = int(next((x.split(b":")[1] for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0"))
            elif digest(payload) != stated:
                raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
            yield head["WARC-Type"], head.get("WARC-Target-URI"), head.get("WARC-Date"), stated, size, head.get("WARC-Refers-To-Target-URI"), payload if payloads else None

    return _read(files, rows, WARC_ROWS)


def _page(column: str):
    return F.regexp_extract(column, r"^urn:page:(-?\d*):", 1).try_cast("long")


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages to ARC files and those to WARC files with revisits of equal payloads; returns the WARC files (FILE_ROWS).

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id (of several: the
    last) is the response, the others revisit it. Rows without page_id are responses of their own."""
    spark = pages.sparkSession
    url = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("url").cast("string"), F.lit("")))
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    arc = write_arc(pages.select(url.alias("url"), payload.alias("payload")), scratch_path(spark, "arc"))
    index = keep(index_arc(arc).withColumn("page", _page("url")).filter((F.col("page").isNotNull()) & (F.col("size") >= least_bytes)), "arc_index")
    last = F.max(F.struct("page", "path", "place", "url", "date")).alias("to")
    newest = index.groupBy("sum", "size").agg(last, F.count(F.lit(1)).alias("n")).filter("n > 1").select("sum", "size", "to")
    revisits = (index.join(newest, ["sum", "size"]).filter((F.col("path") != F.col("to.path")) | (F.col("place") != F.col("to.place")))
                .select("path", "place", F.col("to.url").alias("refers_to_url"), F.col("to.date").alias("refers_to_date")))
    return convert(arc, revisits, scratch_path(spark, "warc"))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``archive``, and the records read back: one row per row of ``pages``."""
    back = read_warc(archive(pages, least_bytes), payloads=False).filter("type != 'warcinfo'")
    return back.select(_page("url").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), _page("refers_to_url").alias("refers_to"),
                       F.regexp_replace("url", r"^urn:page:-?\d*:", "").alias("url"))
