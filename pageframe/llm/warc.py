"""WARC archives: a writer with revisit records, and a Python data source that reads them back.

The reader plans partitions of whole files, takes equality filters on the record type
and on headers, and parses the headers of a record before anything else: if the
filters turn it down, or payloads are not asked for, its block is passed over (plain
files) or inflated without being kept (one gzip member per record).
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from pageframe.llm.store import located, sliced, written
from pageframe.session import fresh_path

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, http_length long, payload binary, file string"
#: Fixed values of the format: column of the reader, header that holds it.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHUNK = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, compress: bool) -> bytes:
    """One record. `first` is the page of the response that a revisit stands for."""
    revisit = first is not None
    target = "".join(c if c.isprintable() else "%20" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{first}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, compress: bool = True, html: str = "html", file_bytes: int = 1 << 26) -> DataFrame:
    """Write one record a row to archives in `folder`; (file, records) of the archives that belong to the result.

    Rows with equal payloads of at least `least_bytes` bytes: the one with the smallest page_id is a response, the others
    revisit it. A null html is an empty payload. Rows that repeat a page_id and its payload are alike; a row without
    page_id revisits unless no row of its payload has one. A task that is run again writes under new names.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("sha1").agg(F.min("page_id").alias("first"))
    joined = rows.join(firsts, "sha1").select("page_id", "url", "payload", "sha1", "first")
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = located(folder)
        system.create_dir(root, recursive=True)
        names, counts, out, size = [], [], None, 0
        for batch in sliced(batches, 200):
            for page_id, url, body, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}{suffix}")
                    counts.append(0)
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                again = first if len(body) >= least_bytes and first is not None and first != page_id else None
                data = record(page_id, url, body, base64.b32encode(sha1).decode(), again, compress)
                out.write(data)
                counts[-1] += 1
                size += len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64())], ["file", "records"])

    return written(joined.mapInArrow(run, "file string, records long"), "archives")


class _Source:
    """Bytes of an archive in order, from plain text or from gzip members."""

    def __init__(self, stream, gzip: bool) -> None:
        self.stream, self.gzip, self.held = stream, gzip, b""
        self.inflater = zlib.decompressobj(31) if gzip else None

    def more(self) -> bool:
        while True:
            if self.gzip and self.inflater.eof:
                raw = self.inflater.unused_data or self.stream.read(CHUNK)
                if not raw:
                    return False
                self.inflater = zlib.decompressobj(31)
            else:
                raw = self.stream.read(CHUNK)
                if not raw:
                    return False
            data = self.inflater.decompress(raw) if self.gzip else raw
            if data:
                self.held += data
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before `mark`, which is taken too; None at the end of the archive."""
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        head, self.held = self.held[:at], self.held[at + len(mark) :]
        return head

    def take(self, size: int) -> bytes:
        parts, left = [], size
        while left:
            if not self.held and not self.more():
                break
            parts.append(self.held[:left])
            self.held = self.held[left:]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, size: int) -> None:
        if not self.gzip and size > len(self.held):
            self.stream.seek(self.stream.tell() + size - len(self.held))
            self.held = b""
            return
        while size:
            if not self.held and not self.more():
                return
            step = min(size, len(self.held))
            self.held, size = self.held[step:], size - step


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def records(stream, gzip: bool, wanted: list[tuple[str, str]], payloads: bool, file: str) -> Iterator[tuple]:
    source = _Source(stream, gzip)
    while (head := source.until(b"\r\n\r\n")) is not None:
        headers = fields(head)
        size = int(headers.get("content-length", 0))
        if any(headers.get(HEADERS[column].lower()) != value for column, value in wanted):
            source.skip(size + 4)
            continue
        http = source.until(b"\r\n\r\n") if size else b""
        rest = size - len(http) - 4 if size else 0
        body = source.take(rest) if payloads else source.skip(rest)
        source.skip(4)
        values = [headers.get(name.lower()) for name in HEADERS.values()]
        yield (*values, int(fields(http).get("content-length", rest)), body, file)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"]
        self.payloads = options.get("payloads", "true") == "true"
        self.partition_bytes = int(options.get("partitionbytes", 1 << 25))
        self.wanted: list[tuple[str, str]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.wanted.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in order of name, packed up to `partitionBytes`."""
        system, root = located(self.folder)
        found = [i for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if ".warc" in i.base_name]
        groups: list[list[str]] = []
        size = self.partition_bytes
        for info in sorted(found, key=lambda i: i.base_name):
            if size + info.size > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(info.base_name)
            size += info.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = located(self.folder)
        for name in partition.names if partition else ():
            gzip = name.endswith(".gz")
            with system.open_input_file(f"{root}/{name}") as stream:
                yield from records(stream, gzip, self.wanted, self.payloads, name)


class WarcSource(DataSource):
    """`spark.read.format("warc").option("payloads", ...).load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(folder)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 of bytes in upper-case base32: five hex digits are four letters."""
    digits = F.sha1(data)
    group = lambda i: F.conv(F.substring(digits, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
    power = lambda i: F.element_at(F.array(*[F.lit(1 << 5 * k) for k in (3, 2, 1, 0)]), i % 4 + 1)
    letter = lambda i: F.substring(F.lit(BASE32), F.floor(group(i) / power(i)).cast("int").bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def read_back(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives in `files`.

    Responses are read with their payloads, of which length and digest are taken; of revisits, which hold none, the headers
    say both. Each read pushes its record type down, so it skips the other's records.
    """

    def page(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, 'urn:x-page:(-?[0-9]+)>', 1) AS bigint)")

    def of(kind: str, payloads: bool, size: Column, digest: Column) -> DataFrame:
        # archives of task attempts that did not count are in the folder too, but not in the list
        found = read_archives(spark, folder, payloads).where(F.col("record_type") == kind).join(files, "file", "left_semi")
        return found.select(page("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))

    responses = of("response", True, F.length("payload"), base32_sha1(F.col("payload")))
    return responses.unionByName(of("revisit", False, F.col("http_length"), F.expr("substring(payload_digest, 6)")))


def archived(pages: DataFrame, least_bytes: int = 0, compress: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): write the archives and read them back.

    Nulls, repeated rows and rows without page_id are treated as in `write_archives`. Very long payloads are whole.
    Other columns are ignored; an empty table gives no archive and no row.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder, least_bytes, compress).select("file")
    return read_back(pages.sparkSession, folder, files)
