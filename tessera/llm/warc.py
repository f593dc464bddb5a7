"""WARC archives as a PySpark data source.

Reading plans one partition per run of files, pushes predicates on the record type and on header
columns into the scan, parses a record's headers first, and skips the payloads of records that no
predicate wants without inflating them: archives written here carry the length of each gzip member
in its extra field ``sl``. Other ``.warc.gz`` and plain ``.warc`` files are read in order.

Writing makes one file per task under ``_temporary`` and moves the files of successful attempts in
place when the job commits, so that lost executors and repeated tasks leave nothing behind.

Defined results: null payloads are empty; null headers are not written; line breaks in header
values become blanks; an empty table gives an empty archive; repeated rows are records each, and of
rows with one id and unlike payloads none is lost; payloads of any length are streamed to the file
that holds them; of the input only id, URL and payload are read, so no other column clashes.
"""

from __future__ import annotations

import gzip
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
    IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..session import remove, shared_dir, stored
from .bounded import small_side

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary"
#: Header of each column that predicates can be pushed on.
HEADER = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payload bytes of one batch of rows, and of the files of one partition (a larger file has its own).
BATCH_BYTES, SPLIT_BYTES = 8 << 20, 128 << 20
_BRACKETED = ("warc-record-id", "warc-refers-to", "warc-concurrent-to")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path."""
    if re.match(r"[a-zA-Z][\w+.-]+:/", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member that tells its own length, and that of the data, in its extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out.setdefault(name, value[1:-1] if name in _BRACKETED and value[:1] == "<" and value[-1:] == ">" else value)
    return out


def _wants(filters: list[Filter], headers: dict[str, str]) -> bool:
    for f in filters:
        have = headers.get(HEADER[f.attribute[0]])
        if isinstance(f, IsNotNull):
            ok = have is not None
        elif isinstance(f, EqualNullSafe):
            ok = have == f.value
        elif have is None:
            ok = False
        elif isinstance(f, EqualTo):
            ok = have == f.value
        elif isinstance(f, In):
            ok = have in f.value
        elif isinstance(f, StringStartsWith):
            ok = have.startswith(f.value)
        elif isinstance(f, StringEndsWith):
            ok = have.endswith(f.value)
        else:
            ok = f.value in have
        if not ok:
            return False
    return True


def _plain_records(stream, filters: list[Filter]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an open file without own lengths; unwanted blocks are skipped, not kept."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        head = [line.rstrip(b"\r\n")]
        while (line := stream.readline()).strip():
            head.append(line.rstrip(b"\r\n"))
        headers = parse_headers(b"\r\n".join(head))
        n = int(headers.get("content-length", "0"))
        if _wants(filters, headers):
            yield headers, stream.read(n)
        else:
            stream.seek(n, 1)


def _member_records(file, filters: list[Filter]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file whose members tell their lengths."""
    at = 0
    while True:
        file.seek(at)
        fixed = file.read(24)
        if len(fixed) < 24:
            return
        length, size = struct.unpack("<II", fixed[16:24])
        inflate = zlib.decompressobj(-15)
        first = file.read(min(4096, length - 24))
        data = inflate.decompress(first, 8192)
        while b"\r\n\r\n" not in data and not inflate.eof and (more := inflate.unconsumed_tail or file.read(4096)):
            data += inflate.decompress(more, 8192)
        head, _, block = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        if _wants(filters, headers):
            rest = inflate.unconsumed_tail + file.read(max(0, at + length - 8 - file.tell()))
            block += inflate.decompress(rest) if not inflate.eof else b""
            yield headers, block[: int(headers.get("content-length", "0"))]
        at += length


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """The content without its HTTP head, if it has one."""
    if block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)
        for f in filters:
            if isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, at = open_store(self.path)
        info = store.get_file_info(at)
        if info.type == pafs.FileType.Directory:
            found = store.get_file_info(pafs.FileSelector(at, recursive=True))
            files = [x for x in found if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) and "/_temporary/" not in x.path]
        else:
            files = [info]
        out: list[Files] = []
        room = 0
        for x in sorted(files, key=lambda x: x.path):
            if not out or x.size > room:
                out.append(Files([]))
                room = SPLIT_BYTES
            out[-1].paths.append(x.path)
            room -= x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in HEADER), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        rows: list[list] = []
        held = 0
        store, _ = open_store(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as file:
                start = file.read(24)
                file.seek(0)
                if start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl":
                    records = _member_records(file, self.filters)
                elif start[:2] == b"\x1f\x8b":
                    records = _plain_records(gzip.GzipFile(fileobj=file), self.filters)
                else:
                    records = _plain_records(io.BufferedReader(file), self.filters)
                for headers, block in records:
                    payload = _payload(headers, block) if self.payload else None
                    rows.append([*(headers.get(h) for h in HEADER.values()), int(headers.get("content-length", "0")), list(headers.items()), payload])
                    held += len(block) + 1000
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _clear(self) -> None:
        store, at = open_store(self.path)
        if store.get_file_info(f"{at}/_temporary/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary/{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = open_store(self.path)
        name, sink = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            if sink is None:
                store.create_dir(f"{at}/_temporary/{self.job}", recursive=True)
                sink = store.open_output_stream(f"{at}/_temporary/{self.job}/{name}", compression=None)
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in columns.items()}
                more = dict(row.get("headers") or [])
                named = {h: row.get(c) for c, h in HEADER.items()}
                for h in _BRACKETED[:2]:
                    named[h] = None if named[h] is None else f"<{named[h]}>"
                block = HTTP + (row.get("payload") or b"")
                sink.write(member(record_bytes([*named.items(), ("content-type", "application/http; msgtype=response"), *sorted(more.items())], block)))
        if sink is not None:
            sink.close()
        return Written(name if sink is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.path)
        store.create_dir(at, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(pafs.FileSelector(at)):
                if x.is_file:
                    store.delete_file(x.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{at}/_temporary/{self.job}/{m.name}", f"{at}/{m.name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Payloads below so many bytes are stored again instead of referred to.
MIN_REVISIT = 100
#: Revisits are broadcast up to so many.
BROADCAST_REVISITS = 1_000_000
URN = "urn:page:"


def _record_id(page_id: Column, digest: Column) -> Column:
    """Pages are told apart by id and payload, as ids may repeat."""
    return F.concat(F.lit(URN), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.substring(digest, 1, 16))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One WARC record per page; of equal payloads the page of smallest id is the response, others revisit it.

    Pages without an id are responses; of pages with one id each refers by its own payload.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    read = read.withColumn("digest", F.sha2("payload", 256))
    narrow = stored(read.filter((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    again = narrow.join(small_side(firsts, BROADCAST_REVISITS), "digest").filter("page_id <> first").distinct()
    placed = read.join(small_side(again, BROADCAST_REVISITS), ["page_id", "digest"], "left")
    new = F.col("first").isNull()
    return placed.select(
        F.when(new, "response").otherwise("revisit").alias("warc_type"),
        _record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.when(~new, _record_id(F.col("first"), F.col("digest"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.when(new, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages as archives and returns what is read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Two scans with a pushed predicate on the record type read them: one of the responses, with their
    payloads, and one of the revisits, of headers only. What a revisit stands for is taken from the
    response that it refers to. Without a ``path`` the archives are deleted once they have been read.
    """
    spark = pages.sparkSession
    register(spark)
    to = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    records(pages).write.format("warc").mode("append").save(to)
    number = lambda c: F.element_at(F.split(c, ":"), 3).try_cast("long")
    of = lambda kind, payload: spark.read.format("warc").option("payload", payload).load(to).filter(F.col("warc_type") == kind)
    new = of("response", "true").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    new = stored(new)
    again = stored(of("revisit", "false").select("record_id", "refers_to"))
    told = new.join(small_side(again.select(F.col("refers_to").alias("record_id")).distinct(), BROADCAST_REVISITS), "record_id", "left_semi").distinct()
    told = told.withColumnRenamed("record_id", "refers_to")
    again = again.join(small_side(told, BROADCAST_REVISITS), "refers_to", "left").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), number("refers_to").alias("refers_to")
    )
    new = new.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    if path is None:
        remove(spark, to)
    return new.unionByName(again)
