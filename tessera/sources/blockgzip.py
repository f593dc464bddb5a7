"""Lines of block-gzip files as a PySpark data source that splits files.

Such a file is a row of gzip members of at most 64 KB, each with its own length in the extra field
``BC``. A partition is a range of compressed bytes. It owns the members that begin in its range; the
first one is found by its header, its length (another header or the end of the file follows) and its
checksum. Of the owned text a partition drops what stands before the first line break, unless it is
the first of its file, and reads on to the end of the line in progress, or for one line more if it
ends with a line break; so each line is read once, wherever ranges and members are cut.

Plain text is split by bytes in the same way; other gzip files are one partition each. Lines come
without their line break (``\\n`` or ``\\r\\n``); the last line needs none; bytes that are no UTF-8 are
replaced; an empty file has no lines; a damaged member is an error.

Writing makes one file per task, moved in place when the job commits.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Compressed bytes of a partition, text of a batch of lines, bytes read at once, text of a written member.
SPLIT_BYTES, BATCH_BYTES, READ_BYTES, MEMBER_TEXT = 32 << 20, 4 << 20, 1 << 20, 65280
_LARGEST = 1 << 16
_MAGIC = b"\x1f\x8b\x08\x04"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or a local path."""
    if re.match(r"[a-zA-Z][\w+.-]+:/", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def member(text: bytes, level: int = 6) -> bytes:
    """One gzip member that carries its length; of no text, the mark of the end."""
    squeezed = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeezed.compress(text) + squeezed.flush()
    if len(body) + 26 > _LARGEST:  # text that doesn't get smaller
        squeezed = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = squeezed.compress(text) + squeezed.flush()
    head = _MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def member_size(head: bytes) -> tuple[int, int] | None:
    """Length of the member and of its header, if ``head`` begins one that carries its length."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1, end
        at += 4 + size
    return None


def inflate(data: bytes, head: int) -> bytes | None:
    """The text of a whole member, or None if it is damaged."""
    crc, size = struct.unpack("<II", data[-8:])
    try:
        text = zlib.decompress(data[head:-8], -15, size or 1)
    except zlib.error:
        return None
    return text if len(text) == size and zlib.crc32(text) == crc else None


class Window:
    """Reads on in a file by large steps; bytes that are passed are let go."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.begin, self.held = file, at, b""
        file.seek(at)

    def take(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on; fewer at the end of the file."""
        if at - self.begin > READ_BYTES:
            self.held, self.begin = self.held[at - self.begin :], at
        while len(self.held) < at - self.begin + n:
            more = self.file.read(max(READ_BYTES, n))
            if not more:
                break
            self.held += more
        return self.held[at - self.begin : at - self.begin + n]


def first_member(window: Window, start: int, end: int) -> int | None:
    """Where the first member at or after ``start`` and before ``end`` begins."""
    at = start
    while at < end:
        part = window.take(at, 2 * _LARGEST)
        hit = part.find(_MAGIC)
        if hit < 0:
            if len(part) < 2 * _LARGEST:
                return None
            at += len(part) - len(_MAGIC) + 1
            continue
        at += hit
        found = member_size(window.take(at, 512)) if at < end else None
        if found:
            data = window.take(at, found[0] + 512)
            after = data[found[0] :]
            if len(data) >= found[0] and (not after or member_size(after)) and inflate(data[: found[0]], found[1]) is not None:
                return at
        at += 1
    return None


def _members(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Members from the first one in the range on, as far as they are asked for: offset and text."""
    window = Window(file, start)
    at = first_member(window, start, end) if start else 0
    while at is not None:
        found = member_size(window.take(at, 512))
        if found is None:
            if window.take(at, 1):
                raise ValueError(f"no block-gzip member at byte {at}")
            return
        text = inflate(window.take(at, found[0]), found[1])
        if text is None:
            raise ValueError(f"a damaged member at byte {at}")
        yield at, text
        at += found[0]


def _bytes(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The same of plain text: pieces, none of them across the end of the range."""
    file.seek(start)
    at = start
    while data := file.read(min(READ_BYTES, end - at) if at < end else 1 << 14):
        yield at, data
        at += len(data)


def _stream(file: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """The same of any other gzip file, whole."""
    squeezed, at = zlib.decompressobj(31), 0
    while data := file.read(READ_BYTES):
        while data:
            text = squeezed.decompress(data)
            yield at, text
            at += len(text)
            data = squeezed.unused_data if squeezed.eof else b""
            if squeezed.eof:
                squeezed = zlib.decompressobj(31)


def whole_lines(pieces: Iterable[tuple[int, bytes]], first: bool, end: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Text in whole lines: those that begin in pieces before ``end``, or right after them.

    With each text come the pieces that it is made of: place in the text, the piece's own place, and
    how far into the piece it begins.
    """
    held, places, size, skip = [], [], 0, not first
    for at, text in pieces:
        into = 0
        if at >= end:
            if skip:
                return
            cut = text.find(b"\n")
            places.append((size, at, 0))
            held.append(text if cut < 0 else text[: cut + 1])
            size += len(held[-1])
            if cut >= 0:
                break
            continue
        if skip:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skip, into = text[cut + 1 :], False, cut + 1
        places.append((size, at, into))
        held.append(text)
        size += len(text)
        if size >= BATCH_BYTES:
            joined = b"".join(held)
            cut = joined.rfind(b"\n") + 1
            if cut:
                yield joined[:cut], places
                # The rest lies in the last piece or pieces.
                last = max(k for k, (x, _, _) in enumerate(places) if x <= cut)
                x, y, into = places[last]
                places = [(0, y, into + cut - x)] + [(x - cut, y, z) for x, y, z in places[last + 1 :]]
            held, size = [joined[cut:]], len(joined) - cut
    if rest := b"".join(held):
        yield rest, places


def line_places(text: bytes, places: list[tuple[int, int, int]], scale: int) -> np.ndarray:
    """Where each line begins: its piece's place times ``scale`` and how far into the piece."""
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1])
    starts = starts[: len(starts) - text.endswith(b"\n")]
    begin, at, into = (np.array(c, np.int64) for c in zip(*places, strict=True))
    k = np.searchsorted(begin, starts, side="right") - 1
    return at[k] * scale + into[k] + starts - begin[k]


def lines_array(text: bytes) -> pa.Array:
    """The lines of a text as strings."""
    if not text.endswith(b"\n"):
        text += b"\n"
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)])
    try:
        lines.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace").removesuffix("\r") for x in text[:-1].split(b"\n")], pa.string())
    cut = pc.utf8_rtrim(lines, "\n")
    return pc.replace_substring_regex(cut, r"\r$", "") if b"\r" in text else cut


def kind_of(store: pafs.FileSystem, at: str) -> str:
    """``blocks``, ``gzip`` or ``plain``, by a file's first bytes."""
    with store.open_input_file(at) as file:
        head = file.read(512)
    return "blocks" if member_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


def listed(path: str) -> list[tuple[str, int]]:
    """Data files of a folder, or the file itself, with their sizes; hidden names are left out."""
    store, at = open_store(path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.Directory:
        found = [x for x in store.get_file_info(pafs.FileSelector(at)) if x.is_file and x.base_name[0] not in "._"]
    elif info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    else:
        found = [info]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + x.path, x.size) for x in found)


def blocked(path: str) -> list[str]:
    """The block-gzip files of a path; none in a store that only Spark opens."""
    try:
        return [f for f, _ in listed(path) if kind_of(*open_store(f)) == "blocks"]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return []


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, str, int, int]]


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = max(1, int(options.get("splitbytes", SPLIT_BYTES)))

    def partitions(self) -> list[Ranges]:
        out: list[Ranges] = []
        room = 0
        for path in self.paths:
            for file, size in listed(path):
                kind = kind_of(*open_store(file))
                step = max(1, size) if kind == "gzip" else self.split
                for a in range(0, size, step):
                    b = min(a + step, size)
                    if not out or b - a > room:
                        out.append(Ranges([]))
                        room = self.split
                    out[-1].parts.append((file, kind, a, b))
                    room -= b - a
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, kind, a, b in partition.parts:
            store, at = open_store(path)
            name = path.rsplit("/", 1)[-1]
            with store.open_input_file(at) as file:
                pieces = _members(file, a, b) if kind == "blocks" else _bytes(file, a, b) if kind == "plain" else _stream(file)
                for text, places in whole_lines(pieces, a == 0, b if kind != "gzip" else 1 << 62):
                    lines, at = lines_array(text), line_places(text, places, _LARGEST if kind == "blocks" else 1)
                    yield pa.RecordBatch.from_arrays([lines, pa.array([name] * len(lines), pa.string()), pa.array(at, pa.int64())], ["value", "file", "at"])


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.suffix = options.get("suffix", ".txt.gz")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = open_store(self.path)
        name, sink, held = f"part-{uuid.uuid4().hex}{self.suffix}", None, b""
        for batch in iterator:
            if sink is None:
                store.create_dir(f"{at}/_temporary/{self.job}", recursive=True)
                sink = store.open_output_stream(f"{at}/_temporary/{self.job}/{name}", compression=None)
            lines = batch.column(batch.schema.get_field_index("value")).drop_null()
            held += b"".join([x.as_buffer().to_pybytes() + b"\n" for x in lines])
            whole = len(held) - len(held) % MEMBER_TEXT
            for k in range(0, whole, MEMBER_TEXT):
                sink.write(member(held[k : k + MEMBER_TEXT]))
            held = held[whole:]
        if sink is None:
            return Written(None)
        if held:
            sink.write(member(held))
        sink.write(member(b""))
        sink.close()
        return Written(name)

    def _clear(self, store: pafs.FileSystem, at: str) -> None:
        if store.get_file_info(f"{at}/_temporary").type == pafs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary")

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
        self._clear(store, at)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*open_store(self.path))


class BlockGzip(DataSource):
    """``spark.read.format("blockgzip").load(path)``: value, file, at. Option ``splitBytes``; ``paths`` takes a JSON list.

    ``at`` grows along a file: the byte of a line, or its member's byte times 2^16 and the byte within.
    """

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def schema(self) -> str:
        return "value string, file string, at long"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        return LineWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_lines(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``value, file, at``: the lines of block-gzip, gzip and plain files, with the name of their file and their place."""
    spark.dataSource.register(BlockGzip)
    given = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("blockgzip").option("paths", json.dumps(given)).option("splitBytes", split_bytes).load()


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite", suffix: str = ".txt.gz") -> None:
    """Column ``value`` as block-gzip files, one for each task; null values are left out."""
    lines.sparkSession.dataSource.register(BlockGzip)
    lines.select("value").write.format("blockgzip").option("suffix", suffix).mode(mode).save(path)
