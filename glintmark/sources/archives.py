"""Archives as a source of files: split, streamed, and with a row for whatever can't be read.

`spark.read.format("archives").load(folder)` lists the archives below a folder. A zip file is read by several tasks: each takes the members
whose headers lie in its range of the file's bytes, found in the central directory, so the driver sees names and sizes of archives
only. Tar files and single compressed files have no directory and are one stream, each read from front to end by one task. Small archives
share a task. A member is never held whole: its text comes in parts that end with a line, so a task's memory depends on the size
of a part. An archive inside another is read as it streams by; only an inner zip file, which needs its end first, is put by in a task's own temporary file.

Every member gives rows or a reason: `ok` rows with content, `skipped` ones (beyond a limit that was set, nested too deep, a name that leads outside),
and `failed` ones (damaged, protected by a password). One damaged member doesn't keep the others back; after damage in a tar or
compressed stream nothing more can be found, and its row says so. What was read before the damage stays.

Bytes that aren't UTF-8 become U+FFFD. Empty members are one empty row; empty archives give none. Links, devices and folders are no files.
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import lzma
import math
import os
import posixpath
import re
import struct
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .workers import reach

SCHEMA = "path string, archive_path string, part int, first_line long, whole boolean, content string, status string, reason string"
ZIP = re.compile(r"(?i)\.(zip|jar|war|ear|apk|ipa)$")
TAR = re.compile(r"(?i)\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tar\.xz|txz)$")
ONE = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError, NotImplementedError, ValueError, zlib.error, lzma.LZMAError, struct.error)
#: Bytes of an archive for one task, of a part of a member, and of an inner zip file that stays in memory.
SPLIT, PART, KEEP = 64 << 20, 16 << 20, 32 << 20


class Row(NamedTuple):
    path: str
    archive_path: str
    part: int | None
    first_line: int | None
    whole: bool | None
    content: str | None
    status: str = "ok"
    reason: str | None = None


@dataclass
class Limits:
    """Bytes and files that an archive may still give; none by default."""

    bytes: float = math.inf
    files: float = math.inf

    def admit(self, size: int) -> bool:
        if size > self.bytes or self.files < 1:
            return False
        self.bytes, self.files = self.bytes - size, self.files - 1
        return True


class Member(NamedTuple):
    name: str
    size: int | None
    opened: Callable[[], BinaryIO] | None
    problem: str | None = None


def is_archive(name: str) -> bool:
    return bool(ZIP.search(name) or TAR.search(name) or name.lower().endswith(tuple(ONE)))


def leads_outside(name: str) -> bool:
    norm = posixpath.normpath(name.replace("\\", "/"))
    return norm.startswith(("/", "..")) or bool(re.match(r"[A-Za-z]:", norm))


class Header(tarfile.TarInfo):
    """Tells apart the end mark of a tar stream and damage, after which reading stops alike."""

    @classmethod
    def fromtarfile(cls, tar):
        try:
            return super().fromtarfile(tar)
        except tarfile.EOFHeaderError:
            raise
        except tarfile.HeaderError as e:
            tar.damage = f"damaged here, the rest can't be found: {e}"
            raise


def zip_members(source: BinaryIO, span: tuple[int, float]) -> Iterator[Member]:
    with zipfile.ZipFile(source) as z:
        for info in z.infolist():
            if info.is_dir() or not span[0] <= info.header_offset < span[1]:
                continue
            problem = "protected by a password" if info.flag_bits & 1 else None
            yield Member(info.filename, info.file_size, lambda info=info: z.open(info), problem)


def tar_members(source: BinaryIO) -> Iterator[Member]:
    with tarfile.open(fileobj=source, mode="r|*", tarinfo=Header) as t:
        for m in t:
            if m.isfile():
                yield Member(m.name, m.size, lambda m=m: t.extractfile(m))
            t.members = []  # else every header of a long stream is kept
        if damage := getattr(t, "damage", None):
            raise tarfile.ReadError(damage)


def one_member(path: str, source: BinaryIO) -> Iterator[Member]:
    stem, ending = posixpath.splitext(posixpath.basename(path.rpartition("!")[2]))
    yield Member(stem, None, lambda: ONE[ending.lower()](source, "rb"))


class Bounded:
    """A stream that counts against the limits as it is read, for members whose size isn't known before."""

    def __init__(self, stream: BinaryIO, limits: Limits) -> None:
        self.stream, self.limits = stream, limits

    def read(self, n: int = -1) -> bytes:
        got = self.stream.read(n)
        self.limits.bytes -= len(got)
        if self.limits.bytes < 0:
            raise OverLimit("more than the limit set")
        return got


class OverLimit(Exception):
    pass


def texts_of(path: str, archive: str, stream: BinaryIO, part_bytes: float) -> Iterator[Row]:
    """Parts of a member, cut behind line feeds (which go), or anywhere in a line of more than four parts."""
    size = -1 if part_bytes == math.inf else int(part_bytes)
    state, held, line, part = codecs.getincrementaldecoder("utf-8")("replace"), "", 1, 0
    raw = stream.read(size)
    while True:
        more = stream.read(size) if raw and size > 0 else b""
        held += state.decode(raw, not more)
        if not more:
            yield Row(path, archive, part, line, part == 0, held)
            return
        cut = held.rfind("\n")
        if cut >= 0 or len(held) > 4 * part_bytes:
            content, rest = (held[:cut], held[cut + 1 :]) if cut >= 0 else (held, "")
            yield Row(path, archive, part, line, False, content)
            line += content.count("\n") + (cut >= 0)
            held, part = rest, part + 1
        raw = more


def walk(path: str, archive: str, source: BinaryIO, depth: int = 5, limits: Limits | None = None, part_bytes: float = PART, span: tuple[int, float] = (0, math.inf)) -> Iterator[Row]:
    """Rows of an archive's members and of those of archives in it, down to depth; an inner one's members go on behind a `!`."""
    limits = limits or Limits()
    note = lambda at, status, reason: Row(at, archive, None, None, None, None, status, str(reason) or type(reason).__name__)
    try:
        found = zip_members(source, span) if ZIP.search(path) else tar_members(source) if TAR.search(path) else one_member(path, source)
        for m in found:
            at = f"{path}!{m.name}"
            inner = is_archive(m.name)
            if leads_outside(m.name):
                yield note(at, "skipped", "its name leads outside the archive")
            elif m.problem:
                yield note(at, "failed", m.problem)
            elif inner and depth <= 1:
                yield note(at, "skipped", "nested too deep")
            elif not inner and not limits.admit(m.size or 0):
                yield note(at, "skipped", "beyond the limit set")
            else:
                try:
                    with m.opened() as stream:
                        bounded = stream if m.size is not None else Bounded(stream, limits)
                        yield from inside(at, archive, bounded, depth - 1, limits, part_bytes) if inner else texts_of(at, archive, bounded, part_bytes)
                except OverLimit as e:
                    yield note(at, "skipped", e)
                except BROKEN as e:
                    yield note(at, "failed", e)
    except BROKEN as e:
        yield note(path, "failed", e)


def inside(path: str, archive: str, stream: BinaryIO, depth: int, limits: Limits, part_bytes: float) -> Iterator[Row]:
    if not ZIP.search(path):
        yield from walk(path, archive, stream, depth, limits, part_bytes)
        return
    with tempfile.SpooledTemporaryFile(max_size=KEEP) as copy:  # a task's own, gone with it
        while block := stream.read(1 << 20):
            copy.write(block)
        copy.seek(0)
        yield from walk(path, archive, copy, depth, limits, part_bytes)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


@dataclass
class Shares(InputPartition):
    """(archive, its share, number of shares) for one task."""

    of: list[tuple[str, int, int]]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        get = lambda name, default: float(options.get(name, default))
        self.at, self.split, self.part, self.depth = options["path"], int(get("splitBytes", SPLIT)), get("partBytes", PART), int(get("depth", 5))
        self.bytes, self.files = get("mostBytes", math.inf), get("mostFiles", math.inf)

    def partitions(self) -> list[Shares]:
        fs, path = opened(self.at)
        found = fs.get_file_info(path)
        listed = fs.get_file_info(pafs.FileSelector(path, recursive=True)) if found.type == pafs.FileType.Directory else [found]
        out, room = [], 0
        for x in sorted((x for x in listed if x.is_file and is_archive(x.path)), key=lambda x: x.path):
            # Limits count over a whole archive, so such a one isn't split.
            n = math.ceil(x.size / self.split) if ZIP.search(x.path) and self.bytes == self.files == math.inf else 1
            for k in range(max(1, n)):
                size = x.size / max(1, n)
                if size > room or not out:
                    out.append(Shares([]))
                    room = self.split
                out[-1].of.append((x.path, k, max(1, n)))
                room -= size
        return out

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.at)
        rows, size = [], 0
        for path, k, n in partition.of:
            total = fs.get_file_info(path).size
            span = (total * k // n, total * (k + 1) // n if k + 1 < n else math.inf)
            limits = Limits(self.bytes, self.files)
            with fs.open_input_file(path) as source:
                for row in walk(path, path, source, self.depth, limits, self.part, span):
                    if row.status == "failed" and row.path == path and k:
                        continue  # a directory that can't be read is reported once
                    rows.append(row)
                    size += len(row.content or "")
                    if size > self.part or len(rows) >= 1000:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


def batch(rows: list[Row]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())
    return pa.record_batch([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], names=list(Row._fields))


class ArchiveSource(DataSource):
    """Format `archives`. Options: splitBytes, partBytes, depth (5), mostBytes and mostFiles (an archive; none)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read(spark: SparkSession, at: str, **options) -> DataFrame:
    """Members of the archives below at; see SCHEMA. at is a place that all tasks can open (pyarrow's file systems)."""
    reach(spark).dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**options).load(at)


def rows(binary: DataFrame, most_bytes: int | None = None, most_files: int | None = None, depth: int = 5) -> DataFrame:
    """The same of archives that are rows already (path, content): whole members, each in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                at, limits = path.as_py(), Limits(math.inf if most_bytes is None else most_bytes, math.inf if most_files is None else most_files)
                for row in walk(at, at, io.BytesIO(data.as_py() or b""), depth, limits, math.inf):
                    held.append(row)
                    size += len(row.content or "")
                    if size > PART or len(held) >= 1000:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    reach(binary.sparkSession)
    return binary.select("path", "content").mapInArrow(run, SCHEMA)
