"""ZIP archives as a data source: members are read where they lie, a range of bytes each.

Planning reads the central directory at an archive's end, drops members that are not asked for, and puts the others, in order of their
place, into partitions of some ``PART_BYTES``.  A task reads its members' ranges alone, so no task holds an archive, however large it
is, and one archive feeds many tasks.  Stored and deflated members are read; a checksum that is wrong is an error.

Paths may be of local disks and of the stores that Arrow knows (HDFS, S3, GCS); ``supported`` tells.
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, PART_MEMBERS = 64 << 20, 10_000
SCHEMA = "archive string, member string, doc string, too_large boolean"
_LOCAL_HEADER = struct.Struct("<4s22xHH")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else str(Path(path).resolve()))


def supported(path: str) -> bool:
    try:
        opened(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def archives(path: str) -> list[str]:
    """The archive, or those of a folder, as URIs or paths that ``opened`` takes."""
    fs, inside = opened(path)
    found = fs.get_file_info(inside)
    if found.type != pafs.FileType.Directory:
        return [path]
    return sorted(path.rstrip("/") + "/" + i.base_name for i in fs.get_file_info(pafs.FileSelector(inside)) if i.base_name.endswith(".zip"))


class _Seekable:
    """A file for ``zipfile``, which tries places before the beginning and expects an OSError there."""

    def __init__(self, f):
        self.f, self.read, self.tell = f, f.read, f.tell

    def seek(self, at: int, whence: int = 0) -> int:
        if at + (0, self.f.tell(), self.f.size())[whence] < 0:
            raise OSError("before the beginning")
        return self.f.seek(at, whence)

    def seekable(self) -> bool:
        return True


@dataclass
class Members(InputPartition):
    archive: str
    ranges: list[tuple[str, int, int, int, int, int]]  # name, place, bytes, bytes when unpacked, method, checksum


def planned(archive: str, wanted: set[str] | None, suffix: str, limit: int) -> Iterator[Members]:
    """Partitions of an archive's members, from its central directory; those above ``limit`` weigh nothing, as they are not read."""
    fs, inside = opened(archive)
    with fs.open_input_file(inside) as f, zipfile.ZipFile(_Seekable(f)) as z:
        infos = sorted((i for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix) and (wanted is None or i.filename in wanted)), key=lambda i: i.header_offset)
    held, size = [], 0
    for i in infos:
        held.append((i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC))
        size += i.compress_size if i.file_size <= limit else 0
        if size >= PART_BYTES or len(held) >= PART_MEMBERS:
            yield Members(archive, held)
            held, size = [], 0
    if held:
        yield Members(archive, held)


def unpacked(f, name: str, place: int, size: int, whole: int, method: int, checksum: int) -> bytes:
    """A member, from its range of an open file."""
    f.seek(place)
    mark, names, extra = _LOCAL_HEADER.unpack(f.read(_LOCAL_HEADER.size))
    if mark != b"PK\x03\x04":
        raise ValueError(f"{name}: no member at {place}")
    f.seek(place + _LOCAL_HEADER.size + names + extra)
    raw = f.read(size)
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"{name}: compressed by method {method}")
    out = raw if method == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(raw, whole + 1)
    if len(out) != whole or zlib.crc32(out) != checksum:
        raise ValueError(f"{name}: wrong checksum")
    return out


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.need = options["path"], options.get("need")
        self.limit, self.suffix = int(options.get("limit", 1 << 62)), options.get("suffix", ".json")
        self.wanted = set(json.loads(options["members"])) if "members" in options else None

    def partitions(self) -> list[Members]:
        return [m for a in archives(self.path) for m in planned(a, self.wanted, self.suffix, self.limit)]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not isinstance(partition, Members):  # an archive without such members
            return
        fs, inside = opened(partition.archive)
        with fs.open_input_file(inside) as f:
            for member in partition.ranges:
                doc = unpacked(f, *member).decode("utf-8", "replace") if member[3] <= self.limit else None
                if doc is None or self.need is None or self.need in json.loads(doc):
                    yield partition.archive, member[0], doc, doc is None


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option(...).load(path)``; options: members (a JSON list), need, limit, suffix."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def zip_members(spark: SparkSession, path: str, members: list[str] | None = None, need: str | None = None, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    read = spark.read.format("zip_members")
    for name, value in (("members", None if members is None else json.dumps(members)), ("need", need), ("limit", limit)):
        if value is not None:
            read = read.option(name, value)
    return read.load(path)
