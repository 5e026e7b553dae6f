"""Alignment archives (tar, tar.gz) as a Spark data source, and a sink that writes them.

The driver reads member headers only, and plans byte ranges from them; a task
reads of each member in its range the mask and the query, not its body. What is
wanted is chosen by query hash on that index, and only then are bodies read, by
their byte range, task by task. A compressed archive can't be cut: it is one
range, and its bodies are read in the pass that finds them.
"""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members that one task reads the heads of; bytes read of a member at a time.
RANGE_BYTES, HEAD = 64 << 20, 1 << 16
#: Endings of archives, and of the members that are read.
ARCHIVES, MEMBER = (".tar", ".tar.gz", ".tgz"), ".a3m"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it of a URI or a local path."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[5:]
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _archives(path: str) -> list[str]:
    """Archives under a folder, or the one archive."""
    system, inner = _opened(path)
    if system.get_file_info(inner).type == pafs.FileType.File:
        return [path]
    found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted(f"{path.rstrip('/')}{f.path[len(inner.rstrip('/')) :]}" for f in found if f.type == pafs.FileType.File and f.path.endswith(ARCHIVES))


def _wanted_member(member: tarfile.TarInfo) -> bool:
    """Alignment files; one that is compressed once more is an error."""
    if member.isfile() and member.name.endswith(MEMBER + ".gz"):
        raise ValueError(f"compressed member in an archive: {member.name}")
    return member.isfile() and member.name.endswith(MEMBER)


def head_of(name: str, lines: Iterator[bytes]) -> tuple[str, str]:
    """Mask and query, the first two records; other names or unequal lengths are an error."""
    records: list[list[str]] = []
    for line in lines:
        text = line.decode("ascii").strip()
        if text.startswith(">"):
            if len(records) == 2:
                break
            records.append([text[1:].split()[0] if text[1:].split() else "", ""])
        elif text and records:
            records[-1][1] += text
    if [r[0] for r in records] != ["mask", "query"]:
        raise ValueError(f"mask and query don't come first in {name}")
    if len(records[0][1]) != len(records[1][1]):
        raise ValueError(f"mask and query differ in length in {name}")
    return records[0][1], records[1][1]


@dataclass
class Range(InputPartition):
    """Members (name, offset of the data, size) of an archive; none listed: the whole compressed archive."""

    archive: str
    members: list[tuple[str, int, int]] | None


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        out = []
        for archive in _archives(self.path):
            if not archive.endswith(".tar"):
                out.append(Range(archive, None))
                continue
            system, inner = _opened(archive)
            ranges: list[list[tuple[str, int, int]]] = [[]]
            size = 0
            with system.open_input_file(inner) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                for member in tar:  # seeks from header to header
                    tar.members = []
                    if _wanted_member(member):
                        if ranges[-1] and size + member.size > RANGE_BYTES:
                            ranges.append([])
                            size = 0
                        ranges[-1].append((member.name, member.offset_data, member.size))
                        size += member.size
            out += [Range(archive, r) for r in ranges if r]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, inner = _opened(partition.archive)
        if partition.members is None:
            with system.open_input_stream(inner, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
                for member in tar:
                    tar.members = []
                    if _wanted_member(member):
                        body = tar.extractfile(member).read()
                        mask, query = head_of(member.name, iter(io.BytesIO(body)))
                        yield partition.archive, member.name, None, member.size, mask, query, hashlib.sha256(query.encode()).hexdigest(), body
            return
        with system.open_input_file(inner) as raw:
            for name, offset, size in partition.members:
                mask, query = head_of(name, self._lines(raw, offset, size))
                yield partition.archive, name, offset, size, mask, query, hashlib.sha256(query.encode()).hexdigest(), None

    @staticmethod
    def _lines(raw, offset: int, size: int) -> Iterator[bytes]:
        """Lines of a byte range, read a piece at a time and no further than asked for."""
        raw.seek(offset)
        left, rest = size, b""
        while left:
            piece = raw.read(min(HEAD, left))
            left -= len(piece)
            *lines, rest = (rest + piece).split(b"\n")
            yield from lines
        yield rest


class ArchiveSource(DataSource):
    """Format ``alignment_archive``: a row a member, without its body where the archive isn't compressed."""

    @classmethod
    def name(cls) -> str:
        return "alignment_archive"

    def schema(self) -> str:
        return "archive string, name string, offset long, size long, mask string, query string, query_sha256 string, body binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The index of an archive, or of all archives under a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).option("path", path).load()


def read_members(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records of the members whose query is wanted (``sha``): name, query_sha256, key, tax, aligned.

    Of several members with one query that of the smallest name counts (of the
    smallest archive, if a name repeats). Only these members' bodies are read.
    """
    index = read_archive(spark, path)
    known = index.join(wanted.select(F.col("sha").alias("query_sha256")).filter("query_sha256 IS NOT NULL").distinct(), "query_sha256", "left_semi")
    first = known.groupBy("query_sha256").agg(F.min_by(F.struct("archive", "name", "offset", "size", "body"), F.struct("name", "archive")).alias("m"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                body = r["body"]
                if body is None:
                    system, inner = _opened(r["archive"])
                    with system.open_input_file(inner) as raw:
                        body = raw.read_at(r["size"], r["offset"])
                rows, head = [], None
                for line in body.decode("ascii").split("\n"):
                    if line.startswith(">"):
                        head = line[1:].split()
                        rows.append([r["name"], r["query_sha256"], head[0] if head else "", head[1] if len(head) > 1 else None, ""])
                    elif rows:
                        rows[-1][4] += line.strip()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[2:], strict=True)] if rows[2:] else [pa.array([], pa.string())] * 5, names=["name", "query_sha256", "key", "tax", "aligned"])

    chosen = first.select("m.*", "query_sha256").repartition("archive", "offset")
    return chosen.mapInArrow(bodies, "name string, query_sha256 string, key string, tax string, aligned string")


def write_archives(members: DataFrame, path: str, compressed: bool = False) -> None:
    """Members (name, text) as archives under ``path``, one a task; an archive gets its name when it is whole."""
    ending = ".tar.gz" if compressed else ".tar"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(path)
        system.create_dir(inner, recursive=True)
        target = f"{inner}/part-{TaskContext.get().partitionId():05d}{ending}"
        partial, n = f"{target}.{uuid.uuid4().hex}.partial", 0
        with system.open_output_stream(partial, compression=None) as raw, tarfile.open(fileobj=raw, mode="w|gz" if compressed else "w|") as tar:
            for batch in batches:
                for r in batch.to_pylist():
                    data = r["text"].encode()
                    info = tarfile.TarInfo(r["name"])
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    n += 1
        system.move(partial, target)
        yield pa.RecordBatch.from_pydict({"members": [n]})

    members.select("name", "text").mapInArrow(put, "members long").agg(F.sum("members")).collect()
