"""Matroska media columns: write 8-bit audio, parse packets, read samples back.

A payload becomes one PCM track: clusters of blocks whose frames are laced by
all four schemes in turn (none, Xiph, fixed size, EBML), with cues to every
cluster. The parser walks EBML elements by their variable-length ids and sizes
and returns packet and cue tables with byte ranges; unknown elements are
skipped and unknown sizes end at the next element of the same level or above.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Element ids.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, CUES, POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_AT = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DURATION, BLOCK_DURATION, REFERENCE = 0x23E383, 0x9B, 0xFB
_PARENTS = {EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, CUE_PLACE}
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}
#: Samples in a frame, frames in a block, blocks in a cluster; a sample lasts one tick of a millisecond.
FRAME, FRAMES, BLOCKS, PAD = 256, 4, 16, 64


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    cluster: int
    lacing: int
    keyframe: bool


def _id(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def vint(value: int, width: int = 0) -> bytes:
    """Variable-length size: a leading one bit marks the width; all ones means unknown and is never written."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, data: bytes) -> bytes:
    return _id(ident) + vint(len(data)) + data


def _uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _signed_vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(value) < (1 << 7 * w - 1) - 1)
    return vint(value + (1 << 7 * width - 1) - 1, width)


def lace(frames: list[bytes], scheme: int) -> bytes:
    """Lace header and frames: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if scheme == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if scheme == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif scheme == 3:
        head += vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one track holds ``payload`` as 8-bit PCM samples."""
    info = element(INFO, _uint(SCALE, 1_000_000))
    audio = element(AUDIO, element(RATE, struct.pack(">d", 1000.0)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, points = [info, tracks], []
    at, span = len(info) + len(tracks), FRAME * FRAMES
    for start in range(0, len(payload), span * BLOCKS):
        blocks = [_uint(TIME, start)]
        for k, place in enumerate(range(start, min(start + span * BLOCKS, len(payload)), span)):
            data = payload[place : place + span]
            scheme = k % 4
            if scheme == 0:
                frames = [data]
            elif scheme == 2:
                count = next(c for c in (4, 2, 1) if len(data) % c == 0)
                frames = [data[i : i + len(data) // count] for i in range(0, len(data), len(data) // count)]
            else:  # frames of unlike sizes
                cuts = sorted({0, len(data) // 5, len(data) // 2, len(data)})
                frames = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            body_of = vint(1) + struct.pack(">h", place - start) + bytes([scheme << 1 | (0 if k % 8 == 7 else 0x80)]) + lace(frames, scheme)
            blocks.append(element(GROUP, element(BLOCK, body_of)) if k % 8 == 7 else element(SIMPLE, body_of))
        cluster = element(CLUSTER, b"".join(blocks))
        points.append(element(POINT, _uint(CUE_TIME, start) + element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_AT, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(points)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


def _vint_at(data: bytes, at: int, mark: bool) -> tuple[int, int]:
    """Value and end of a variable-length number; ``mark`` keeps the width bit (ids). -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("truncated number")
    value = int.from_bytes(data[at : at + width], "big")
    if not mark:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def walk(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its data), parents before children."""
    at, end = start, len(data) if end is None else end
    while at < end:
        ident, after = _vint_at(data, at, True)
        size, body = _vint_at(data, after, False)
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element {ident:X} at byte {at} runs past its parent")
        yield ident, at, body, stop
        if size < 0 and ident in _TOP and ident != SEGMENT:
            inner, stop = list(_until(data, body, end)), None
            yield from (x[:4] for x in inner)
            stop = max((x[3] for x in inner), default=body)
        elif ident in _PARENTS:
            yield from walk(data, body, stop)
        at = stop


def _until(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Children of an element of unknown size: up to the next top-level element."""
    while at < end:
        ident, after = _vint_at(data, at, True)
        if ident in _TOP:
            return
        size, body = _vint_at(data, after, False)
        stop = body + size
        if size < 0 or stop > end:
            raise ValueError(f"element {ident:X} at byte {at} runs past its parent")
        yield ident, at, body, stop
        if ident in _PARENTS:
            yield from walk(data, body, stop)
        at = stop


def _frames(data: bytes, at: int, end: int, scheme: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block body."""
    if scheme == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if scheme == 2:
        sizes = [(end - at) // count] * count
    elif scheme == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        if count > 1:
            n, at = _vint_at(data, at, False)
            sizes.append(n)
            for _ in range(count - 2):
                raw, to = _vint_at(data, at, False)
                width = to - at
                raw = raw if raw >= 0 else (1 << 7 * width) - 1
                sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
                at = to
        sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("a laced frame runs past its block")
        out.append((at, n))
        at += n
    return out


class Track:
    """What a track's entry says: number, codec, sampling rate, bits of a sample, channels, nanoseconds of a frame."""

    def __init__(self) -> None:
        self.number, self.codec, self.rate, self.bits, self.channels, self.duration = 0, "", 8000.0, 0, 1, 0

    def later(self, frame: int, before: int) -> int:
        """Nanoseconds from a block's start to its frame number ``frame``, which ``before`` bytes precede; 0 if the track doesn't tell."""
        if self.duration:
            return frame * self.duration
        if self.codec.startswith("A_PCM") and self.bits and self.rate:
            return int(before * 8 / (self.bits * self.channels) / self.rate * 1e9)
        return 0


def demux(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]], list[Track]]:
    """Packets; cues as (timestamp, track, byte of the cluster); tracks.

    A laced frame's timestamp comes from the track's frame duration, else from
    the PCM bytes before it, else from its share of the block's duration; with
    none of these it is the block's. A block of a group is a key frame unless
    the group refers to another block.
    """
    packets: list[Packet] = []
    cues: list[list[int]] = []
    tracks: list[Track] = []
    scale, cluster, clock, segment, group = 1_000_000, -1, 0, 0, 0
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    for ident, at, body, stop in walk(data):
        if ident == SEGMENT:
            segment = body
        elif ident == SCALE:
            scale = number(body, stop)
        elif ident == ENTRY:
            tracks.append(Track())
        elif ident == NUMBER:
            tracks[-1].number = number(body, stop)
        elif ident == CODEC:
            tracks[-1].codec = data[body:stop].decode("ascii", "replace")
        elif ident == RATE:
            tracks[-1].rate = struct.unpack(">d" if stop - body == 8 else ">f", data[body:stop])[0]
        elif ident == DEPTH:
            tracks[-1].bits = number(body, stop)
        elif ident == CHANNELS:
            tracks[-1].channels = max(1, number(body, stop))
        elif ident == DURATION:
            tracks[-1].duration = number(body, stop)
        elif ident == CLUSTER:
            cluster, clock = at, 0
        elif ident == TIME:
            clock = number(body, stop)
        elif ident == GROUP:
            group = len(packets)
        elif ident in (SIMPLE, BLOCK):
            own, place = _vint_at(data, body, False)
            ticks, flags = struct.unpack_from(">hB", data, place)
            track, first, before = next((t for t in tracks if t.number == own), Track()), (clock + ticks) * scale, 0
            for k, (offset, size) in enumerate(_frames(data, place + 3, stop, flags >> 1 & 3)):
                packets.append(Packet(own, first + track.later(k, before), offset, size, cluster, flags >> 1 & 3, bool(flags & 0x80) or ident == BLOCK))
                before += size
        elif ident == REFERENCE:
            packets[group:] = [p._replace(keyframe=False) for p in packets[group:]]
        elif ident == BLOCK_DURATION and (n := len(packets) - group) > 1 and packets[group].timestamp == packets[-1].timestamp:
            packets[group:] = [p._replace(timestamp=p.timestamp + k * number(body, stop) * scale // n) for k, p in enumerate(packets[group:])]
        elif ident == POINT:
            cues.append([0, 0, 0])
        elif ident == CUE_TIME:
            cues[-1][0] = number(body, stop) * scale
        elif ident == CUE_TRACK:
            cues[-1][1] = number(body, stop)
        elif ident == CUE_AT:
            cues[-1][2] = segment + number(body, stop)
    return packets, [tuple(c) for c in cues], tracks


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes with zero bytes up to a positive multiple of ``PAD``, and the bytes before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % PAD if data else PAD), len(data)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_bytes`` of the text and ``media``, its Matroska file.

    A null or empty text is ``PAD`` zero samples. Repeated rows give repeated
    files, an empty table an empty one; extra columns are left out.
    """
    bounded_batches(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [padded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for _, n in both], pa.int64()), pa.array([mux(p) for p, _ in both], pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(write, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_PACKET = {"track": pa.int32(), "timestamp": pa.int64(), "offset": pa.int64(), "size": pa.int64(), "cluster": pa.int64(), "lacing": pa.int32(), "keyframe": pa.bool_()}
_CUE = {"timestamp": pa.int64(), "track": pa.int32(), "offset": pa.int64()}
PACKET_TABLE = "array<struct<track:int,timestamp:long,offset:long,size:long,cluster:long,lacing:int,keyframe:boolean>>"
CUE_TABLE = "array<struct<timestamp:long,track:int,offset:long>>"


def _table(lists: list[list[tuple] | None], kinds: dict[str, pa.DataType]) -> pa.Array:
    """Lists of tuples as an Arrow array of lists of structs, built column by column."""
    flat = list(zip(*(x for one in lists for x in one or ()), strict=True)) or [[]] * len(kinds)
    rows = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(flat, kinds.values(), strict=True)], names=list(kinds))
    sizes = [0, *np.cumsum([len(one or ()) for one in lists]).tolist()]
    starts = pa.array([None if k < len(lists) and lists[k] is None else n for k, n in enumerate(sizes)], pa.int32())
    return pa.ListArray.from_arrays(starts, rows)


def media_packets(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``packets``, ``cues`` and ``error`` to rows with a media column (whole bytes; null: no packets).

    Timestamps are in nanoseconds, offsets are bytes of the file. A file that
    can't be parsed gives null tables and the reason, not a failed job. Columns
    of ``df`` with these names give way; repeated rows stay, an empty table
    gives an empty one.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("packets", "cues", "error")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packets, cues, errors = [], [], []
            for data in batch.column(media_col).to_pylist():
                try:
                    p, c, _ = demux(data or b"")
                    packets.append(p)
                    cues.append(c)
                    errors.append(None)
                except (ValueError, IndexError, struct.error) as error:
                    packets.append(None)
                    cues.append(None)
                    errors.append(str(error))
            more = [_table(packets, _PACKET), _table(cues, _CUE), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "packets", "cues", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(parse, f"{fields}, packets {PACKET_TABLE}, cues {CUE_TABLE}, error string")


def _feature(samples: np.ndarray, laced: int, packets: int, cues: int, end: int) -> str:
    x = samples.astype(np.int64)
    turns = int((np.diff(np.signbit(x - 128).astype(np.int8)) != 0).sum())
    return f"packets={packets};cues={cues};laced={laced};end={end};sum={int(x.sum())};energy={int((x * x).sum())};turns={turns}"


def media_digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the samples back by the byte ranges of ``media_packets``: payload facts, media facts, feature.

    Repeated rows give repeated results, an empty table an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), "n_bytes", "media", *[F.col(f"packets.{c}").alias(c) for c in ("track", "timestamp", "offset", "size", "lacing")], F.size("cues").alias("cues"))
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).flatten().to_pylist() for c in ("track", "timestamp", "offset", "size", "lacing")}
            counts, at, out = batch.column("track").value_lengths().to_pylist(), 0, []
            for data, cues, n in zip(batch.column("media").to_pylist(), batch.column("cues").to_pylist(), counts, strict=True):
                own = slice(at, at + n)
                payload = b"".join(data[o : o + m] for k, o, m in zip(column["track"][own], column["offset"][own], column["size"][own], strict=True) if k == 1)
                feature = _feature(np.frombuffer(payload, dtype=np.uint8), sum(x > 0 for x in column["lacing"][own]), n, cues, column["timestamp"][at + n - 1] if n else 0)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature))
                at += n
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["id", "n_bytes", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(read, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
