"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks, so equal
passages give equal chunks wherever they stand. One shuffle by chunk digest
lets owner tasks write each unique chunk once; document recipes travel in the
same shuffle and are then written in ascending id order, with a Merkle tree
over the documents of each part and a manifest of the parts' roots. Reading
back checks the recipes against the manifest, re-hashes every stored chunk and
derives each document's checksum from its chunks' checksums.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, fresh_path, materialise, spread_join
from .tokens import encoder, tokenizer_path

#: Chunk sizes in ids: least, mean beyond the least, most; and the ids that a rolling hash covers.
LEAST, MEAN, MOST, WINDOW = 64, 256, 1024, 16
#: Digests of chunks a worker has sent already; the set is emptied when full.
SEEN = 300_000
#: Ids whose rolling hashes are computed together.
TOGETHER = 500_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """Merkle root of a stream of leaves in logarithmic memory; an odd node moves up unpaired."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.peaks and self.peaks[-1][0] == height:
            leaf = digest(self.peaks.pop()[1] + leaf)
            height += 1
        self.peaks.append((height, leaf))

    def root(self) -> bytes:
        out = b""
        for _, peak in reversed(self.peaks):
            out = digest(peak + out) if out else peak
        return out or digest(b"")


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a list, level by level."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [*map(digest, map(bytes.__add__, level[::2], level[1::2])), *level[len(level) & ~1 :]]
    return level[0]


def _marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ``WINDOW`` ids falls in one of ``MEAN`` classes; the window doubles step by step."""
    rolled = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    width = 1
    while width < WINDOW:
        rolled[width:] += rolled[:-width] << np.uint64(width)
        width *= 2
    return np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1


def _ends(marks: list[int], n: int) -> list[int]:
    ends, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST or (mark == n and mark > last):
            last = mark
            ends.append(last)
    return ends


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of chunks: at marks of the rolling hash, ``LEAST`` to ``MOST`` ids apart."""
    return _ends(_marks(ids).tolist(), len(ids))


def _cuts(raws: list[bytes]) -> Iterator[list[int]]:
    """Cut points of many documents, hashed together: no mark counts in a document's first ``LEAST`` ids, so none sees its neighbour."""
    assert WINDOW <= LEAST
    at = 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (to == at or size + len(raws[to]) <= 4 * TOGETHER):
            size += len(raws[to])
            to += 1
        bounds = np.cumsum([0, *[len(r) // 4 for r in raws[at:to]]])
        marks = _marks(np.frombuffer(b"".join(raws[at:to]), dtype="<u4"))
        places = np.searchsorted(marks, bounds, side="right").tolist()
        for k, (start, end) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
            yield _ends((marks[places[k] : places[k + 1]] - start).tolist(), end - start)
        at = to


_OUT = "chunk boolean, key binary, payload binary, id {kind}, n_tokens long, digests array<binary>, root binary"


def _batch(rows: list[tuple], names: str, *types: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names.split())


def chunk_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk rows (``key`` digest, ``payload`` 16-bit ids) and recipe rows of every document.

    A null or empty text is the end id alone. Repeated rows give repeated
    recipes over the same chunks. An empty table gives no rows.
    """
    path = path or tokenizer_path()
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType
    types = (pa.bool_(), pa.binary(), pa.binary(), to_arrow_type(kind), pa.int64(), pa.list_(pa.binary()), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            raws = encoder(path).batch(batch.column("text").to_pylist())
            for doc, raw, ends in zip(batch.column("id").to_pylist(), raws, _cuts(raws), strict=True):
                ids = np.frombuffer(raw, dtype="<u4")
                small, fits, leaves, start = ids.astype("<u2").tobytes(), ids.max() < 65536, [], 0
                for end in ends:
                    # The form depends on the chunk alone, so that equal chunks of unlike documents are equal.
                    payload = b"\2" + small[2 * start : 2 * end] if fits or ids[start:end].max() < 65536 else b"\4" + raw[4 * start : 4 * end]
                    leaves.append(digest(payload))
                    start = end
                    if leaves[-1] not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(leaves[-1])
                        rows.append((True, leaves[-1], payload, None, None, None, None))
                row += 1
                rows.append((False, digest(b"%d:%d" % (task, row)), None, doc, len(ids), leaves, merkle_root(leaves)))
            yield _batch(rows, "chunk key payload id n_tokens digests root", *types)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, _OUT.format(kind=kind.simpleString()))


def _leaf(doc: object, n: int, at: int, before: int, root: bytes) -> bytes:
    """A document's leaf in its part's tree: id, length, place and content."""
    return digest(repr((doc, n, at, before)).encode("utf-8", "surrogatepass") + root)


def write_store(df: DataFrame, base: str | None = None, path: str | None = None, id_col: str = "doc_id") -> str:
    """Write ``parts`` (chunks), ``recipes`` (ascending ids) and ``manifest`` under a shared folder; return the folder.

    The manifest has documents, ids and Merkle root of each recipe part, and in
    part -1 their sums and the root over the parts' roots.
    """
    spark = df.sparkSession
    base = base or fresh_path(spark, "store")
    rows = chunk_documents(df, path, id_col)
    # One shuffle brings equal chunks together; the first of each stays. Recipe rows have keys of their own.
    once = rows.repartition(F.col("chunk"), F.col("key")).sortWithinPartitions("chunk", "key").dropDuplicates(["chunk", "key"])
    materialise(once, "", f"{base}/parts", partition_by="chunk")
    recipes = spark.read.schema(rows.schema).parquet(f"{base}/parts").filter(~F.col("chunk")).select("id", "n_tokens", "digests", "root")
    ordered = recipes.repartitionByRange(F.col("id"), F.col("root")).sortWithinPartitions("id", "root")
    kind = df.schema[id_col].dataType
    types = (to_arrow_type(kind), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, before, at, part, names = Merkle(), 0, 0, TaskContext.get().partitionId(), "id n_tokens digests root at before part total"
        for batch in batches:
            out = []
            for doc, n, digests, root in zip(batch.column("id").to_pylist(), batch.column("n_tokens").to_pylist(), _lists(batch.column("digests")), _binaries(batch.column("root")), strict=True):
                tree.add(_leaf(doc, n, at, before, root))
                out.append((doc, n, digests, root, at, before, part, False))
                before, at = before + n, at + 1
            yield _batch(out, names, *types)
        if at:
            yield _batch([(None, before, None, tree.root(), at, before, part, True)], names, *types)

    placed = ordered.mapInArrow(place, f"id {kind.simpleString()}, n_tokens long, digests array<binary>, root binary, at long, before long, part int, total boolean")
    placed = materialise(placed, "", f"{base}/recipes", partition_by="total")
    totals = placed.filter("total").select("part", F.col("at").alias("documents"), F.col("n_tokens").alias("ids"), "root").orderBy("part").collect()  # a row a recipe part
    start, lines = 0, []
    for r in totals:
        lines.append((r["part"], r["documents"], r["ids"], r["root"], start))
        start += r["ids"]
    lines.append((-1, sum(r["documents"] for r in totals), start, bytearray(merkle_root([bytes(r["root"]) for r in totals])), 0))
    materialise(spark.createDataFrame(lines, "part int, documents long, ids long, root binary, start long").coalesce(1), "", f"{base}/manifest")
    return base


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """For each k, four byte tables that advance a checksum over 2**k zero bytes."""
    def one_byte(v: int) -> int:
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        return v

    values, tables = np.arange(256, dtype=np.uint32), np.zeros((40, 4, 256), dtype=np.uint32)
    m = np.array([one_byte(1 << i) for i in range(32)], dtype=np.uint32)
    for table in tables:
        for i in range(32):
            table[i // 8] ^= (values >> (i % 8) & 1) * m[i]
        m = _advance(table, m)
    return tables


def _advance(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    return table[0, v & 255] ^ table[1, v >> 8 & 255] ^ table[2, v >> 16 & 255] ^ table[3, v >> 24]


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Checksums advanced over so many zero bytes (element by element)."""
    out = crc.astype(np.uint32)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        hit = (zeros >> k & 1).astype(bool)
        if hit.any():
            out[hit] = _advance(_shift_tables()[k], out[hit])
    return out


def crc_concat(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """Checksums of concatenations from the parts' checksums (element by element)."""
    return crc_shift(first, second_bytes) ^ second.astype(np.uint32)


def _binaries(column: pa.Array) -> list[bytes]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _lists(column: pa.Array) -> list[list[bytes]]:
    """Lists of binaries; a null counts as empty."""
    flat, ends = _binaries(column.flatten()), np.cumsum(pa.compute.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _ids(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, dtype="<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def read_chunks(spark, base: str) -> DataFrame:
    """Stored chunks: ``key``, ``n`` ids, ``crc`` of the ids and whether the bytes hash to the key."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, payload in zip(_binaries(batch.column("key")), _binaries(batch.column("payload")), strict=True):
                ids = _ids(payload)
                out.append((key, len(ids), zlib.crc32(ids.tobytes()), digest(payload) == key))
            yield _batch(out, "key n crc sound", pa.binary(), pa.int64(), pa.int64(), pa.bool_())

    chunks = spark.read.schema("chunk boolean, key binary, payload binary").parquet(f"{base}/parts").filter("chunk").select("key", "payload")
    return chunks.mapInArrow(verify, "key binary, n long, crc long, sound boolean")


def _recipes(spark, base: str, id_kind: str) -> DataFrame:
    recipes = spark.read.schema(f"id {id_kind}, n_tokens long, digests array<binary>, root binary, at long, before long, part int, total boolean").parquet(f"{base}/recipes").filter("not total").drop("total")
    manifest = spark.read.parquet(f"{base}/manifest").select("part", F.col("start").alias("part_start"))
    return recipes.join(F.broadcast(manifest), "part")  # a row a recipe part


def check_manifest(spark, base: str, id_kind: str = "bigint") -> None:
    """Raise ValueError unless the recipes are those of the manifest: their parts, documents, ids, order and roots."""
    rows = _recipes(spark, base, id_kind).select("part", "at", "before", "id", "n_tokens", "digests")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, documents, ids, done = None, Merkle(), 0, 0, []
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for own, at, before, doc, n, digests in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "before", "id", "n_tokens")), _lists(batch.column("digests")), strict=True):
                if own != part:
                    if part is not None:
                        done.append((part, documents, ids, tree.root()))
                    part, tree, documents, ids = own, Merkle(), 0, 0
                tree.add(_leaf(doc, n, at, before, merkle_root(digests)))
                documents, ids = documents + 1, ids + n
            yield _batch(done, "part documents ids root", *types)
            done = []
        if part is not None:
            yield _batch([(part, documents, ids, tree.root())], "part documents ids root", *types)

    found = rows.repartition("part").sortWithinPartitions("part", "at").mapInArrow(roots, "part int, documents long, ids long, root binary").orderBy("part").collect()  # a row a recipe part
    lines = {r["part"]: r for r in spark.read.parquet(f"{base}/manifest").collect()}
    head = lines.pop(-1, None)
    told = [(r["part"], r["documents"], r["ids"], bytes(r["root"])) for _, r in sorted(lines.items())]
    if told != [(r["part"], r["documents"], r["ids"], bytes(r["root"])) for r in found]:
        raise ValueError("the recipes are not those of the manifest")
    if not head or (head["documents"], head["ids"], bytes(head["root"])) != (sum(x[1] for x in told), sum(x[2] for x in told), merkle_root([x[3] for x in told])):
        raise ValueError("the manifest's own root does not hold")


def read_store(spark, base: str, id_kind: str = "bigint") -> DataFrame:
    """Per document from the files: id, start, n_tokens, ids_crc32, ``verified``.

    Raises ValueError where recipes and manifest differ. ``verified``: every
    chunk is there and sound, the ids add up and the Merkle root holds.
    """
    check_manifest(spark, base, id_kind)
    recipes = _recipes(spark, base, id_kind)
    uses = recipes.select("part", "at", F.posexplode("digests").alias("k", "key"))
    often = uses.groupBy("key").agg(F.count("*").alias("uses"))
    facts = materialise(read_chunks(spark, base).join(often, "key"), "facts")
    found = spread_join(uses, facts, "key", "uses", "part", "at")
    lists = found.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("k", "n", "crc", "sound", "key"))).alias("chunks"))
    whole = recipes.select("part", "at", "id", "n_tokens", "root", (F.col("part_start") + F.col("before")).alias("start")).join(lists, ["part", "at"], "left")
    whole = whole.select("id", "start", "n_tokens", "root", *[F.coalesce(F.col(f"chunks.{c}"), F.array()).alias(c) for c in ("n", "crc", "sound", "key")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(c).flatten() for c in ("n", "crc", "sound", "key")}
            size = batch.column("n").value_lengths().to_numpy(zero_copy_only=False)
            first = np.cumsum(size) - size
            n, parts = column["n"].to_numpy(zero_copy_only=False), column["crc"].to_numpy(zero_copy_only=False).astype(np.uint32)
            doc = np.repeat(np.arange(len(size)), size)
            tokens = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            good = np.bincount(doc, weights=n, minlength=len(size)).astype(np.int64) == tokens
            good[doc[~column["sound"].to_numpy(zero_copy_only=False).astype(bool)]] = False
            keys, roots = _binaries(column["key"]), _binaries(batch.column("root"))
            good &= np.array([merkle_root(keys[a : a + m]) == root for a, m, root in zip(first.tolist(), size.tolist(), roots, strict=True)], dtype=bool)
            # A document's checksum is the sum of its chunks', each advanced over the bytes after it.
            crc, to, full = np.zeros(len(size), dtype=np.uint32), np.cumsum(4 * n), size > 0
            if full.any():
                last = (first + size - 1)[doc]
                crc[full] = np.bitwise_xor.reduceat(crc_shift(parts, to[last] - to), first[full])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64)), pa.array(good)], ["id", "start", "n_tokens", "ids_crc32", "verified"])

    return whole.mapInArrow(fold, f"id {id_kind}, start long, n_tokens long, ids_crc32 long, verified boolean")


def reconstruct(spark, base: str, id_kind: str = "bigint") -> DataFrame:
    """Id, start and the whole ids (array) of every document, put together from its chunks."""
    recipes = _recipes(spark, base, id_kind)
    chunks = spark.read.schema("chunk boolean, key binary, payload binary").parquet(f"{base}/parts").filter("chunk").select("key", "payload")
    uses = recipes.select("part", "at", F.posexplode("digests").alias("k", "key")).join(chunks, "key")
    joined = uses.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("k", "payload"))).alias("chunks"))
    rows = recipes.select("part", "at", "id", (F.col("part_start") + F.col("before")).alias("start")).join(joined, ["part", "at"])

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "start": frame["start"], "ids": [np.concatenate([_ids(c["payload"]) for c in x]).astype(np.int64) for x in frame["chunks"]]})

    return rows.mapInPandas(build, f"id {id_kind}, start long, ids array<long>")
