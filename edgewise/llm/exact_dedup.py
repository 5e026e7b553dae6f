"""Exact deduplication by an extendible-hash index on shared files.

Texts have 64-bit keys. A directory over the key's leading bits says which
bucket a key is in: it starts with one bucket, and a bucket with more than
``capacity`` keys splits on its next bit, doubling the directory where need be.
Map tasks combine the equal texts they meet; owner tasks get whole buckets (key
ranges), chain the entries of each key, compare their bytes, and write the
index: one entry per distinct text. Rows find their group by directory, key
and, where a key has several entries, bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, fresh_path, materialise, spread_join, whole_row

#: Keys that a bucket holds before it splits. With more than CAPACITY * MOST_BUCKETS keys the capacity is higher, so
#: that the directory, which every task holds, stays within 16 * MOST_BUCKETS cells.
CAPACITY, MOST_BUCKETS = 2000, 1 << 15
#: Characters of text that a map task holds for combining.
HELD = 8_000_000
#: Keys with several texts up to which they are broadcast, so that only their rows carry bytes to the index.
COLLIDED = 10_000


class Index(NamedTuple):
    """``entries``: bucket, local_depth, key, chain, key_size, keep_id, group_size, text_sha256, text (where the key has several); ``directory``: cell, bucket, local_depth."""

    entries: DataFrame
    directory: DataFrame
    bits: int


def normalised(text: Column) -> Column:
    """Null as empty; each run of space and control white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def grow_directory(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and local depth of each bucket, from keys per finest cell.

    Starts with one bucket of depth 0; an overfull bucket splits on its next
    bit, down to single cells.
    """
    depth = len(histogram).bit_length() - 1
    sums = np.concatenate([[0], np.cumsum(histogram)])
    starts, depths, todo = [], [], [(0, 0)]
    while todo:
        start, local = todo.pop()
        width = 1 << (depth - local)
        if sums[start + width] - sums[start] > capacity and local < depth:
            todo += [(start + width // 2, local + 1), (start, local + 1)]
        else:
            starts.append(start)
            depths.append(local)
    return np.array(starts, dtype=np.int64), np.array(depths, dtype=np.int64)


def _keyed(df: DataFrame, id_col: str, text_col: str, key: Column | None, *more: Column) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), *more)
    return rows.withColumn("key", F.xxhash64("norm") if key is None else key)


def _cell(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits).cast("int")


def _grow(rows: DataFrame, capacity: int, base: str) -> tuple[DataFrame, int]:
    """Write the directory for the keys of ``rows``; the table and the bits it reads."""
    spark = rows.sparkSession
    keys = materialise(rows.select("key").distinct(), path=f"{base}/keys")
    n = keys.count()
    capacity = max(capacity, -(-n // MOST_BUCKETS))
    bits = max(1, min(MOST_BUCKETS.bit_length() + 3, (n // capacity).bit_length() + 4))
    histogram = np.zeros(1 << bits, dtype=np.int64)
    for row in keys.groupBy(_cell(bits).alias("cell")).agg(F.count("*").alias("n")).collect():  # a small row a cell
        histogram[row["cell"]] = row["n"]
    starts, depths = grow_directory(histogram, capacity)
    bucket = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), 1 << bits]))
    cells = [(c, b, int(depths[b])) for c, b in enumerate(bucket.tolist())]
    return materialise(spark.createDataFrame(cells, "cell int, bucket int, local_depth int").coalesce(1), path=f"{base}/directory"), bits


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Column | None = None) -> Index:
    """Grow the directory, combine, chain and write the index.

    ``key`` overrides the 64-bit hash of the column ``norm`` (tests force
    collisions with it).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    base = fresh_path(spark, "index")
    rows = _keyed(df, id_col, text_col, key)
    directory, bits = _grow(rows, capacity, base)
    kind = df.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    least = lambda a, b: b if a is None else a if b is None else min(a, b)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(key, *entry) for key, chain in held.items() for entry in chain]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), id_type, pa.int64()), strict=True)], ["key", "norm", "id", "n"])

        for batch in batches:
            for key, norm, doc in zip(*(batch.column(c).to_pylist() for c in ("key", "norm", "id")), strict=True):
                chain = held.setdefault(key, [])
                for entry in chain:
                    if entry[0] == norm:
                        entry[1] = least(entry[1], doc)
                        entry[2] += 1
                        break
                else:
                    chain.append([norm, doc, 1])
                    size += len(norm)
            if size > HELD:
                yield flush()
                size = 0
        yield flush()

    name = kind.simpleString()
    entries = rows.select("key", "norm", "id").mapInArrow(combine, f"key long, norm string, id {name}, n long")
    # The directory is bounded (see MOST_BUCKETS). Owner tasks get whole buckets, each a range of keys.
    owned = entries.withColumn("cell", _cell(bits)).join(F.broadcast(directory), "cell").drop("cell").repartition("bucket").sortWithinPartitions("bucket", "key")
    names = ["bucket", "local_depth", "key", "chain", "key_size", "keep_id", "group_size", "text_sha256", "text"]
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), id_type, pa.int64(), pa.string(), pa.string())

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads, done = None, [], []

        def close() -> None:
            total = sum(h[2] for h in heads)
            for k, (data, doc, n) in enumerate(heads):
                done.append((*last, k, total, doc, n, hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest(), data if len(heads) > 1 else None))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for bucket, depth, key, norm, doc, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "local_depth", "key", "norm", "id", "n")), strict=True):
                if (bucket, depth, key) != last:
                    close()
                    last, heads = (bucket, depth, key), []
                head = next((h for h in heads if h[0] == norm), None)
                if head is None:
                    heads.append([norm, doc, n])
                else:
                    head[1], head[2] = least(head[1], doc), head[2] + n
            yield out()
        close()
        yield out()

    index = owned.mapInArrow(link, f"bucket int, local_depth int, key long, chain int, key_size long, keep_id {name}, group_size long, text_sha256 string, text string")
    return Index(materialise(index, path=f"{base}/entries"), directory, bits)


def look_up(rows: DataFrame, index: Index, *salt: str) -> DataFrame:
    """``rows`` (with ``key`` and ``norm``, which goes) joined to their entry: directory cell and key, then bytes where the key has several texts.

    Rows of hot keys are dealt out by a hash of ``salt``.
    """
    collided = index.entries.filter("chain > 0").select("key").distinct().limit(COLLIDED + 1)
    few = collided.collect()
    if len(few) <= COLLIDED:  # as good as always: 64-bit keys seldom collide
        some = F.broadcast(rows.sparkSession.createDataFrame(few, collided.schema).withColumn("several", F.lit(True)))
        rows = rows.join(some, "key", "left").withColumn("bytes", F.when(F.col("several"), F.col("norm"))).drop("several")
    else:
        rows = rows.withColumn("bytes", F.col("norm"))
    joined = spread_join(rows.drop("norm"), index.entries, "key", "key_size", *salt)
    return joined.filter(F.col("text").isNull() | (F.col("text") == F.col("bytes"))).drop("bytes", "text")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Column | None = None) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Of equal texts the row with the smallest id
    stays; among repeated rows of that id exactly one is ``kept``. Null ids
    stay only where their group has no other id. Extra columns are ignored; an
    empty table gives an empty result.
    """
    index = build_index(df, id_col, text_col, capacity, key)
    found = look_up(_keyed(df, id_col, text_col, key), index, "id").select("id", "key", "chain", "keep_id", "group_size", "text_sha256")
    nth = F.row_number().over(Window.partitionBy("id", "key", "chain").orderBy(F.lit(1)))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (nth == 1)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key: Column | None = None) -> DataFrame:
    """Whole rows that stay, all columns of ``df``; one row per distinct normalised text.

    Nulls, empty tables and the choice of the row are as in
    ``exact_duplicates``; among rows of one id and text the first by all
    columns stays.
    """
    index = build_index(df, id_col, text_col, capacity, key)
    rows = _keyed(df, id_col, text_col, key, whole_row(df).alias("row"))
    joined = look_up(rows, index, "id").filter(F.col("id").eqNullSafe(F.col("keep_id")))
    order = [F.to_json(F.struct(F.col(f"row.`{c}`"))) if "map<" in t else F.col(f"row.`{c}`") for c, t in df.dtypes]
    rank = F.row_number().over(Window.partitionBy("key", "chain").orderBy(*order))
    several = joined.filter("group_size > 1").withColumn("rank", rank).filter("rank = 1")
    return joined.filter("group_size = 1").select("row.*").unionByName(several.select("row.*"))
