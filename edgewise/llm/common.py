"""Shared plumbing: Arrow batches, held-out folds, samples, groups in sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.shared import bounded_batches, fresh_path, materialise, shared_dir

__all__ = ["bounded_batches", "fresh_path", "groups_in_order", "held_out", "materialise", "sample_by_hash", "shared_dir", "spread_join", "whole_row"]

def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents whose labels are never learned from.

    A null id counts as the empty string, so that the row has a fold.
    """
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


#: Groups up to which a table of group sizes is broadcast.
GROUPS = 10_000


def sample_by_hash(df: DataFrame, key: str, group: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each group at most, chosen by a hash of ``key``.

    The group sizes come from one grouped count and go to the rows as a checked
    small table, so no group meets in one task and no row is shuffled.
    """
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    few = sizes.limit(GROUPS + 1).collect()
    if len(few) <= GROUPS:
        sizes = F.broadcast(df.sparkSession.createDataFrame(few, sizes.schema))
    share = F.xxhash64(F.lit("sample"), F.col(key)).bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))
    return df.join(sizes, F.col(group) == F.col("__group")).filter(share * F.col("__n") < bound).drop("__n", "__group")


#: A key is hot if it has more rows than this share of all rows, and than HOT_ROWS; fewer than 1 / HOT_SHARE keys can be.
HOT_SHARE, HOT_ROWS = 1e-3, 10_000


def spread_join(rows: DataFrame, facts: DataFrame, key: str, size: str, *salt: str) -> DataFrame:
    """Inner join by ``key`` with one fact a key; ``size`` tells how many rows have it.

    The rows of hot keys are dealt out by a hash of ``salt``, their facts
    repeated to match. ``facts`` must be a written table or cheap: it is read
    for the hot keys first. These are fewer than 1 / HOT_SHARE by their
    definition, so that their table is broadcast.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    cut = max(HOT_ROWS, int(total * HOT_SHARE))
    parts = F.ceil(F.col(size) / cut).cast("int")
    hot = facts.filter(F.col(size) > cut).select(key, parts.alias("__parts"))
    few = rows.sparkSession.createDataFrame(hot.collect(), hot.schema)  # under 1 / HOT_SHARE rows
    dealt = rows.join(F.broadcast(few), key, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    repeated = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(repeated, [key, "__salt"]).drop("__salt")


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that no helper column can clash with them; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def groups_in_order(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups, as arrays by column, of a partition that is sorted by ``keys`` (numbers without nulls)."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for frame in frames:
        if not len(frame):
            continue
        columns = {c: frame[c].to_numpy() for c in frame.columns}
        change = np.zeros(len(frame), dtype=bool)
        for key in keys:
            change[1:] |= columns[key][1:] != columns[key][:-1]
        change[0] = True
        bounds = [*np.flatnonzero(change).tolist(), len(frame)]
        for at, to in zip(bounds, bounds[1:], strict=False):
            piece = {c: x[at:to] for c, x in columns.items()}
            if held and any(held[-1][k][0] != piece[k][0] for k in keys):
                yield whole()
                held = []
            held.append(piece)
    if held:
        yield whole()
