"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal shingle sets form one representative. MinHash bands deal
representatives into buckets. In a bucket, signatures are compared hash by
hash; a pair goes as soon as the posterior probability that it reaches the
threshold falls below a tolerance. A bucket never lists its pairs: a search
from the smallest member on compares each one reached with those not reached
yet, and gives a spanning forest. Components of these forests hold every pair
left; in each, block against block, pairs are verified exactly on their
shingle sets, and only counts and spanning stars leave the tasks.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.operators.graph import connected_components

from .common import bounded_batches, groups_in_order, materialise, spread_join, whole_row

#: Words in a shingle, similarity sought, hashes, bands of BAND_ROWS hashes, chance below which a pair is dropped.
SHINGLE, THRESHOLD, HASHES, BANDS, BAND_ROWS, TOLERANCE = 5, 0.8, 128, 24, 4, 1e-4
#: Hashes compared at a time.
STEP = 16
#: Members of a bucket compared in one task against as many; members, and their shingles, of a component verified in one task against as many.
BUCKET, BLOCK, BLOCK_SHINGLES, TILE = 8192, 1024, 4_000_000, 256


@lru_cache(maxsize=2)
def _multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of ``width`` words; a shorter text is one run; none without words."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    mixed = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for k in range(min(width, len(words))):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Sixteen bits of each minimum."""
    factors, least = _multipliers(hashes), np.full(hashes, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096, None] * factors).min(axis=0))
    return (least >> np.uint64(26) & np.uint64(0xFFFF)).astype("<u2")


@lru_cache(maxsize=16)
def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> tuple[int, ...]:
    """After each ``step`` hashes, the fewest matches with which a pair goes on.

    Under a uniform prior the posterior chance that the similarity is at least
    ``threshold`` after k matches of n is that of k or fewer successes in n + 1
    draws of ``threshold``.
    """
    out = []
    for n in range(step, hashes + 1, step):
        chance, k = 0.0, -1
        while chance < tolerance:
            k += 1
            chance += math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        out.append(k)
    return tuple(out)


def surviving(one: np.ndarray, sigs: np.ndarray, rows: np.ndarray, bounds: tuple[int, ...], step: int = STEP) -> np.ndarray:
    """Those of ``rows`` of ``sigs`` that ``one`` is not pruned from."""
    matches = np.zeros(len(rows), dtype=np.int64)
    for k, least in enumerate(bounds):
        part = slice(k * step, (k + 1) * step)
        matches = matches + (sigs[rows, part] == one[part]).sum(axis=1)
        keep = matches >= least
        rows, matches = rows[keep], matches[keep]
        if not len(rows):
            break
    return rows


class _Forest:
    """Joins elements; the root of a tree is its least element."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """True if ``a`` and ``b`` were in two trees."""
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _matrix(packed: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(packed.tolist()), dtype="<u2").reshape(len(packed), -1)


def _forest_edges(sigs: np.ndarray, side: np.ndarray | None, bounds: tuple[int, ...]) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that survive; with ``side``, of those that lie on two sides.

    Each member reached is compared with those not reached yet, so near copies
    of one text cost about one comparison each.
    """
    open_, edges = np.ones(len(sigs), dtype=bool), []
    for start in range(len(sigs)):
        if not open_[start]:
            continue
        open_[start] = False
        reached = deque([start])
        while reached:
            x = reached.popleft()
            rows = np.flatnonzero(open_ if side is None else open_ & (side != side[x]))
            if not len(rows):
                continue
            close = surviving(sigs[x], sigs, rows, bounds)
            open_[close] = False
            reached.extend(close.tolist())
            edges += [(x, y) for y in close.tolist()]
    return edges


def _set_table(docs: DataFrame, width: int) -> DataFrame:
    """id, th (hash of the text), key (of the shingle set; null without words), sig, size of the set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, sigs, sizes = [], [], []
            for text in frame["text"]:
                s = shingle_set(text, width)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
                sizes.append(len(s))
            yield pd.DataFrame({"id": frame["id"], "th": frame["th"], "key": keys, "sig": sigs, "size": sizes})

    return docs.mapInPandas(run, f"id {kind}, th long, key binary, sig binary, size int")


def _candidate_edges(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges (src, dst) of spanning forests of the pairs that share a bucket and are not pruned."""
    bounds = least_matches(threshold, TOLERANCE)
    keys = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 2 * BAND_ROWS * b + 1, 2 * BAND_ROWS)) for b in range(BANDS)])
    banded = reps.select("node", F.explode(keys).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = banded.join(shared, "bucket").join(reps.select("node", "sig"), "node").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int"))
    members = members.withColumn("block", _block("node", "parts"))

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, dst = [], []
        for group in groups_in_order(frames, ["bucket", "low", "high"]):
            side = None if group["low"][0] == group["high"][0] else group["block"]
            node = group["node"]
            edges = _forest_edges(_matrix(group["sig"]), side, bounds)
            src += [int(node[a]) for a, _ in edges]
            dst += [int(node[b]) for _, b in edges]
            if len(src) > 20_000:
                yield pd.DataFrame({"src": src, "dst": dst})
                src, dst = [], []
        yield pd.DataFrame({"src": src, "dst": dst}, dtype="int64")

    # Sorted by node, the bands of one group of copies start from the same members and give the same stars.
    dealt = _block_pairs(members, True).select("bucket", "low", "high", "block", "node", "sig").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    return dealt.mapInPandas(link, "src long, dst long")


def _block(node: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), node), F.col(parts)).cast("int")


def _block_pairs(df: DataFrame, own: bool) -> DataFrame:
    """Deal each row to the pairs of blocks (``low``, ``high``) that its ``block`` of ``parts`` is in; ``own``: with itself as well."""
    other = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = other if own else other.filter("other <> block")
    return other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def exact_links(sets: list[np.ndarray], sigs: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``left`` x ``right`` (``same``: each unordered pair once) with Jaccard >= ``threshold``.

    Tile by tile: pairs pruned by their hashes go; the shingles that two of the
    tile's documents share span a 0/1 matrix whose product counts the rest.
    """
    bounds, size = least_matches(threshold, TOLERANCE), np.array([len(s) for s in sets])
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            alive = np.zeros((len(a), len(b)), dtype=bool)
            for k, x in enumerate(a):
                alive[k, np.searchsorted(b, surviving(sigs[x], sigs, b, bounds))] = True
            if same and i == j:
                alive = np.triu(alive, 1)
            rows, cols = alive.nonzero()
            if not len(rows):
                continue
            if len(rows) <= 8:
                both = np.array([len(np.intersect1d(sets[a[r]], sets[b[c]], assume_unique=True)) for r, c in zip(rows, cols, strict=True)])
            else:
                use = np.unique(np.concatenate([a[rows], b[cols]]))
                flat = np.concatenate([sets[x] for x in use])
                vocabulary, count = np.unique(flat, return_counts=True)
                vocabulary = vocabulary[count > 1]
                both = np.zeros(len(rows), dtype=np.int64)
                where = {int(x): k for k, x in enumerate(use)}
                r = np.array([where[int(x)] for x in a[rows]])
                c = np.array([where[int(x)] for x in b[cols]])
                for at in range(0, len(vocabulary), 8192):
                    part = vocabulary[at : at + 8192]
                    grid = np.zeros((len(use), len(part)), dtype=np.float32)
                    for k, x in enumerate(use):
                        s = sets[x]
                        s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                        to = np.searchsorted(part, s)
                        grid[k, to[part[to] == s]] = 1
                    both += (grid @ grid.T)[r, c].astype(np.int64)
            good = both >= threshold * (size[a[rows]] + size[b[cols]] - both) - 1e-9
            yield a[rows[good]], b[cols[good]]


def _verified(texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links of each node (``links``) and edges (src, dst) that join linked nodes, of all blocks of all components.

    Blocks are first searched alone; each tree of links leaves as a star. Pairs
    of blocks of a large component then give their counts, and an edge only
    where they join two trees.
    """
    schema = "src long, dst long, links long"

    def frame_of(node: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
        own = np.flatnonzero(links)
        return pd.DataFrame({
            "src": [*node[own].tolist(), *[a for a, _ in edges]], "dst": pd.array([*[None] * len(own), *[b for _, b in edges]], dtype="Int64"), "links": [*links[own].tolist(), *[0] * len(edges)],
        }).astype({"src": "int64", "links": "int64"})

    def scan(frames: Iterator[pd.DataFrame], across: bool) -> Iterator[pd.DataFrame]:
        for group in groups_in_order(frames, ["component", "low", "high"]):
            node, copies, block = group["node"], group["copies"], group["block"]
            sets, sigs, everyone = [shingle_set(t, width) for t in group["text"]], _matrix(group["sig"]), np.arange(len(node))
            left, right = (np.flatnonzero(block == group["low"][0]), np.flatnonzero(block == group["high"][0])) if across else (everyone, everyone)
            links, forest, edges = np.zeros(len(node), dtype=np.int64), _Forest(len(node)), []
            if across:
                first: dict[int, int] = {}
                for k, label in enumerate(group["label"].tolist()):
                    forest.join(first.setdefault(label, k), k)
            for a, b in exact_links(sets, sigs, threshold, left, right, not across):
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if forest.join(x, y) and across:
                        edges.append((int(node[x]), int(node[y])))
            if not across:
                edges = [(int(node[r]), int(node[k])) for k in everyone.tolist() if (r := forest.find(k)) != k]
            yield frame_of(node, links, edges)

    keys = ["component", "low", "high"]
    alone = texts.withColumn("low", F.col("block")).withColumn("high", F.col("block")).repartition(*keys).sortWithinPartitions(*keys, "node")
    found = materialise(alone.mapInPandas(lambda frames: scan(frames, False), schema), "verified")
    large = texts.filter("parts > 1")
    if large.isEmpty():
        return found
    stars = found.filter("dst IS NOT NULL").select(F.col("dst").alias("node"), F.col("src").alias("root"))
    labelled = large.join(stars, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    pairs = _block_pairs(labelled, False).repartition(*keys).sortWithinPartitions(*keys, "node")
    return found.unionByName(materialise(pairs.mapInPandas(lambda frames: scan(frames, True), schema), "across"))


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """Per row: id, text_hash, class_id, rep_id, n_links, kept.

    Two rows are linked when the Jaccard similarity of their sets of ``width``
    word shingles (white space divides words) is at least ``threshold``; rows
    with equal sets are linked too. ``class_id`` is the smallest id among the
    rows that links connect, ``rep_id`` the smallest id of the rows with an
    equal set, ``n_links`` the number of linked rows. Of each class one row is
    ``kept``, that of ``class_id``. A text without words (null, empty) links to
    nothing and is kept. Repeated rows count as rows; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    rows = materialise(_set_table(docs, width), "sets")
    reps = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("id", "th")).alias("row"), F.min("id").alias("rep_id"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("size").alias("size"))
    # Node numbers are told apart by place, not by hash, and are fixed once the table is written.
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    groups = connected_components(_candidate_edges(reps, threshold))
    known = groups.join(reps, "node")
    sizes = known.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    members = known.join(sizes, "component").withColumn("block", _block("node", "parts")).select("component", "parts", "block", "node", "copies", "sig", F.col("row.id").alias("row_id"), F.col("row.th").alias("row_th"))
    # One row of each equal set gives the text; hot copies stay out of the join.
    texts = docs.join(members, docs["id"].eqNullSafe(members["row_id"]) & (docs["th"] == members["row_th"])).dropDuplicates(["node"])
    found = _verified(materialise(texts.drop("th", "id", "row_id", "row_th"), "texts"), threshold, width)
    counts = found.filter("dst IS NULL").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("dst IS NOT NULL"))
    linked = classes.join(reps.select("node", "key", "rep_id"), "node")
    names = linked.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("none"), "rep_id", "key")).alias("first"), F.count("*").alias("members"))
    names = materialise(names.select("component", "members", F.col("first.rep_id").alias("class_id"), F.col("first.key").alias("class_key")), "names")
    named = spread_join(linked.select("node", "component"), names, "component", "members", "node").select("node", "class_id", "class_key")
    facts = reps.select("node", "key", "rep_id", "copies").join(counts, "node", "left").join(named, "node", "left")
    single = F.col("class_key").isNull()
    facts = materialise(
        facts.select(
            "key", "rep_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(single, F.col("rep_id")).otherwise(F.col("class_id")).alias("class_id"), (single | (F.col("key") == F.col("class_key"))).alias("first"),
        ), "facts",
    )
    numbered = rows.select("id", F.col("th").alias("text_hash"), "key").withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("text_hash")))
    told = spread_join(numbered.filter("key IS NOT NULL"), facts, "key", "copies", "id", "text_hash")
    told = told.select("id", "text_hash", "class_id", "rep_id", "n_links", (F.col("first") & F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("nth") == 1)).alias("kept"))
    alone = rows.filter("key IS NULL").select("id", F.col("th").alias("text_hash"), F.col("id").alias("class_id"), F.col("id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return told.unionByName(alone).withColumnRenamed("id", id_col)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = SHINGLE) -> DataFrame:
    """Whole rows without those that a class's kept row stands for; all columns of ``df``.

    Rows are told apart by id and text; a row repeated exactly stays repeated
    unless exact deduplication went before. Null and empty texts stay; an empty
    table gives an empty result.
    """
    rated = jaccard_classes(df, id_col, text_col, threshold, width).groupBy(F.col(id_col).alias("id"), F.col("text_hash").alias("th")).agg(F.max("kept").alias("kept"))
    # A repeated row has one copy kept at most; its id and text are gone only if no copy is.
    gone = rated.filter(~F.col("kept")).select("id", "th")
    rows = df.select(whole_row(df).alias("row"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("hash"))
    return rows.join(gone, (F.col("own").eqNullSafe(F.col("id"))) & (F.col("hash") == F.col("th")), "left_anti").select("row.*")
