"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.shared import discard, fresh_path, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every endpoint.

    Each round takes the least label among the neighbours and then the label's
    own label, and is written to the shared folder, so lineage stays short and
    a lost executor costs one round; the round before it is deleted. Self edges
    give components of one; edges with a null end are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    once = fresh_path(spark, "edges")
    both = materialise(pairs.union(pairs.select("v", "u")).distinct(), path=once)
    place = fresh_path(spark, "labels")
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")), path=place)
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        before, place = place, fresh_path(spark, "labels")
        moved = materialise(hooked.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")), path=place)
        discard(spark, before)
        labels = moved.select("node", "label")
        if moved.filter("old <> label").isEmpty():
            discard(spark, once)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


#: Rows from which a node can be a hub; a hub has over one row in ``HUB_SHARE``.
HUB_ROWS, HUB_SHARE = 10_000, 1000


def _hubs(edges: DataFrame, rows: int) -> DataFrame | None:
    """Hubs of ``edges`` (u, v), ``rows`` of them at most, each with ``m``, the least of u and its neighbours v; fewer than ``HUB_SHARE`` by their definition."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    found = least.filter(F.col("n") > max(HUB_ROWS, rows // HUB_SHARE)).select("u", "m").collect() if rows > HUB_ROWS else []
    return edges.sparkSession.createDataFrame(found, least.select("u", "m").schema) if found else None


def _beside_least(edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``edges`` (u, v) with ``m``, the least of u and its neighbours v.

    Hubs get theirs from a broadcast table, so no task holds a whole hub; the
    others' edges are shuffled once.
    """
    beside = F.least("u", F.min("v").over(Window.partitionBy("u")))
    if hubs is None:
        return edges.withColumn("m", beside)
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest.withColumn("m", beside))


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> tuple[DataFrame, list[int]]:
    """``node`` and ``component`` (its smallest node) by alternating large and small stars, and the edges left after each round.

    A large star ties a node's larger neighbours to the least of its
    neighbourhood, a small star a node and its smaller neighbours; repeated
    edges merge, until each component is one star. A long path takes rounds by
    the logarithm of its length. Each round is written to the shared folder, so
    a lost executor costs one round; the tables before it are deleted. Self
    edges give components of one; edges with a null end are left out.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    every = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    facts = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest"))
    now = every.filter("u <> v")
    before, counts, spent = now.agg(*facts).first(), [], []
    while True:
        if len(counts) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        every_way = now.union(now.select("v", "u"))
        hubs = _hubs(every_way, 2 * before["n"])
        large = _beside_least(every_way, hubs).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Edges go from a node to a smaller one, which is what small stars start from.
        spent.append(fresh_path(spark, "large"))
        large = materialise(large, path=spent[-1])
        # A node has at most as many edges here as before, so without hubs there are none.
        small = _beside_least(large, _hubs(large, before["n"]) if hubs is not None else None)
        both = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        place = fresh_path(spark, "stars")
        now = materialise(small.select(F.explode(both).alias("e")).select("e.*").filter("u <> v").distinct(), path=place)
        for path in spent:
            discard(spark, path)
        after, spent = now.agg(*facts).first(), [place]
        counts.append(after["n"])
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    ends = every.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return ends.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component")), counts
