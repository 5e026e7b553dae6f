"""Component-safe splits and folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw
from edgewise.functions.shared import materialise

#: Components of one size that one ranking window holds, on average.
RANK_BLOCK = 10_000
#: Components of one range of the hash order; size above which a component is a step of its own.
SCAN_ROWS, LARGE = 200_000, 1 << 14


def must_link_edges(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """C1 input: edges between each member and its family's smallest member, and qualifying hits."""
    least = entities.filter("family IS NOT NULL").groupBy("family").agg(F.min("entity").alias("src"))
    family = entities.join(least, "family").select("src", F.col("entity").alias("dst"))
    return family.union(hits.select(F.col("q").alias("src"), F.col("t").alias("dst"))).filter("src <> dst")


def with_components(entities: DataFrame, components: DataFrame) -> DataFrame:
    """Every entity with its component; one without edges is a component of its own."""
    return entities.join(components.withColumnRenamed("node", "entity"), "entity", "left").withColumn("component", F.coalesce("component", "entity"))


def contracted_graph(hits: DataFrame, components: DataFrame) -> DataFrame:
    """Per pair of components the greatest rounded score per hundred letters, 1 at least."""
    own = components.select(F.col("node"), F.col("component"))
    joined = hits.join(own.select(F.col("node").alias("q"), F.col("component").alias("cq")), "q").join(own.select(F.col("node").alias("t"), F.col("component").alias("ct")), "t").filter("cq <> ct")
    weight = F.greatest(F.lit(1), F.floor(100 * F.col("bits") / F.least("qlen", "tlen") + 0.5)).cast("long")
    return joined.groupBy(F.least("cq", "ct").alias("lo"), F.greatest("cq", "ct").alias("hi")).agg(F.max(weight).alias("weight"))


def _items_up_to(loads: list[int], size: int, value: int) -> list[int]:
    return [0 if value < x else (value - x) // size + 1 for x in loads]


def _after(loads: list[int], size: int, n: int) -> list[int]:
    """Loads after ``n`` pieces of one size, each to the least-loaded fold, the first of equals."""
    low, high = min(loads), min(loads) + size * n
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if sum(_items_up_to(loads, size, middle)) >= n else (middle + 1, high)
    counts = _items_up_to(loads, size, low - 1)
    spare = n - sum(counts)
    for k, x in enumerate(loads):
        if spare and low >= x and (low - x) % size == 0:
            counts[k], spare = counts[k] + 1, spare - 1
    return [x + size * c for x, c in zip(loads, counts, strict=True)]


def _turns(loads: list[int], size: int) -> list[tuple[int, list[int]]]:
    """From which rank on which folds take turns: the least-loaded ones alone, until they reach the next load."""
    order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    start, out = 0, []
    for k, f in enumerate(order):
        level = loads[f]
        first = {g: loads[g] + -(-(level - loads[g]) // size) * size for g in order[: k + 1]}
        after = loads[order[k + 1]] if k + 1 < len(order) else None
        if after is None or after > level:
            out.append((start, sorted(first, key=lambda g: (first[g], g))))
            start += sum(max(0, -(-(after - v) // size)) for v in first.values()) if after is not None else 0
    return out


def least_loaded_folds(members: DataFrame, folds: int, salt: str = "fold", component: str = "component", stratum: str | None = None) -> DataFrame:
    """Whole components, largest first, each to the fold with the fewest members so far.

    Equal sizes go in hash order, equal loads to the first fold. With
    ``stratum`` (a component has one; C5: its label) each stratum is dealt on
    its own, so that folds are alike in every stratum. Components of one size
    are ranked in blocks of their hash, and a rank gives its fold directly: the
    driver only follows the loads from size to size, and there are no more
    sizes than the root of twice the members. A component in two strata is an
    error.
    """
    spark = members.sparkSession
    strata = F.col(stratum) if stratum else F.lit(0)
    sizes = members.groupBy(component).agg(F.count("*").alias("size"), F.min(strata).alias("stratum"), F.max(strata).alias("most"))
    draw = hash_draw(F.concat_ws(":", F.lit(salt), F.col(component).cast("string")))
    sizes = materialise(sizes.withColumn("h", draw), "sizes")
    if stratum and not sizes.filter("stratum <> most").isEmpty():
        raise ValueError(f"a component has two values of {stratum}")
    classes: list[tuple] = []
    loads: dict[object, list[int]] = {}
    for r in sizes.groupBy("stratum", "size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # a row a size and stratum
        now = loads.setdefault(r["stratum"], [0] * folds)
        classes.append((r["stratum"], r["size"], _turns(now, r["size"]), -(-r["n"] // RANK_BLOCK)))
        loads[r["stratum"]] = _after(now, r["size"], r["n"])
    kind = sizes.schema["stratum"].dataType.simpleString()
    table = spark.createDataFrame(classes, f"stratum {kind}, size long, turns array<struct<start: long, folds: array<int>>>, blocks long")
    placed = sizes.drop("most").join(F.broadcast(table), ["stratum", "size"])
    placed = placed.withColumn("block", F.floor(F.col("h") / float(1 << 60) * F.col("blocks")))
    key = ["stratum", "size", "block"]
    ahead = F.sum("n").over(Window.partitionBy("stratum", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(ahead, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("h", component)) - 1
    ranked = placed.withColumn("within", within).join(starts, key).withColumn("rank", F.col("start") + F.col("within"))
    turn = F.element_at(F.filter("turns", lambda t: t["start"] <= F.col("rank")), -1)
    fold = F.element_at(turn["folds"], ((F.col("rank") - turn["start"]) % F.size(turn["folds"]) + 1).cast("int"))
    return members.join(ranked.select(component, fold.cast("int").alias("fold")), component)


def _ends(sizes: np.ndarray, reach: int) -> np.ndarray:
    """What each load difference -reach..reach becomes along ``sizes``: a size goes on top where the difference isn't above 0, and else off it.

    Differences that have met stay together, so that only distinct ones are
    carried on; sizes are at most ``reach``, so none leaves the range.
    """
    now, back = np.arange(-reach, reach + 1, dtype=np.int64), np.arange(2 * reach + 1)
    for k, size in enumerate(sizes.tolist()):
        now = np.where(now <= 0, now + size, now - size)
        if k % 16 == 0 and len(now) > 1:
            now, again = np.unique(now, return_inverse=True)
            back = again[back]
    return now[back]


def _sides(sizes: list[int], difference: int) -> tuple[list[int], int]:
    out = []
    for size in sizes:
        side = int(difference > 0)
        out.append(side)
        difference += -size if side else size
    return out, difference


def _steps(sizes: np.ndarray, large: int) -> list[tuple[int, int]]:
    """Runs (from, to) of small components and single large ones, in order."""
    cuts, out, at = np.flatnonzero(sizes > large).tolist(), [], 0
    for k in cuts:
        out += ([(at, k)] if k > at else []) + [(k, k + 1)]
        at = k + 1
    return out + ([(at, len(sizes))] if at < len(sizes) else [])


def hash_order_sides(members: DataFrame, salt: str = "side", component: str = "component", rows: int = SCAN_ROWS, large: int = LARGE) -> DataFrame:
    """Whole components in hash order, each to side 1 while that has fewer members than side 0, and else to side 0; members with ``side``.

    What a loop over all components gives, as a scan over ranges of the hash
    order. Only the difference of the two loads matters, and behind a component
    it is at most that component's size away from where it turned. So a range
    is a table from difference to difference. Ranges work out their tables side
    by side, the driver follows one difference through them (a lookup a range),
    and ranges replay their components from it. Components over ``large`` are
    steps of their own; a run behind one may be met by a difference outside its
    table, which is plain arithmetic unless the run evens it out: then that
    run alone is walked, at most once a large component.
    """
    sizes = materialise(members.groupBy(F.col(component).alias("component")).agg(F.count("*").alias("size")).withColumn("h", hash_draw(F.concat_ws(":", F.lit(salt), F.col("component").cast("string")))), "sizes")
    n, reach = sizes.agg(F.count("*"), F.coalesce(F.max(F.when(F.col("size") <= large, F.col("size"))), F.lit(1))).first()
    ranges = max(1, -(-n // rows))
    placed = materialise(sizes.repartitionByRange(ranges, "h", "component").withColumn("part", F.spark_partition_id()), "placed")
    kind = placed.schema["component"].dataType.simpleString()

    def tables(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("component", "ascending")])
        own, part = table["size"].to_numpy(), table["part"][0].as_py()
        rows = [{"part": part, "step": k, "total": int(own[a:b].sum()), "ends": None if own[a] > large else _ends(own[a:b], reach).tolist()} for k, (a, b) in enumerate(_steps(own, large))]
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("step", pa.int32()), ("total", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    def walked(part: int, step: int, difference: int) -> int:
        def walk(table: pa.Table) -> pa.Table:
            own = table.sort_by([("h", "ascending"), ("component", "ascending")])["size"].to_numpy()
            a, b = _steps(own, large)[step]
            return pa.table({"end": pa.array([_sides(own[a:b].tolist(), difference)[1]], pa.int64())})

        return placed.filter(F.col("part") == part).groupBy("part").applyInArrow(walk, "end long").first()["end"]

    difference, starts = 0, {}
    steps = placed.groupBy("part").applyInArrow(tables, "part int, step int, total long, ends array<long>")
    for r in materialise(steps, "steps").orderBy("part", "step").toLocalIterator():  # a table a range, and a row a large component
        starts.setdefault(r["part"], []).append(difference)
        if r["ends"] is None:
            difference += -r["total"] if difference > 0 else r["total"]
        elif -reach <= difference <= reach:
            difference = r["ends"][difference + reach]
        elif abs(difference) >= r["total"]:
            difference += -r["total"] if difference > 0 else r["total"]
        else:
            difference = walked(r["part"], r["step"], difference)

    def replay(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("component", "ascending")])
        sides, _ = _sides(table["size"].to_pylist(), starts[table["part"][0].as_py()][0])
        return pa.table({"__component": table["component"], "side": pa.array(sides, pa.int32())})

    sides = placed.groupBy("part").applyInArrow(replay, f"__component {kind}, side int")
    return members.join(sides, F.col(component).eqNullSafe(F.col("__component"))).drop("__component")


def pair_roles(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The fold of both ends, or ``crossing``; ``unassigned`` where an end has no fold. No pair is lost."""
    own = members.select("entity", "fold")
    joined = pairs.join(own.select(F.col("entity").alias("a"), F.col("fold").alias("fa")), "a", "left").join(own.select(F.col("entity").alias("b"), F.col("fold").alias("fb")), "b", "left")
    role = F.when(F.col("fa").isNull() | F.col("fb").isNull(), "unassigned").when(F.col("fa") == F.col("fb"), F.col("fa").cast("string")).otherwise("crossing")
    return joined.withColumn("role", role)


def fold_membership(pairs: DataFrame, members: DataFrame, folds: int) -> DataFrame:
    """C4: per fold the pairs with 0, 1 and 2 ends in it (train, crossing, validation)."""
    roles = pair_roles(pairs, members)
    each = roles.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    inside = F.coalesce((F.col("fa") == F.col("fold")).cast("int"), F.lit(0)) + F.coalesce((F.col("fb") == F.col("fold")).cast("int"), F.lit(0))
    return each.groupBy("fold", inside.alias("ends_inside")).agg(F.count("*").alias("rows"))


def retention(pairs: DataFrame, group_a: Column, group_b: Column) -> DataFrame:
    """Pairs inside each group and between groups."""
    return pairs.groupBy(F.least(group_a, group_b).alias("lo"), F.greatest(group_a, group_b).alias("hi")).agg(F.count("*").alias("rows")).withColumn("kept", F.col("lo") == F.col("hi"))
