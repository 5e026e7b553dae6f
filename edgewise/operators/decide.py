"""Decision rules over tables of results: one verdict row out."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw
from edgewise.functions.shared import materialise
from edgewise.operators.metrics import ap_auroc


def fold_promotion(folds: DataFrame, least_gain: float, least_positive: int, most_drop: float) -> DataFrame:
    """Mean gain, folds with a gain, worst fold, and the verdict. ``folds`` has control, candidate."""
    gain = F.col("candidate") - F.col("control")
    agg = folds.agg(F.count("*").alias("folds"), F.avg(gain).alias("mean_gain"), F.sum((gain > 0).cast("long")).alias("positive_folds"), F.min(gain).alias("worst"))
    return agg.withColumn("promote", (F.col("mean_gain") >= least_gain) & (F.col("positive_folds") >= least_positive) & (F.col("worst") >= -most_drop))


def practical_gain(rows: DataFrame, delta: float, margin: float) -> DataFrame:
    """``rows`` has point, low, control_point, auroc_low; all four conditions and the verdict."""
    c = {"large_enough": F.col("point") >= delta, "above_zero": F.col("low") > 0, "beyond_control": F.col("point") > F.col("control_point"), "auroc_held": F.col("auroc_low") > -margin}
    out = rows.withColumns(c)
    return out.withColumn("accept", F.col("large_enough") & F.col("above_zero") & F.col("beyond_control") & F.col("auroc_held"))


def interval_verdict(low: Column, high: Column, margin: float | Column) -> Column:
    """Superior, inferior, equivalent, not inferior or open, from an interval and a margin."""
    return F.when(low.isNull() | high.isNull(), "no support").when(low > 0, "superior").when(high < -margin, "inferior").when((low > -margin) & (high < margin), "equivalent").when(low > -margin, "not inferior").otherwise("open")


def support_floors(df: DataFrame, group: list[str], floors: dict[str, tuple[Column, int]]) -> DataFrame:
    """Counts per group, and whether each meets its floor."""
    counts = df.groupBy(*group).agg(*[c.alias(n) for n, (c, _) in floors.items()])
    ok = F.lit(True)
    for n, (_, least) in floors.items():
        ok = ok & (F.col(n) >= least)
    return counts.withColumn("supported", ok)


def swap_credit(quartets: DataFrame, scores: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """E5: 1 where a quartet's positives outscore its crossings, one half within a relative tolerance, else 0.

    ``scores`` has a, b, score; a score that is a sum over ends always gets one half.
    """
    def named(x: str, y: str, name: str) -> DataFrame:
        return scores.select(F.col("a").alias(x), F.col("b").alias(y), F.col("score").alias(name))

    q = quartets.join(named("a", "b", "ab"), ["a", "b"]).join(named("c", "d", "cd"), ["c", "d"]).join(named("a", "d", "ad"), ["a", "d"]).join(named("c", "b", "cb"), ["c", "b"])
    gap = F.col("ab") + F.col("cd") - F.col("ad") - F.col("cb")
    scale = F.greatest(F.abs("ab") + F.abs("cd"), F.abs("ad") + F.abs("cb"), F.lit(1e-300))
    return q.select("a", "b", "c", "d", F.when(F.abs(gap) <= tolerance * scale, 0.5).when(gap > 0, 1.0).otherwise(0.0).alias("credit"))


def capped_quartets(quartets: DataFrame, entity_cap: int, most: int, salt: str = "quartet", max_rounds: int | None = None, edge_cap: int | None = None) -> DataFrame:
    """Quartets in hash order while no entity is used over ``entity_cap`` times and no positive edge (a, b), (c, d) over ``edge_cap`` times, ``most`` in all.

    Rounds as in capped negatives: a quartet is taken when its rank within all
    its members and edges fits what is left of their caps. Ends when no quartet
    fits any more; ``max_rounds`` raises where it would end before that.
    """
    own = ["a", "b", "c", "d", "h"]
    member = lambda c: F.struct(F.lit("m").alias("kind"), F.col(c).cast("string").alias("one"), F.lit("").alias("two"))
    edge = lambda x, y: F.struct(F.lit("e").alias("kind"), F.col(x).cast("string").alias("one"), F.col(y).cast("string").alias("two"))
    keys = [member(c) for c in own[:4]] + ([edge("a", "b"), edge("c", "d")] if edge_cap is not None else [])
    left = materialise(quartets.withColumn("h", hash_draw(F.concat_ws(":", F.lit(salt), "a", "b", "c", "d"))).select(*own), "quartets")
    uses = lambda df: df.select(*own, F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    cap = F.when(F.col("key.kind") == "m", F.lit(entity_cap)).otherwise(F.lit(edge_cap or 0))
    room = materialise(uses(left).select("key").distinct().withColumn("room", cap.cast("long")), "room")
    taken = None
    for k in count():
        if max_rounds is not None and k > max_rounds:
            raise RuntimeError(f"quartets did not settle in {max_rounds} rounds")
        # A quartet is open while all its keys have room; only open ones are ranked.
        alive = uses(left).join(room, "key", "left")
        open_ = alive.groupBy(*own).agg(F.min(F.coalesce("room", F.lit(0))).alias("least")).filter("least > 0").drop("least")
        order = F.row_number().over(Window.partitionBy("key").orderBy("h", "a", "b", "c", "d"))
        ranked = uses(open_).withColumn("rank", order).join(room, "key")
        marked = materialise(ranked.groupBy(*own).agg(F.min((F.col("rank") <= F.col("room")).cast("int")).alias("take")), "round")
        now = marked.filter("take = 1").select(*own)
        if now.isEmpty():
            break
        taken = now if taken is None else taken.union(now)
        used = uses(now).groupBy("key").agg(F.count("*").alias("used"))
        room = materialise(room.join(used, "key", "left").select("key", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).filter("room > 0"), "room")
        left = marked.filter("take = 0").select(*own)
    chosen = taken if taken is not None else left.limit(0)
    return chosen.orderBy("h", "a", "b", "c", "d").limit(most).select("a", "b", "c", "d")


def paired_comparison(rows: DataFrame, control: str, candidate: str, stratum: str, label: str = "y") -> DataFrame:
    """Per stratum, both scores' metrics on the same rows and their differences."""
    long = rows.select(stratum, label, F.explode(F.array(F.struct(F.lit("control").alias("model"), F.col(control).alias("score")), F.struct(F.lit("candidate").alias("model"), F.col(candidate).alias("score")))).alias("m")).select(stratum, label, "m.model", "m.score")
    per = ap_auroc(long, [stratum, "model"], "score", label)
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return per.groupBy(stratum).agg(pick("control", "ap").alias("control_ap"), pick("candidate", "ap").alias("candidate_ap"), (pick("candidate", "ap") - pick("control", "ap")).alias("ap_gain"), (pick("candidate", "auroc") - pick("control", "auroc")).alias("auroc_gain"))


def leave_group_out(rows: DataFrame, group: str, k: int, score: str = "score", label: str = "y") -> DataFrame:
    """AP without each of the ``k`` most frequent groups, and with all rows (``none``)."""
    top = rows.groupBy(group).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), group).limit(k).select(F.col(group).alias("left_out"))
    # A row counts for every left-out group but its own; the k names are broadcast as one array.
    names = top.agg(F.collect_list("left_out").alias("__names"))
    each = rows.crossJoin(F.broadcast(names)).select(score, label, F.explode(F.concat(F.array(F.lit("none")), F.filter("__names", lambda n: n != F.col(group)))).alias("left_out"))
    return ap_auroc(each, ["left_out"], score, label).select("left_out", "ap", "auroc")


def null_adequacy(rows: DataFrame, changed: str, level: str) -> DataFrame:
    """Rows of each level and the share whose permutation changed at least half."""
    return rows.groupBy(level).agg(F.count("*").alias("rows"), F.avg((F.col(changed) >= 0.5).cast("double")).alias("adequate"))
