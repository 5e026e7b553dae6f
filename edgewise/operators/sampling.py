"""Deterministic samples, negative pairs and batch plans, all by hash order."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw
from edgewise.functions.shared import discard, fresh_path, materialise, passing_shuffles
from edgewise.operators.metrics import running_sums, spearman
from edgewise.operators.pairs import canonical_pair, entity_degrees


def _draw(salt: str, column: str):
    return hash_draw(F.concat_ws(":", F.lit(salt), F.col(column).cast("string")))


def proportional_sample(df: DataFrame, strata: list[str], size: int, row: str, salt: str) -> DataFrame:
    """``size`` rows, each stratum its share: floors first, then the largest remainders; hash order inside."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n").alias("__total"))  # one row
    quotas = sizes.crossJoin(F.broadcast(total)).withColumns({"__base": F.floor(size * F.col("__n") / F.col("__total")), "__rest": (size * F.col("__n")) % F.col("__total")})
    spare = size - F.sum("__base").over(Window.partitionBy())  # one row a stratum
    place = F.row_number().over(Window.orderBy(F.desc("__rest"), *strata))
    quotas = quotas.select(*strata, (F.col("__base") + F.when(place <= spare, 1).otherwise(0)).alias("__quota"))
    # Only rows whose hash can be among the quota's least are ranked: six deviations over the quota's share of the stratum.
    quotas = materialise(quotas.join(sizes, strata).withColumn("__share", (F.col("__quota") + 6 * F.sqrt("__quota") + 36) / F.col("__n")).drop("__n"), "quotas")
    few = df.join(F.broadcast(quotas), strata).withColumn("__h", _draw(salt, row)).filter(F.col("__h") < F.col("__share") * float(1 << 60))
    kept = few.withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", row))).filter("__place <= __quota")
    short = kept.groupBy(*strata).agg(F.count("*").alias("__k")).join(F.broadcast(quotas), strata, "right").filter(F.coalesce("__k", F.lit(0)) < F.col("__quota"))
    if not short.isEmpty():  # a hash that uneven is met once in a thousand million strata: rank all
        kept = df.join(F.broadcast(quotas), strata).withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy(_draw(salt, row), row))).filter("__place <= __quota")
    return kept.select(*df.columns)


def round_robin(df: DataFrame, group: str, family: str, row: str, k: int, salt: str, family_salt: str) -> DataFrame:
    """Take turns over a group's families: first of each, second of each, ... the first ``k``."""
    inside = F.row_number().over(Window.partitionBy(group, family).orderBy(_draw(salt, row), row))
    ranked = df.withColumn("__turn", inside).filter(F.col("__turn") <= k)  # later turns can't be among the first k
    place = F.row_number().over(Window.partitionBy(group).orderBy("__turn", _draw(family_salt, family), family))
    return ranked.withColumn("place", place).filter(F.col("place") <= k).drop("__turn")


def decile_sample(df: DataFrame, row: str, value: str, k: int, salt: str) -> DataFrame:
    """``k`` rows in hash order of each tenth by value.

    Places come from counts of each value, summed in ranges of values, so that
    no task sorts all rows; the rows of one value share a window.
    """
    sizes = running_sums(df.groupBy(value).agg(F.count("*").alias("__n")), [], value, ["__n"])
    starts = sizes.select(value, (F.col("cum___n") - F.col("__n")).alias("__start"))
    total = df.agg(F.count("*").alias("__all"))
    within = F.row_number().over(Window.partitionBy(value).orderBy(row)) - 1
    placed = df.withColumn("__within", within).join(starts, value).crossJoin(F.broadcast(total)).withColumn("__at", F.col("__start") + F.col("__within"))
    # The first (all mod 10) tenths have one row more.
    small, extra = F.floor(F.col("__all") / 10), F.col("__all") % 10
    edge = extra * (small + 1)
    decile = F.when(F.col("__at") < edge, F.floor(F.col("__at") / (small + 1)) + 1).otherwise(extra + F.floor((F.col("__at") - edge) / F.greatest(small, F.lit(1))) + 1)
    tagged = placed.withColumn("decile", decile).drop("__within", "__start", "__all", "__at")
    return tagged.withColumn("place", F.row_number().over(Window.partitionBy("decile").orderBy(_draw(salt, row), row))).filter(F.col("place") <= k)


def hash_cut(df: DataFrame, k: int, h: str = "h") -> int | None:
    """A hash up to which there are ``k`` rows at most, and no row more would be: none where the first hash has more.

    Rows are counted by the first 16 of 60 bits; only hashes of the one slice
    that the cut falls into are counted singly.
    """
    at = F.shiftright(h, 44)
    before, cut = 0, None
    for r in sorted(df.groupBy(at.alias("slice")).agg(F.count("*").alias("n")).collect()):
        if before + r["n"] > k:
            counts = running_sums(df.filter(at == r["slice"]).groupBy(h).agg(F.count("*").alias("n")), [], h, ["n"])
            inside = counts.filter(F.col("cum_n") <= k - before).agg(F.max(h)).first()[0]
            return cut if inside is None else inside
        before, cut = before + r["n"], ((r["slice"] + 1) << 44) - 1
    return cut


def first_by_hash(df: DataFrame, k: int, h: str = "h") -> DataFrame:
    """The ``k`` rows of the least ``h``, a hash of the row."""
    cut = hash_cut(df, k, h)
    return df.filter(F.col(h) <= cut) if cut is not None else df.limit(0)


def negative_candidates(positives: DataFrame, factor: float, blacklist: DataFrame | None = None, salt: str = "neg", annotations: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """``factor`` times as many pairs as positives: new ones, without selves, positives and blacklisted.

    Both ends are drawn as often as entities are ends of positives: each
    positive offers its ends, and a hash deals the offers against each other,
    block by block, without a global order. Rounds go on until the pool is
    large enough. Pairs whose ends share an annotation (``annotations``:
    entity, annots) come first, others fill up; each part in hash order. Where
    there are fewer pairs than wanted, all are wanted. A pool that ``max_rounds``
    do not fill is an error. No table of pairs or entities is broadcast: their
    files are far smaller than they are in the driver's memory.
    """
    with passing_shuffles(positives.sparkSession):
        return _negative_candidates(positives, factor, blacklist, salt, annotations, max_rounds)


def _negative_candidates(positives: DataFrame, factor: float, blacklist: DataFrame | None, salt: str, annotations: DataFrame | None, max_rounds: int) -> DataFrame:
    spark = positives.sparkSession
    paths = {name: fresh_path(spark, name) for name in ("positives", "forbidden", "pool")}
    bad = canonical_pair(positives).select("lo", "hi")
    known = materialise(bad.distinct(), path=paths["positives"])
    if blacklist is not None:
        bad = bad.union(canonical_pair(blacklist).select("lo", "hi"))
    bad = materialise(bad.distinct(), path=paths["forbidden"]) if blacklist is not None else known
    ends = known.select("lo", "hi", F.posexplode(F.array("lo", "hi")).alias("side", "end"))
    n, entities = known.count(), ends.select("end").distinct().count()
    target = min(round(factor * n), entities * (entities - 1) // 2 - bad.filter("lo <> hi").count())
    blocks, path, have = max(1, 2 * n // 4096), paths["pool"], 0
    for k in range(max_rounds):
        if have >= target:
            break
        copies = max(1, -(-2 * (target - have) // (2 * n)))
        slots = ends.select("end", F.concat_ws(":", F.lit(f"{salt}{k}"), "lo", "hi", F.col("side").cast("string")).alias("key"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("c"))
        draw = lambda x: hash_draw(F.concat(F.lit(x), F.concat_ws(":", "key", F.col("c").cast("string"))))
        # A slot goes to its block once, with both its places; a left place meets the right one of the same number there.
        dealt = slots.select("end", (draw("block:") % blocks).alias("block"), draw("l:").alias("l"), draw("r:").alias("r"))
        place = lambda x: F.row_number().over(Window.partitionBy("block").orderBy(x, "end"))
        sides = F.explode(F.array(F.struct(F.col("left").alias("k"), F.lit(0).alias("right")), F.struct(F.col("right").alias("k"), F.lit(1).alias("right")))).alias("x")
        places = dealt.select("block", "end", place("l").alias("left"), place("r").alias("right")).select("block", "end", sides).select("block", "end", "x.k", "x.right")
        drawn = places.select("right", F.col("end").alias("a"), F.lead("end").over(Window.partitionBy("block").orderBy("k", "right")).alias("b")).filter("right = 0 AND a <> b")
        new = canonical_pair(drawn).select("lo", "hi").distinct().join(bad.hint("merge"), ["lo", "hi"], "left_anti")
        new = new.join(spark.read.parquet(path).hint("merge"), ["lo", "hi"], "left_anti") if k else new
        new.write.mode("append").option("compression", "zstd").parquet(path)
        have = spark.read.parquet(path).count()
    if have < target:
        raise RuntimeError(f"{have} candidates after {max_rounds} rounds; {target} are wanted")
    for name in ("positives", "forbidden"):
        discard(spark, paths[name])
    pool = spark.read.parquet(path).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pool_hash = hash_draw(F.concat_ws(":", F.lit(f"{salt}-first"), "a", "b"))
    if annotations is None:
        return first_by_hash(pool.withColumn("h", pool_hash), target).select("a", "b")
    one, two = (annotations.select(F.col("entity").alias(x), F.col("annots").alias(f"n_{x}")) for x in ("a", "b"))
    told = pool.join(one.hint("merge"), "a", "left").join(two.hint("merge"), "b", "left").select("a", "b", F.coalesce(F.arrays_overlap("n_a", "n_b"), F.lit(False)).alias("related"))
    told = materialise(told.withColumn("h", pool_hash), "told")
    discard(spark, path)
    first = first_by_hash(told.filter("related"), target)
    rest = target - first.count()
    return (first.unionByName(first_by_hash(told.filter("NOT related"), rest)) if rest else first).select("a", "b")


def degree_capped(candidates: DataFrame, positives: DataFrame, cap: int, salt: str = "cap", max_rounds: int | None = None, target: int | None = None) -> DataFrame:
    """Candidates in hash order while no entity has over ``cap`` times its positive degree.

    Rounds: a candidate whose rank within both ends is inside both remaining
    caps is taken, as going through the candidates one after the other would.
    Ends when no candidate is open. With ``target``, it is the first that many
    of the same order: stretches of the order are settled one after the other,
    the first a quarter longer than ``target`` and each as long as all before
    it, so candidates behind the last taken are hardly ever ranked. Too few are
    an error. ``max_rounds`` raises where it would end before that. Candidates
    are distinct.
    """
    with passing_shuffles(candidates.sparkSession):
        return _degree_capped(candidates, positives, cap, salt, max_rounds, target)


def _degree_capped(candidates: DataFrame, positives: DataFrame, cap: int, salt: str, max_rounds: int | None, target: int | None) -> DataFrame:
    spark, rounds = candidates.sparkSession, count()
    room = entity_degrees(positives.withColumn("y", F.lit(1)).select("a", "b", "y")).select("entity", (F.col("pos") * cap).alias("room"))
    whole = materialise(candidates.withColumn("h", hash_draw(F.concat_ws(":", F.lit(salt), "a", "b"))), path=(path := fresh_path(spark, "candidates")))
    rows = whole.count() if target is not None else None
    taken, have, after, size = None, 0, None, None if target is None else target + target // 4 + 1
    while True:
        upto = hash_cut(whole, size) if size is not None and size < rows else None
        left = whole
        if after is not None:
            left = left.filter(F.col("h") > after)
        if upto is not None:
            left = left.filter(F.col("h") <= upto)
        while True:
            if max_rounds is not None and next(rounds) > max_rounds:
                raise RuntimeError(f"candidates did not settle in {max_rounds} rounds")
            open_ = left.join(room.select(F.col("entity").alias("a")).hint("merge"), "a", "left_semi").join(room.select(F.col("entity").alias("b")).hint("merge"), "b", "left_semi")
            # An entity's uses at either end count together.
            uses = open_.select("a", "b", "h", F.explode(F.array("a", "b")).alias("entity")).withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy("h", "a", "b")))
            marked = materialise(uses.join(room.hint("merge"), "entity").groupBy("a", "b", "h").agg(F.bool_and(F.col("rank") <= F.col("room")).alias("take")), "round")
            now = marked.filter("take").select("a", "b", "h")
            found = now.count()
            if found:
                taken, have = now if taken is None else taken.union(now), have + found
            if not found:
                break
            used = now.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count("*").alias("used"))
            room = materialise(room.join(used.hint("merge"), "entity", "left").select("entity", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).filter("room > 0"), "room")
            left = marked.filter("NOT take").select("a", "b", "h")
            if target is not None and have >= target:
                taken = materialise(first_by_hash(taken, target), "taken")
                have = target
                left = left.filter(F.col("h") < taken.agg(F.max("h")).first()[0]) if target else left.limit(0)
        if upto is None or have >= target:
            break
        after, size = upto, 2 * size
    discard(spark, path)
    if target is not None and have < target:
        raise ValueError(f"{have} candidates fit the caps; {target} are wanted")
    if taken is None:
        return candidates.limit(0)
    return (first_by_hash(taken, target) if target is not None and have > target else taken).select("a", "b")


def balance_report(degrees: DataFrame) -> DataFrame:
    """How negative degrees follow positive ones, over entities with positives."""
    rows = degrees.filter("pos > 0").withColumn("__gap", F.abs(F.col("neg") - F.col("pos")))
    facts = rows.agg(
        F.count("*").alias("entities"), F.sum("__gap").cast("long").alias("residual"), (F.sum("neg") / F.sum("pos")).alias("ratio"),
        F.sum(F.when(F.col("neg") == 0, 1).otherwise(0)).cast("long").alias("absent"), (F.sum(F.col("__gap") / F.log1p("pos")) / F.count("*")).alias("objective"),
    )
    return facts.crossJoin(spearman(rows, [], "pos", "neg"))  # single rows


def length_pool_batches(df: DataFrame, row: str, length: str, size: int, salt: str, batches: int = 50) -> DataFrame:
    """Rows to random pools of ``batches`` batches; inside a pool by length into batches of ``size``; ``turn`` is the batches' random order.

    The number of pools follows the rows, so a pool stays small on any table.
    """
    pools = max(1, -(-df.count() // (batches * size)))
    pooled = df.withColumn("pool", (_draw(salt, row) % pools).cast("int"))
    place = F.row_number().over(Window.partitionBy("pool").orderBy(length, row)) - 1
    return pooled.withColumn("batch", F.floor(place / size)).withColumn("turn", hash_draw(F.concat_ws(":", F.lit(f"{salt}-turn"), F.col("pool").cast("string"), F.col("batch").cast("string"))))


def token_budget_batches(batches: DataFrame, row: str, length: str, budget: int, most: int) -> DataFrame:
    """Split each batch, in length order, into micro-batches of at most ``budget`` padded tokens and ``most`` rows.

    Greedy inside a batch, which is small; batches run in parallel. A row over
    the budget is a micro-batch of its own.
    """
    kinds = dict(batches.dtypes)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([length, row], kind="stable")
        out, k, rows = [], 0, 0
        for n in frame[length]:
            if rows and ((rows + 1) * n > budget or rows >= most):
                k, rows = k + 1, 0
            rows += 1
            out.append(k)
        return frame.assign(micro=out)

    fields = ["pool", "batch", row, length]
    schema = ", ".join(f"`{f}` {kinds[f]}" for f in fields) + ", micro int"
    return batches.select(*fields).groupBy("pool", "batch").applyInPandas(pack, schema)
