"""Mixing sources to target weights by Poisson replication.

Each source's target mean repetition is its target share of the rows over its
own share. A document's count inverts the Poisson distribution at a uniform
number seeded by a hash of its id, so the mix repeats on any cluster. Copies
are then dealt out in one global hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw

from .common import whole_row

#: Distinct sources up to which the rate table may be broadcast.
BROADCAST_SOURCES = 10_000
#: Greatest rate drawn at once; exp(-rate) underflows from about 745 on.
MOST_RATE = 500.0


def source_rates(df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, budget: float = 1.0) -> DataFrame:
    """``source``, rows ``n`` and mean repetition ``rate`` of each source.

    ``weights`` gives target shares; without it the share goes as rows to the
    ``power``. ``budget`` is the rows wanted over the rows there are. A null
    source is a source of its own.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        aim = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        aim = F.lit(0.0)
        for name, weight in weights.items():
            aim = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(aim)
    aimed = sizes.withColumn("aim", aim)
    total = aimed.agg(F.sum("n").alias("all_n"), F.sum("aim").alias("all_aim"))  # one row
    share = F.col("aim") / F.col("all_aim")
    return aimed.crossJoin(F.broadcast(total)).select("source", "n", F.when(F.col("all_aim") > 0, share * F.col("all_n") * budget / F.col("n")).otherwise(0.0).alias("rate"))


def _inverse_poisson(draw: Column, rate: Column) -> Column:
    """The inverse distribution function at ``draw``: cumulative terms at or below it. For rates up to MOST_RATE."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")  # beyond it lies less than one draw in 2**60
    step = lambda s, i: F.struct((s["term"] * rate / (i + 1)).alias("term"), (s["cum"] + s["term"]).alias("cum"), (s["k"] + F.when(s["cum"] + s["term"] <= draw, 1).otherwise(0)).alias("k"))
    start = F.struct(F.exp(-rate).alias("term"), F.lit(0.0).alias("cum"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(0), most - 1), start, step, lambda s: s["k"])


def poisson_count(key: Column, rate: Column) -> Column:
    """Poisson count of any rate, drawn by a hash of ``key``.

    A rate over MOST_RATE is the sum of equal parts below it, each with a draw
    of its own: a sum of Poisson counts is a Poisson count.
    """
    uniform = lambda k: hash_draw(k) / F.lit(float(1 << 60))
    parts = F.ceil(rate / MOST_RATE).cast("int")
    add = lambda s, i: s + _inverse_poisson(uniform(F.concat(F.lit("part:"), i.cast("string"), F.lit(":"), key)), rate / parts)
    return F.when(rate <= MOST_RATE, _inverse_poisson(uniform(key), rate)).otherwise(F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), add))


def mix_sources(
    df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict[str, float] | None = None, power: float = 0.5, budget: float = 1.0, seed: str = "mix",
    partitions: int | None = None, copy_col: str | None = "__copy", order_col: str | None = "__order",
) -> DataFrame:
    """All columns of ``df``, each row once per copy, in one global hash order.

    ``copy_col`` numbers a row's copies and ``order_col`` holds the order; with
    None they are left out, and a column of ``df`` with such a name gives way.
    Repeated rows of one id draw alike. A null id draws as the empty string, a
    null source is a source. Texts may be null, empty or long: they aren't
    read. An empty table gives an empty result.
    """
    rates = source_rates(df, source_col, weights, power, budget).select("source", "rate")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    kept = [c for c in df.columns if c not in (copy_col, order_col)]
    rows = df.select(whole_row(df.select(*[F.col(f"`{c}`") for c in kept])).alias("row"), F.col(source_col).alias("own"), F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    counted = rows.join(rates, F.col("own").eqNullSafe(F.col("source"))).withColumn("n", poisson_count(F.col("key"), F.col("rate"))).filter("n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ordered = copies.select("row", "copy", hash_draw(F.concat(F.lit("order:"), F.col("key"), F.lit(":"), F.col("copy").cast("string"))).alias("place"))
    # The order is even over 60 bits, so its leading part says where a row goes; no range needs to be sampled.
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionById(n, F.floor(F.col("place") / float(1 << 60) * n).cast("int")).sortWithinPartitions("place")
    more = [F.col(c).alias(name) for c, name in (("copy", copy_col), ("place", order_col)) if name]
    return dealt.select("row.*", *more)
