"""Similar rows of an alignment by bit slices: effective depth, exact thinning, joint support.

A row of tokens becomes a mask of its letters and five planes of bits, in words
of 64 columns; the letters that two rows share are one population count a word.
Pairs of rows are met block against block by a join inside generated code, so
nothing is grouped in Python and no task takes an alignment.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw
from edgewise.functions.shared import discard, fresh_path, materialise
from edgewise.operators.align import GAP
from edgewise.operators.metrics import running_sums

#: Bits of a letter's number, columns of a word, rows of a block.
PLANES, WORD, BLOCK = 5, 64, 2048


def _word(tokens: Column, word: int, flag: Callable[[Column], Column]) -> Column:
    """A word of 64 columns with the bits for which ``flag`` of the token holds."""
    part = F.slice(tokens, word * WORD + 1, WORD)
    bits = F.transform(part, lambda t, i: F.when(flag(t), F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def bit_slices(rows: DataFrame, tokens: str = "tokens") -> tuple[DataFrame, int]:
    """All columns but ``tokens``, then per word ``o`` (letters) and ``b0`` to ``b4``, ``letters`` in all; and the number of words.

    Shorter rows have no letters behind their end. Tokens from GAP on are no letters.
    """
    most = rows.agg(F.max(F.size(tokens))).first()[0] or 0
    words = max(1, -(-most // WORD))
    t, columns = F.col(tokens), {}
    for w in range(words):
        columns[f"o_{w}"] = _word(t, w, lambda x: x < GAP)
        for p in range(PLANES):
            columns[f"b{p}_{w}"] = _word(t, w, lambda x, p=p: (x < GAP) & (F.shiftright(x, p).bitwiseAND(F.lit(1)) == 1))
    sliced = rows.withColumns(columns).drop(tokens)
    return sliced.withColumn("letters", sum((F.bit_count(f"o_{w}") for w in range(words)), F.lit(0))), words


def shared_letters(left: str, right: str, words: int) -> tuple[Column, Column]:
    """Equal letters and columns where both have letters, of two sides' slices."""
    same, both = F.lit(0), F.lit(0)
    for w in range(words):
        joint = F.col(f"{left}.o_{w}").bitwiseAND(F.col(f"{right}.o_{w}"))
        differ = reduce(lambda s, x: s.bitwiseOR(x), [F.col(f"{left}.b{p}_{w}").bitwiseXOR(F.col(f"{right}.b{p}_{w}")) for p in range(PLANES)])
        both = both + F.bit_count(joint)
        same = same + F.bit_count(joint.bitwiseAND(F.bitwise_not(differ)))
    return same, both


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows with their block ``own`` of the alignment's ``parts``."""
    depth = rows.groupBy(F.col("uid").alias("__uid")).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = rows.join(depth, F.col("uid").eqNullSafe(F.col("__uid"))).drop("__uid")
    return dealt.withColumn("own", F.pmod(F.xxhash64("row"), "parts").cast("int"))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.alias("x").join(right.alias("y"), F.col("x.uid").eqNullSafe(F.col("y.uid")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high")))


def effective_depth(rows: DataFrame, identity: float, coverage: float, block: int = BLOCK) -> DataFrame:
    """Sum over rows of one over the rows related to it (identity over jointly occupied columns, coverage of the row), and the share of comparable row pairs.

    A row stands on the left of its own block's pairs and on the right of all;
    each pair of blocks is one task's work and leaves one count a row.
    """
    sliced, words = bit_slices(rows.select("uid", "row", "tokens"))
    dealt = _dealt(sliced, block)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left, right = dealt.withColumn("low", F.col("own")).withColumn("high", every), dealt.withColumn("low", every).withColumn("high", F.col("own"))
    same, both = shared_letters("x", "y", words)
    pairs = _met(left, right).select(F.col("x.uid").alias("uid"), F.col("x.row").alias("row"), (F.col("x.row") == F.col("y.row")).alias("own"), F.col("x.letters").alias("letters"), same.alias("same"), both.alias("both"))
    comparable = F.col("both") >= coverage * F.greatest("letters", F.lit(1))
    related = F.col("own") | (comparable & (F.col("same") >= identity * F.greatest("both", F.lit(1))))
    by_row = pairs.groupBy("uid", "row").agg(F.count_if(related).alias("related"), F.count_if(comparable).alias("comparable"))
    n = F.count("*")
    return by_row.groupBy("uid").agg(n.alias("rows"), F.sum(1 / F.col("related")).alias("neff"), (F.sum("comparable") / (n * n)).alias("comparable"))


def similar_rows(rows: DataFrame, identity: float, coverage: float, block: int = BLOCK) -> DataFrame:
    """Pairs (uid, early, late) of rows, in the order of (``order``, ``row``), where ``late`` is alike to ``early``: equal letters ``identity`` of the jointly occupied columns, and these ``coverage`` of the letters of ``late``.

    Each pair of rows is compared once. Rows have uid, row, order, tokens; a row
    is told apart by ``row`` within its alignment.
    """
    sliced, words = bit_slices(rows.select("uid", "row", "order", "tokens"))
    dealt = _dealt(sliced, block)
    left = dealt.withColumn("low", F.col("own")).withColumn("high", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)))
    right = dealt.withColumn("high", F.col("own")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("own"))))
    same, both = shared_letters("x", "y", words)
    first = (F.col("x.order") < F.col("y.order")) | ((F.col("x.order") == F.col("y.order")) & (F.col("x.row") < F.col("y.row")))
    size = F.greatest(F.when(first, F.col("y.letters")).otherwise(F.col("x.letters")), F.lit(1))
    alike = (both >= coverage * size) & (same >= identity * F.greatest(both, F.lit(1)))
    once = (F.col("x.low") < F.col("x.high")) | (F.col("x.row") < F.col("y.row"))
    pairs = _met(left, right).filter(once & alike)
    return pairs.select(F.col("x.uid").alias("uid"), F.when(first, F.col("x.row")).otherwise(F.col("y.row")).alias("early"), F.when(first, F.col("y.row")).otherwise(F.col("x.row")).alias("late"))


def first_independent(edges: DataFrame) -> DataFrame:
    """Rows (uid, row) that a walk in order drops: those with an ``edges`` (uid, early, late) from a row that it keeps.

    Rounds in parallel: a row whose earlier neighbours are all decided is
    decided. Each round keeps the rows that no open edge leads to, drops their
    later neighbours, and writes what edges are still open; with a random order
    the rounds grow with the logarithm of the rows, with a chain of rows alike
    in order with its length.
    """
    spark = edges.sparkSession

    def ends(df: DataFrame, side: str) -> DataFrame:
        return df.select("uid", F.col(side).alias("row"))

    def without(df: DataFrame, gone: DataFrame, side: str) -> DataFrame:
        gone = gone.select(F.col("uid").alias("__uid"), F.col("row").alias("__row"))
        return df.join(gone, F.col("uid").eqNullSafe(F.col("__uid")) & (F.col(side) == F.col("__row")), "left_anti")

    place = fresh_path(spark, "edges")
    open_, dropped = materialise(edges, path=place), None
    while True:
        kept = without(ends(open_, "early"), ends(open_, "late"), "row").distinct()
        kept = kept.select(F.col("uid").alias("__uid"), F.col("row").alias("__row"))
        now = open_.join(kept, F.col("uid").eqNullSafe(F.col("__uid")) & (F.col("early") == F.col("__row")), "left_semi")
        now = materialise(ends(now, "late").distinct(), "dropped")
        dropped = now if dropped is None else dropped.unionByName(now)
        if now.isEmpty():  # every acyclic set of edges has a first row, so none is open
            discard(spark, place)
            return dropped
        before, place = place, fresh_path(spark, "edges")
        # Edges to a dropped row are settled, those from one no longer count.
        open_ = materialise(without(without(open_, now, "late"), now, "early"), path=place)
        discard(spark, before)


def thin_redundant(rows: DataFrame, identity: float, coverage: float, cap: int | None = None, most: int | None = None, least: int = 0, salt: str = "cache", block: int = BLOCK) -> DataFrame:
    """Keep rows in order, drop one that is ``identity`` alike over ``coverage`` of it to a kept one; the first ``cap`` kept ones with their ``place``.

    Exactly what a loop over (``order``, ``row``) keeps, of alignments of any
    depth. ``most``, if given, first cuts an alignment to its rows of the least
    hash (the rule by which alignments are cached). An alignment that keeps
    fewer than ``least`` rows is left out. A row without letters is alike to
    none. A row number occurs once in an alignment.
    """
    if most is not None:
        order = hash_draw(F.concat_ws(":", F.lit(salt), F.col("row").cast("string")))
        rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("uid").orderBy(order, "row"))).filter(F.col("__k") <= most)
    rows = materialise(rows.select("uid", "row", "order", "tokens"), "rows")
    dropped = first_independent(similar_rows(rows, identity, coverage, block)).select(F.col("uid").alias("__uid"), F.col("row").alias("__row"))
    kept = rows.select("uid", "row", "order").join(dropped, F.col("uid").eqNullSafe(F.col("__uid")) & (F.col("row") == F.col("__row")), "left_anti")
    if cap is not None and not least:
        place = F.row_number().over(Window.partitionBy("uid").orderBy("order", "row"))  # only ``cap`` rows of an alignment leave a task
        return kept.withColumn("place", place).filter(F.col("place") <= cap).select("uid", "row", (F.col("place") - 1).alias("place"))
    placed = running_sums(kept.withColumns({"one": F.lit(1), "along": F.struct("order", "row")}), ["uid"], "along", ["one"])
    placed = placed.filter((F.least(F.col("all_one"), F.lit(cap)) if cap is not None else F.col("all_one")) >= least)
    placed = placed if cap is None else placed.filter(F.col("cum_one") <= cap)
    return placed.select("uid", "row", (F.col("cum_one") - 1).cast("int").alias("place"))


def joint_support(rows: DataFrame, least: int) -> DataFrame:
    """Of all column pairs, the share that at least ``least`` rows and that at least half of the rows occupy together.

    Rows are packed by 64 to a word a column; two columns' words, ANDed and
    counted, add up by alignment and pair of columns.
    """
    numbered = rows.select("uid", "row", F.posexplode("tokens").alias("col", "token"))
    depth = rows.groupBy(F.col("uid").alias("__uid")).agg(F.count("*").alias("rows"), F.max(F.size("tokens")).alias("width"))
    # Rows of one hash bucket are numbered and share words.
    keyed = rows.select("uid", "row").join(depth, F.col("uid").eqNullSafe(F.col("__uid"))).withColumn("bucket", F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / BLOCK)).cast("int"))
    place = F.row_number().over(Window.partitionBy("uid", "bucket").orderBy("row")) - 1
    placed = keyed.select("uid", "row", "bucket", place.alias("at"))
    located = placed.select(F.col("uid").alias("u"), F.col("row").alias("r"), "bucket", F.floor(F.col("at") / WORD).cast("int").alias("word"), (F.col("at") % WORD).cast("int").alias("bit"))
    letters = numbered.filter(F.col("token") < GAP).join(located, F.col("uid").eqNullSafe(F.col("u")) & (F.col("row") == F.col("r")))
    words = letters.groupBy("uid", "bucket", "word", "col").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    lists = words.groupBy("uid", "bucket", "word").agg(F.sort_array(F.collect_list(F.struct("col", "mask"))).alias("columns"))  # a row's columns at most
    pairs = lists.select("uid", F.explode("columns").alias("x"), "columns").select("uid", "x", F.explode(F.filter("columns", lambda y: y["col"] > F.col("x.col"))).alias("y"))
    joint = pairs.groupBy("uid", F.col("x.col").alias("one"), F.col("y.col").alias("two")).agg(F.sum(F.bit_count(F.col("x.mask").bitwiseAND(F.col("y.mask")))).alias("n"))
    n = F.col("n")
    sums = joint.join(depth, F.col("uid").eqNullSafe(F.col("__uid"))).groupBy("__uid").agg(F.sum("n").alias("sum"), F.count_if(n >= least).alias("enough"), F.count_if(n >= F.col("rows") / 2).alias("half"))
    every = depth.select(F.col("__uid").alias("uid"), "rows", (F.col("width") * (F.col("width") - 1) / 2).alias("all"))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("all")
    # A pair that no row occupies has no row above; it counts with 0.
    none = F.when(F.lit(least) <= 0, F.lit(1.0))
    joined = every.join(sums, F.col("uid").eqNullSafe(F.col("__uid")), "left")
    return joined.select("uid", share("sum").alias("mean_support"), F.coalesce(none, share("enough")).alias("enough"), share("half").alias("half"))
