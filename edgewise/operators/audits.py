"""Audits that compare relations and return violations, counts or digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw


def _count(rule: Column) -> Column:
    return F.sum(F.when(rule, 1).otherwise(0)).cast("long")


def multiset_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """A2: order-insensitive digest: equal rows are counted first, as an exclusive or would cancel them."""
    grouped = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("__n").cast("string"))
    return grouped.agg(F.bit_xor(hash_draw(text)).alias("digest"), F.sum("__n").alias("rows"), F.count("*").alias("distinct_rows"))


#: Fixed value: the modulus of the additive digest, the greatest prime below 2**61.
DIGEST_PRIME = (1 << 61) - 1


def additive_digest(df: DataFrame, keys: list[str], parts: int = 4) -> DataFrame:
    """A2: a digest of a multiset of rows as ``parts`` sums of 60-bit hashes in a prime field, and the number of rows.

    A row's hash doesn't depend on other rows, so there is no shuffle but that
    of one partial sum a task; repeated rows add up and don't cancel. Digests
    of parts of a table add up to that of the whole (``join_digests``), so rows
    can be added and, with sign -1, removed. Null is told apart from every
    text, and field borders from their contents.
    """
    field = lambda k: F.when(F.col(k).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.char_length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")))
    row = F.concat(*[field(k) for k in keys])
    total = lambda p: F.coalesce(F.sum(hash_draw(F.concat(F.lit(f"{p}|"), row)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    sums = df.agg(*[total(p).alias(f"d{p}") for p in range(parts)], F.count("*").alias("rows"))
    return sums.select(*[(F.col(f"d{p}") % F.lit(DIGEST_PRIME)).cast("long").alias(f"d{p}") for p in range(parts)], "rows")


def join_digests(digests: DataFrame, sign: str | None = None) -> DataFrame:
    """A2: the digest of several tables' rows together; rows with ``sign`` -1 are taken out."""
    factor = F.col(sign) if sign else F.lit(1)
    sums = [c for c in digests.columns if c.startswith("d") and c[1:].isdigit()]
    prime = F.lit(DIGEST_PRIME)
    added = digests.agg(*[F.sum((F.col(c) * factor).cast("decimal(38,0)")).alias(c) for c in sums], F.sum(F.col("rows") * factor).alias("rows"))
    return added.select(*[F.pmod(F.col(c), prime).cast("long").alias(c) for c in sums], "rows")


def disjointness(df: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """A3: per key column and pair of splits, how many values both hold (0: disjoint)."""
    long = df.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).select(split, "x.key", "x.value").filter("value IS NOT NULL").distinct()
    left, right = long.withColumnRenamed(split, "one"), long.withColumnRenamed(split, "two")
    shared = left.join(right, ["key", "value"]).filter("one < two").groupBy("key", "one", "two").agg(F.count("*").alias("shared"))
    splits = df.select(split).distinct()
    pairs = splits.withColumnRenamed(split, "one").join(splits.withColumnRenamed(split, "two"), F.col("one") < F.col("two"))  # a few names
    grid = pairs.select("one", "two", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    return grid.join(shared, ["key", "one", "two"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def shard_coverage(expected: DataFrame, actual: DataFrame, row: str, label: str, values: list[str]) -> DataFrame:
    """A5: per shard of ``actual``, and ``absent`` for rows in none: rows missing, extra, repeated, with another label or not finite."""
    counts = actual.groupBy(row).agg(F.count("*").alias("__times"), F.min("shard").alias("shard"), F.min(label).alias("__label"), F.max(_bad(values).cast("int")).alias("__bad"))
    joined = expected.select(row, F.col(label).alias("__want")).join(counts, row, "full")
    return joined.groupBy(F.coalesce(F.col("shard").cast("string"), F.lit("absent")).alias("shard")).agg(
        F.count("*").alias("rows"), _count(F.col("__times").isNull()).alias("missing"), _count(F.col("__want").isNull()).alias("extra"), _count(F.col("__times") > 1).alias("repeated"),
        _count(F.col("__want") != F.col("__label")).alias("other_label"), _count(F.col("__bad") == 1).alias("not_finite"),
    )


def _bad(values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | F.col(v).isNull() | F.isnan(v) | F.col(v).isin(float("inf"), float("-inf"))
    return out


def feature_contract(df: DataFrame, vector: str, dims: int, gate: str, available: str) -> DataFrame:
    """One row of violation counts of a feature table."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    zero = F.forall(vector, lambda x: x == 0)
    return df.agg(
        F.count("*").alias("rows"), _count(F.size(vector) != dims).alias("wrong_dims"), _count(~finite).alias("not_finite"), _count(~F.col(gate).between(0, 1)).alias("gate_outside"),
        _count((F.col(gate) > 0) != F.col(available)).alias("gate_disagrees"), _count(~F.col(available) & ~zero).alias("evidence_without_support"),
    )


def log_agreement(df: DataFrame, run: str, update: str, value: str) -> DataFrame:
    """Updates that several runs have, and those where all their values agree."""
    per = df.groupBy(update).agg(F.count_distinct(run).alias("runs"), F.count_distinct(value).alias("values"))
    return per.filter("runs > 1").agg(F.count("*").alias("shared_updates"), _count(F.col("values") == 1).alias("agreeing"))


def exposure_description(history: DataFrame, entities: DataFrame) -> DataFrame:
    """A10: rows and ends of a history, and how many ends are known by id, by sequence and by family."""
    ends = history.select("entity", "sha", "family").distinct()
    ids, shas, families = (entities.select(c).distinct().withColumn(f"__{c}", F.lit(1)) for c in ("entity", "sha", "family"))
    joined = ends.join(ids, "entity", "left").join(shas, "sha", "left").join(families, "family", "left")
    shape = joined.agg(F.count("*").alias("ends"), F.count("__entity").alias("known_ids"), F.count("__sha").alias("known_sequences"), F.count("__family").alias("known_families"), _count(F.col("__entity").isNull() & F.col("__sha").isNull()).alias("unresolved"))
    return shape.crossJoin(history.agg(F.count("*").alias("rows")))  # single rows


def funnel(df: DataFrame, steps: list[tuple[str, Column]], label: str = "y") -> DataFrame:
    """Nested views of a panel: rows and positives after each further condition."""
    held, columns = F.lit(True), []
    for name, rule in steps:
        held = held & rule
        columns.append(F.when(held, F.lit(name)))
    rows = df.withColumn("step", F.explode(F.array_compact(F.array(*columns))))
    return rows.groupBy("step").agg(F.count("*").alias("rows"), F.sum(label).cast("long").alias("positives"))


def catalogue_coverage(wanted: DataFrame, catalogue: DataFrame, key: str, split: str) -> DataFrame:
    """Per split how many wanted keys the catalogue has."""
    have = catalogue.select(key).distinct().withColumn("__have", F.lit(1))
    return wanted.join(have, key, "left").groupBy(split).agg(F.count("*").alias("wanted"), F.count("__have").alias("matched"))


def triple_overlap(df: DataFrame, split: str, one: str, two: str, columns: tuple[str, str, str]) -> DataFrame:
    """Rows of split ``two`` whose triple, whose pair and whose first member is in split ``one``."""
    key = lambda cs: F.sha2(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in cs]).cast("binary"), 256)
    named = df.withColumns({"__t": key(columns), "__p": key(columns[:2]), "__e": key(columns[:1])})
    base, rows = named.filter(F.col(split) == one), named.filter(F.col(split) == two)
    for c in ("__t", "__p", "__e"):
        rows = rows.join(base.select(c, F.lit(1).alias(f"{c}x")).distinct(), c, "left")
    return rows.agg(F.count("*").alias("rows"), F.count("__tx").alias("shared_triples"), F.count("__px").alias("shared_pairs"), F.count("__ex").alias("shared_members"))
