"""Queries on resampling and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.expressions import POISSON_CUTS
from edgewise.operators import resample as R
from edgewise.operators import sampling as N

from . import fixtures as X
from .metric_queries import rounded
from .registry import query

REPLICATES = 200


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts with a place each."""
    supplier, part = X.table(spark, d, "supplier"), X.table(spark, d, "part")
    first = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), F.col("s_suppkey").alias("ix"))
    shift = supplier.agg(F.count("*").alias("shift"))
    return first.union(part.crossJoin(F.broadcast(shift)).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_partkey") + F.col("shift")))


_ENTITIES = "ent AS (SELECT 's' || s_suppkey AS entity, s_suppkey AS ix FROM supplier UNION ALL SELECT 'p' || p_partkey, p_partkey + (SELECT count(*) FROM supplier) FROM part)"
_MULTI = X.ctes("pairs", "scores") + f""", {_ENTITIES}, n AS (SELECT count(*) AS n FROM ent),
draw AS (SELECT rep, ('0x' || substr(sha256('boot:' || rep || ':' || ix), 1, 15))::BIGINT % n AS ix FROM ent, n, (SELECT unnest(range(0, {REPLICATES})) AS rep)),
mult AS (SELECT rep, entity, count(*) AS mult FROM draw JOIN ent USING (ix) GROUP BY ALL),
w AS (SELECT x.rep, model, score, y, x.mult * z.mult AS w FROM scores JOIN mult x ON x.entity = a JOIN mult z ON z.entity = b AND z.rep = x.rep),
g AS (SELECT rep, model, score, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM w GROUP BY ALL), c AS (SELECT *, sum(tp) OVER q AS ct, sum(fp) OVER q AS cf FROM g WINDOW q AS (PARTITION BY rep, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT rep, model, sum(tp * ct / (ct + cf)) / sum(tp) AS ap, sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp) AS auroc FROM c GROUP BY ALL)
"""


def boot(spark: SparkSession, d: str) -> DataFrame:
    draws = R.multinomial_draws(entities(spark, d), REPLICATES)
    weighted = X.by_model(R.pair_weights(X.pairs(spark, d), draws, ["score", "share", "tax", "y"]), "y", "weights")  # one product a pair, for all models
    return R.replicate_metrics(weighted, ["model"])


@query("b1_entity_bootstrap", _MULTI + "SELECT rep, model, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM m")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(boot(spark, d).select(F.col("rep").cast("long").alias("rep"), "model", "ap", "auroc"), "ap", "auroc")


@query("b4_percentile_intervals", _MULTI + "SELECT model, count(*) AS replicates, count(ap) AS finite, round(quantile_cont(ap, 0.025), 5) AS low, round(quantile_cont(ap, 0.975), 5) AS high FROM m GROUP BY model")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.percentile_interval(boot(spark, d), ["model"], "ap"), "low", "high", places=5)


_CONTRAST = _MULTI + """, k AS (SELECT * FROM (VALUES ('m2-m0', 'm2', 1.0), ('m2-m0', 'm0', -1.0), ('m1-m0', 'm1', 1.0), ('m1-m0', 'm0', -1.0)) AS t(contrast, model, coef)),
v AS (SELECT contrast, rep, sum(coef * ap) AS ap FROM m JOIN k USING (model) GROUP BY ALL)
"""


def contrast_rows(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([("m2-m0", "m2", 1.0), ("m2-m0", "m0", -1.0), ("m1-m0", "m1", 1.0), ("m1-m0", "m0", -1.0)], "contrast string, model string, coef double")
    return R.contrasts(boot(spark, d).select("rep", "model", "ap"), table, "ap")


@query("b5_contrasts", _CONTRAST + "SELECT contrast, rep, round(ap, 5) + 0.0 AS ap FROM v")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(contrast_rows(spark, d).withColumn("rep", F.col("rep").cast("long")), "ap", places=5)


@query("b6_qualified_intervals", _CONTRAST + """, i AS (SELECT contrast, count(*) AS replicates, count(ap) AS finite, quantile_cont(ap, 0.025) AS low, quantile_cont(ap, 0.975) AS high FROM v GROUP BY contrast)
SELECT contrast, replicates, finite, contrast <> 'm1-m0' AS qualified, CASE WHEN contrast <> 'm1-m0' THEN round(low, 5) END AS low, CASE WHEN contrast <> 'm1-m0' THEN round(high, 5) END AS high FROM i""")
def b6(spark: SparkSession, d: str) -> DataFrame:
    intervals = R.percentile_interval(contrast_rows(spark, d), ["contrast"], "ap")
    return rounded(R.qualified_interval(intervals, F.col("contrast") != "m1-m0"), "low", "high", places=5)


_POISSON = "CAST(" + " + ".join(f"CAST(h >= {c} AS INTEGER)" for c in POISSON_CUTS) + " AS BIGINT)"


@query("b2_poisson_bootstrap", X.ctes("pairs", "scores") + f""", {_ENTITIES}, dr AS (SELECT rep, entity, ('0x' || substr(sha256('poisson:' || rep || ':' || entity), 1, 15))::BIGINT AS h FROM ent, (SELECT unnest(range(0, {REPLICATES})) AS rep)),
mult AS (SELECT rep, entity, {_POISSON} AS mult FROM dr), w AS (SELECT x.rep, model, score, y, x.mult * z.mult AS w FROM scores JOIN mult x ON x.entity = a AND x.mult > 0 JOIN mult z ON z.entity = b AND z.rep = x.rep AND z.mult > 0),
g AS (SELECT rep, model, score, sum(w * y) AS tp, sum(w * (1 - y)) AS fp FROM w GROUP BY ALL), c AS (SELECT *, sum(tp) OVER q AS ct, sum(fp) OVER q AS cf FROM g WINDOW q AS (PARTITION BY rep, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT rep, model, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS ap FROM c GROUP BY ALL""")
def b2(spark: SparkSession, d: str) -> DataFrame:
    draws = R.poisson_draws(entities(spark, d), REPLICATES)
    weighted = X.by_model(R.pair_weights(X.pairs(spark, d), draws, ["score", "share", "tax", "y"], square_self=True), "y", "weights")
    return rounded(R.replicate_metrics(weighted, ["model"]).select(F.col("rep").cast("long").alias("rep"), "model", "ap"), "ap")


@query("b3_component_bootstrap", f"""WITH k AS (SELECT DISTINCT ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS row_id, s_nationkey AS ca, p_size % 25 AS cb FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey),
dr AS (SELECT rep, n_nationkey AS c, ('0x' || substr(sha256('comp:' || rep || ':' || n_nationkey), 1, 15))::BIGINT AS h FROM nation, (SELECT unnest(range(0, {REPLICATES})) AS rep)), m AS (SELECT rep, c, {_POISSON} AS mult FROM dr),
w AS (SELECT x.rep, CASE WHEN ca = cb THEN x.mult ELSE x.mult * z.mult END AS weight FROM k JOIN m x ON x.c = ca JOIN m z ON z.c = cb AND z.rep = x.rep WHERE x.mult > 0 AND z.mult > 0)
SELECT rep, count(*) AS rows, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY rep""")
def b3(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, part = (X.table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    row = ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"]).select(row.alias("row_id"), F.col("s_nationkey").alias("ca"), (F.col("p_size") % 25).alias("cb")).distinct()
    draws = R.poisson_draws(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("entity")), REPLICATES, "comp")
    each = R.component_weights(rows, draws, ["ca", "cb"]).select(F.posexplode("weights").alias("rep", "weight")).filter("weight > 0")
    return each.groupBy(F.col("rep").cast("long").alias("rep")).agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))


_H = "('0x' || substr(sha256({}), 1, 15))::BIGINT"


@query("w13_proportional_sample", X.ctes("pairs") + f""", s AS (SELECT row_id, line, y, {_H.format("'prop:' || row_id")} AS h FROM pairs), n AS (SELECT line, y, count(*) AS n, sum(count(*)) OVER () AS total FROM s GROUP BY ALL),
q AS (SELECT *, 5000 * n // total AS base, (5000 * n) % total AS rest FROM n), r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, line, y) AS k, 5000 - sum(base) OVER () AS spare FROM q),
z AS (SELECT line, y, base + CAST(k <= spare AS BIGINT) AS quota FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY line, y ORDER BY h, row_id) AS place FROM s)
SELECT row_id FROM p JOIN z USING (line, y) WHERE place <= quota""")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return N.proportional_sample(X.pairs(spark, d), ["line", "y"], 5000, "row_id", "prop").select("row_id")


@query("w12_round_robin", X.ctes("pairs") + f""", r AS (SELECT a, b, row_id, row_number() OVER (PARTITION BY b, line ORDER BY {_H.format("'rr:' || row_id")}, row_id) AS k, line FROM pairs),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY k, {_H.format("'rrf:' || line")}, line) AS place FROM r) SELECT b, row_id, place FROM o WHERE place <= 10""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    found = N.round_robin(X.pairs(spark, d), "b", "line", "row_id", 10, "rr", "rrf")
    return found.select("b", "row_id", F.col("place").cast("long").alias("place"))


@query("w14_decile_sample", X.ctes("entity") + f""", t AS (SELECT entity, ntile(10) OVER (ORDER BY len, entity) AS decile FROM entity), r AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY {_H.format("'dec:' || entity")}, entity) AS place FROM t)
SELECT entity, decile, place FROM r WHERE place <= 20""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return N.decile_sample(X.entity(spark, d).select("entity", "len"), "entity", "len", 20, "dec").select("entity", F.col("decile").cast("long").alias("decile"), F.col("place").cast("long").alias("place"))


@query("n4_balance_report", X.ctes("pairs") + """, g AS (SELECT b AS entity, sum(y) AS pos, sum(1 - y) AS neg FROM pairs GROUP BY b), r AS (SELECT *, rank() OVER (ORDER BY pos) + (count(*) OVER (PARTITION BY pos) - 1) / 2.0 AS rp, rank() OVER (ORDER BY neg) + (count(*) OVER (PARTITION BY neg) - 1) / 2.0 AS rn FROM g)
SELECT count(*) AS entities, CAST(sum(abs(neg - pos)) AS BIGINT) AS residual, round(sum(neg) * 1.0 / sum(pos), 6) AS ratio, round(corr(rp, rn), 6) AS spearman, count(*) FILTER (neg = 0) AS absent, round(sum(abs(neg - pos) / ln(1 + pos)) / count(*), 6) AS objective FROM r WHERE pos > 0""")
def n4(spark: SparkSession, d: str) -> DataFrame:
    from edgewise.operators.pairs import entity_degrees

    degrees = entity_degrees(X.pairs(spark, d)).filter(F.col("entity").startswith("s"))
    return rounded(N.balance_report(degrees), "ratio", "spearman", "objective")


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Words of a part's type; a supplier's nation."""
    part, supplier = X.table(spark, d, "part"), X.table(spark, d, "supplier")
    one = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.split("p_type", " ").alias("annots"))
    return one.union(supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.array(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))))


@query("n1_negative_candidates")
def n1(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: the pool is checked by its size and properties in the tests."""
    positives = X.pairs(spark, d).filter("y = 1").select("a", "b").distinct()
    return N.negative_candidates(positives, 4.0, annotations=annotated(spark, d))


@query("n3_degree_capped_negatives")
def n3(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: caps and number are checked in the tests. As many as there are positives, from a pool of four times as many."""
    positives = X.pairs(spark, d).filter("y = 1").select("a", "b").distinct()
    return N.degree_capped(N.negative_candidates(positives, 4.0), positives, 6, target=positives.count())


@query("n3_first_capped_blocs", "WITH RECURSIVE " + X.ctes("blocs").removeprefix("WITH ") + f""", o AS (SELECT a, b, row_number() OVER (ORDER BY {_H.format("'cap:' || a || ':' || b")}) AS k FROM blocs WHERE y = 0),
room AS (SELECT entity, count(*) AS room FROM (SELECT a AS entity FROM blocs WHERE y = 1 UNION ALL SELECT b FROM blocs WHERE y = 1) GROUP BY entity),
c AS (SELECT o.*, coalesce(x.room, 0) AS ra, coalesce(z.room, 0) AS rb FROM o LEFT JOIN room x ON x.entity = a LEFT JOIN room z ON z.entity = b),
r(k, a, b, take, used) AS (SELECT 0::BIGINT, '', '', FALSE, []::VARCHAR[] UNION ALL
  SELECT k, a, b, fits, CASE WHEN fits THEN used || [a, b] ELSE used END FROM (SELECT c.k, c.a, c.b, r.used, len(list_filter(r.used, lambda u: u = c.a)) < c.ra AND len(list_filter(r.used, lambda u: u = c.b)) < c.rb AS fits FROM r JOIN c ON c.k = r.k + 1)),
n AS (SELECT count(*) FILTER (take) // 2 AS most FROM r) SELECT a, b FROM r, n WHERE take ORDER BY k LIMIT (SELECT most FROM n)""")
def n3_first(spark: SparkSession, d: str) -> DataFrame:
    """Of all blocs without the label those that one pass in hash order takes while both ends keep to their positive degrees, up to half of the pass."""
    rows = X.blocs(spark, d)
    negative, positive = rows.filter("y = 0").select("a", "b"), rows.filter("y = 1").select("a", "b")
    most = N.degree_capped(negative, positive, 1).count() // 2
    return N.degree_capped(negative, positive, 1, target=most)


@query("w15_length_pool_batches", X.ctes("entity") + f""", n AS (SELECT CAST(greatest(1, ceil(count(*) / (50 * 16.0))) AS BIGINT) AS pools FROM entity), o AS (SELECT entity, len, {_H.format("'pool:' || entity")} AS h FROM entity), p AS (SELECT *, CAST(h % pools AS INTEGER) AS pool FROM o, n),
r AS (SELECT *, (row_number() OVER (PARTITION BY pool ORDER BY len, entity) - 1) // 16 AS batch FROM p) SELECT entity, pool, CAST(batch AS BIGINT) AS batch, {_H.format("'pool-turn:' || pool || ':' || batch")} AS turn FROM r""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return N.length_pool_batches(X.entity(spark, d), "entity", "len", 16, "pool").select("entity", "pool", F.col("batch").cast("long").alias("batch"), "turn")
