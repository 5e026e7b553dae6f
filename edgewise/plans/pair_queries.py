"""Queries on labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators import pairs as P

from . import fixtures as X
from .metric_queries import rounded
from .registry import query

_KEYED = X.ctes("pairs") + ", k AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM pairs) "


@query("p1_canonical_pair", X.ctes("pairs") + "SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (a > b) AS reversed_rows, count(*) AS rows FROM pairs GROUP BY ALL")
def p1(spark: SparkSession, d: str) -> DataFrame:
    keyed = P.canonical_pair(X.pairs(spark, d))
    return keyed.groupBy("lo", "hi").agg(F.sum(F.col("reversed").cast("long")).alias("reversed_rows"), F.count("*").alias("rows"))


_RULES = {"short": "len < 200", "shouting": "upper(seq) = seq", "digits": "regexp_matches(seq, '[0-9]{3}')", "long": "len > 8000"}


def _rules() -> list:
    return [("short", F.col("len") < 200), ("shouting", F.upper("seq") == F.col("seq")), ("digits", F.col("seq").rlike("[0-9]{3}")), ("long", F.col("len") > 8000)]


_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES.items()) + " END"


@query("p2_first_reason", X.ctes("entity") + f"SELECT entity, {_REASON} AS reason FROM entity")
def p2(spark: SparkSession, d: str) -> DataFrame:
    return P.first_reason(X.entity(spark, d), _rules()).select("entity", "reason")


@query("p3_all_reasons", X.ctes("entity") + "SELECT entity, concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + ") AS reasons FROM entity")
def p3(spark: SparkSession, d: str) -> DataFrame:
    return P.all_reasons(X.entity(spark, d), _rules()).select("entity", "reasons")


@query("p4_loss_ledger", X.ctes("entity") + f"SELECT coalesce({_REASON}, 'kept') AS outcome, count(*) AS rows FROM entity GROUP BY 1")
def p4(spark: SparkSession, d: str) -> DataFrame:
    return P.loss_ledger(P.first_reason(X.entity(spark, d), _rules()))


@query("p5_base_id", "SELECT string_split(o_orderpriority, '-')[1] AS base, count(*) AS rows FROM orders GROUP BY 1")
def p5(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "orders").groupBy(P.base_id("o_orderpriority").alias("base")).agg(F.count("*").alias("rows"))


@query("p6_alphabet", X.ctes("entity") + r"SELECT grp, count(*) FILTER (NOT regexp_matches(seq, '[^A-Za-z.,\n ]')) AS plain, count(*) AS rows FROM entity GROUP BY grp")
def p6(spark: SparkSession, d: str) -> DataFrame:
    return X.entity(spark, d).groupBy("grp").agg(F.sum(P.in_alphabet("seq", r"A-Za-z.,\n ").cast("long")).alias("plain"), F.count("*").alias("rows"))


@query("p7_length_window", """SELECT l_returnflag AS flag, count(*) FILTER (p_size BETWEEN 5 AND 40 AND l_quantity BETWEEN 5 AND 40 AND p_size + l_quantity <= 60) AS inside, count(*) AS rows
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def p7(spark: SparkSession, d: str) -> DataFrame:
    line, part = X.table(spark, d, "lineitem"), X.table(spark, d, "part")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"])
    inside = P.length_window(F.col("p_size"), F.col("l_quantity"), 5, 40, 60)
    return joined.groupBy(F.col("l_returnflag").alias("flag")).agg(F.sum(inside.cast("long")).alias("inside"), F.count("*").alias("rows"))


_HITS = """, hits AS (SELECT l_partkey AS q, l_suppkey AS t, l_discount * 10 AS fident, l_quantity / 50 AS qcov, 1 - l_tax * 5 AS tcov, l_extendedprice AS bits,
    ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS row_id FROM lineitem)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as hits of a part on a supplier."""
    row = ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("t"), (F.col("l_discount") * 10).alias("fident"), (F.col("l_quantity") / 50).alias("qcov"), (1 - F.col("l_tax") * 5).alias("tcov"), F.col("l_extendedprice").alias("bits"), row.alias("row_id"))


@query("p8_qualified_hits", "WITH" + _HITS[1:] + " SELECT q, count(*) AS hits, round(max(fident), 6) AS best FROM hits WHERE fident >= 0.4 AND qcov >= 0.8 AND tcov >= 0.8 GROUP BY q")
def p8(spark: SparkSession, d: str) -> DataFrame:
    return P.qualified_hits(hits(spark, d)).groupBy("q").agg(F.count("*").alias("hits"), F.round(F.max("fident"), 6).alias("best"))


@query("p9_split_by_length", """SELECT bucket, count(*) AS rows FROM (SELECT CASE WHEN p.p_size <= 25 AND s.s_acctbal <= 2500 THEN 'short' WHEN p.p_size > 25 AND s.s_acctbal > 2500 THEN 'long' END AS bucket
    FROM lineitem JOIN part p ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey) WHERE bucket IS NOT NULL GROUP BY bucket""")
def p9(spark: SparkSession, d: str) -> DataFrame:
    parts = X.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_size").cast("double").alias("len"))
    suppliers = X.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), (F.col("s_acctbal") / 100).alias("len"))
    return P.split_by_length(X.pairs(spark, d), parts.union(suppliers), 25).groupBy("bucket").agg(F.count("*").alias("rows"))


@query("p10_orientation_pooling", X.ctes("pairs") + """, l AS (SELECT row_id, line % 2 = 1 AS swapped, score * 40 - 2 AS ab, share * 4 - 2 AS ba FROM pairs)
SELECT row_id, round(CASE WHEN swapped THEN ba ELSE ab END, 6) + 0.0 AS forward, round((ab + ba) / 2, 6) + 0.0 AS logit, round(1 / (1 + exp(-(ab + ba) / 2)), 6) AS probability FROM l""")
def p10(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d).select("row_id", (F.col("line") % 2 == 1).alias("swapped"), (F.col("score") * 40 - 2).alias("logit_ab"), (F.col("share") * 4 - 2).alias("logit_ba"))
    return rounded(P.pool_orientations(rows, reversed_col="swapped").select("row_id", "forward", "logit", "probability"), "forward", "logit", "probability")


@query("p11_gated_fusion", X.ctes("pairs") + "SELECT row_id, round(CASE WHEN tax > 0.03 THEN share + 0.5 * tax * score ELSE share END, 8) AS fused FROM (SELECT *, CASE WHEN tax > 0.03 THEN tax ELSE 0 END AS gate FROM pairs)")
def p11(spark: SparkSession, d: str) -> DataFrame:
    gate = F.when(F.col("tax") > 0.03, F.col("tax")).otherwise(0.0)
    return X.pairs(spark, d).select("row_id", F.round(P.gated_fusion(F.col("share"), F.col("score"), gate, 0.5), 8).alias("fused"))


@query("p12_mutation_scores", X.ctes("pairs") + """, l AS (SELECT row_id, share * 8 - 4 AS w, score * 80 - 4 AS m FROM pairs)
SELECT row_id, round(m - w, 6) + 0.0 AS logit_difference, round(-ln(1 + exp(-m)) + ln(1 + exp(-w)), 6) + 0.0 AS log_sigmoid_difference FROM l""")
def p12(spark: SparkSession, d: str) -> DataFrame:
    s = P.mutation_scores(F.col("share") * 8 - 4, F.col("score") * 80 - 4)
    return X.pairs(spark, d).select("row_id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in s.items()])


@query("p14_exact_recheck", """WITH c AS (SELECT l_suppkey AS s, CAST(l_quantity AS BIGINT) AS nident, CAST(round(l_discount * 100) AS BIGINT) + 40 AS alnlen, l_discount FROM lineitem)
SELECT s, count(*) FILTER (4 * nident >= alnlen) AS passed, count(*) FILTER (4 * nident < alnlen) AS failed, round(max(abs(round(nident * 1.0 / alnlen, 2) - nident * 1.0 / alnlen)), 6) AS rounding_gap FROM c GROUP BY s""")
def p14(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100).cast("long") + 40
    rows = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), n.alias("n"), m.alias("m"))
    ok = 4 * F.col("n") >= F.col("m")
    gap = F.abs(F.round(F.col("n") / F.col("m"), 2) - F.col("n") / F.col("m"))
    return rows.groupBy("s").agg(F.sum(ok.cast("long")).alias("passed"), F.sum((~ok).cast("long")).alias("failed"), F.round(F.max(gap), 6).alias("rounding_gap"))


@query("g2_collapse_edges", _KEYED + "SELECT lo, hi, max(score) AS score, count(*) AS evidence_rows, min(row_id) AS first_row FROM k GROUP BY lo, hi")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return P.collapse_edges(X.pairs(spark, d))


_CONSISTENT = _KEYED + """, f AS (SELECT lo, hi, min(row_id) AS first_row, arg_min(y, row_id) AS first_label, count(*) AS rows, sum(y) AS positives FROM k GROUP BY lo, hi),
c AS (SELECT *, CAST(CASE WHEN first_label = 1 THEN positives ELSE rows - positives END AS BIGINT) AS same FROM f)
"""


@query("g3_duplicates_and_conflicts", _CONSISTENT + "SELECT lo, hi, first_row, first_label, rows, same - 1 AS duplicate_rows, rows - same AS conflicting_rows, same = rows AS consistent FROM c")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_consistency(X.pairs(spark, d))


@query("g4_consistent_pairs", _CONSISTENT + "SELECT lo, hi, first_row, first_label AS y FROM c WHERE same = rows")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return P.consistent_pairs(X.pairs(spark, d))


@query("g5_pair_census", _KEYED + """, u AS (SELECT lo, hi, count(*) AS n, sum(y) AS p FROM k GROUP BY lo, hi), e AS (SELECT a AS entity, y FROM pairs UNION ALL SELECT b, y FROM pairs WHERE a <> b),
g AS (SELECT entity, sum(y) AS pos FROM e GROUP BY entity), z AS (SELECT entity FROM g WHERE pos = 0)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(p) AS BIGINT) AS positive_rows, count(*) AS unique_pairs, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (p > 0) AS positive_pairs,
  count(*) FILTER (p < n) AS negative_pairs, count(*) FILTER (p > 0 AND p < n) AS opposite_label_pairs, count(*) FILTER (lo = hi) AS self_pairs, (SELECT count(*) FROM g) AS entities,
  (SELECT count(*) FROM g WHERE pos > 0) AS positive_entities, (SELECT count(*) FROM pairs WHERE y = 0 AND (a IN (SELECT entity FROM z) OR b IN (SELECT entity FROM z))) AS negatives_with_new_end FROM u""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return P.pair_census(X.pairs(spark, d))


_DEGREES = X.ctes("pairs") + """, e AS (SELECT a AS entity, y FROM pairs UNION ALL SELECT b, y FROM pairs WHERE a <> b),
g AS (SELECT entity, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM e GROUP BY entity)
"""


@query("g6_entity_degrees", _DEGREES + "SELECT * FROM g")
def g6(spark: SparkSession, d: str) -> DataFrame:
    return P.entity_degrees(X.pairs(spark, d))


@query("g7_degree_ratio_scores", X.ctes("pairs", "split") + """, e AS (SELECT a AS entity, y FROM split WHERE split = 'train' UNION ALL SELECT b, y FROM split WHERE split = 'train'),
g AS (SELECT entity, ln((sum(y) + 1.0) / (sum(1 - y) + 1.0)) AS v, CAST(sum(y) > 0 AS INTEGER) AS seen FROM e GROUP BY entity)
SELECT t.row_id, round(coalesce(x.v, 0) + coalesce(z.v, 0), 6) AS degree_score, coalesce(x.seen, 0) + coalesce(z.seen, 0) AS ends_seen
FROM split t LEFT JOIN g x ON t.a = x.entity LEFT JOIN g z ON t.b = z.entity WHERE t.split = 'test'""")
def g7(spark: SparkSession, d: str) -> DataFrame:
    rows = X.split(spark, d)
    scored = P.degree_ratio_scores(rows.filter("split = 'test'"), P.entity_degrees(rows.filter("split = 'train'")))
    return rounded(scored.select("row_id", "degree_score", "ends_seen"), "degree_score")


@query("t2_top_entities", _DEGREES + "SELECT entity, pos + neg AS rows FROM g ORDER BY rows DESC, entity LIMIT 20")
def t2(spark: SparkSession, d: str) -> DataFrame:
    ends = X.pairs(spark, d).select(F.explode(F.array("a", "b")).alias("entity"))
    return P.top_shared(ends, "entity", 20)


@query("t1_hash_order", X.ctes("pairs") + "SELECT row_id, row_number() OVER (PARTITION BY line ORDER BY sha256('seed:' || row_id)) AS place FROM pairs")
def t1(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("seed:"), F.col("row_id").cast("string")).cast("binary"), 256)
    return P.places_within(X.pairs(spark, d).select("row_id", "line"), ["line"], [F.unhex(key)]).select("row_id", "place")


@query("j2_enrich_ends", """SELECT s_nationkey AS nation, p_brand AS brand, count(*) AS rows FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    parts = X.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity"), F.col("p_brand").alias("brand"), F.lit(None).cast("int").alias("nation"))
    suppliers = X.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"), F.lit(None).cast("string").alias("brand"), F.col("s_nationkey").alias("nation"))
    both = P.enrich_ends(X.pairs(spark, d), parts.union(suppliers), ["brand", "nation"])
    return both.groupBy(F.col("b_nation").alias("nation"), F.col("a_brand").alias("brand")).agg(F.count("*").alias("rows"))


@query("j4_exclude_by_hits", "WITH" + _HITS[1:] + """, good AS (SELECT * FROM hits WHERE fident >= 0.9 AND qcov >= 0.9 AND tcov >= 0.9),
bad AS (SELECT DISTINCT q AS e FROM good WHERE t IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5))
SELECT l_returnflag AS flag, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT e FROM bad) GROUP BY 1""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    good = P.qualified_hits(hits(spark, d), 0.9, 0.9).select(F.concat(F.lit("p"), F.col("q").cast("string")).alias("q"), F.concat(F.lit("s"), F.col("t").cast("string")).alias("t"))
    wanted = X.table(spark, d, "supplier").filter("s_nationkey < 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity"))
    rows = X.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.lit("-").alias("b"), F.col("l_returnflag").alias("flag"))
    return P.exclude_by_hits(rows, good, wanted).groupBy("flag").agg(F.count("*").alias("rows"))


@query("j5_purge_splits", X.ctes("blocs") + """, s AS (SELECT *, CASE WHEN ('0x' || substr(sha256('bloc:' || a || ':' || b), 1, 15))::BIGINT % 100 < 90 THEN 'train' WHEN ('0x' || substr(sha256('bloc:' || a || ':' || b), 1, 15))::BIGINT % 100 < 98 THEN 'val' ELSE 'test' END AS split FROM blocs),
lv AS (SELECT a AS e FROM s WHERE split <> 'train' UNION SELECT b FROM s WHERE split <> 'train'), lt AS (SELECT a AS e FROM s WHERE split = 'test' UNION SELECT b FROM s WHERE split = 'test')
SELECT a, b, y, split FROM s WHERE split = 'test' OR (split = 'train' AND a NOT IN (SELECT e FROM lv) AND b NOT IN (SELECT e FROM lv)) OR (split = 'val' AND a NOT IN (SELECT e FROM lt) AND b NOT IN (SELECT e FROM lt))""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    from edgewise.functions.expressions import hash_draw

    draw = hash_draw(F.concat_ws(":", F.lit("bloc"), "a", "b")) % 100
    rows = X.blocs(spark, d).withColumn("split", F.when(draw < 90, "train").when(draw < 98, "val").otherwise("test"))
    return P.purge_splits(rows).select("a", "b", "y", "split")


@query("j8_union_of_tests", X.ctes("pairs") + """, t AS (SELECT CASE WHEN line <= 3 THEN 'one' ELSE 'two' END AS test, row_id, a, b, least(a, b) AS lo, greatest(a, b) AS hi FROM pairs),
f AS (SELECT *, row_number() OVER (PARTITION BY lo, hi ORDER BY test, row_id) AS k FROM t)
SELECT t.test, t.row_id, t.lo, t.hi, t.a <> f.a AS reversed, f.test AS first_test FROM t JOIN f ON t.lo = f.lo AND t.hi = f.hi AND f.k = 1""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    tests = X.pairs(spark, d).withColumn("test", F.when(F.col("line") <= 3, "one").otherwise("two"))
    union, mapping = P.union_tests(tests)
    return mapping.join(union.select("lo", "hi", "first_test"), ["lo", "hi"])


@query("j9_exposure_bits", X.ctes("pairs") + """, s AS (SELECT a, b, CASE WHEN line = 1 THEN 1 WHEN line = 2 THEN 2 ELSE 4 END AS bit FROM pairs WHERE line <= 3),
p AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, bit_or(bit) AS bits FROM s GROUP BY ALL), e AS (SELECT a AS entity, bit FROM s UNION ALL SELECT b, bit FROM s), g AS (SELECT entity, bit_or(bit) AS bits FROM e GROUP BY entity),
t AS (SELECT * FROM pairs WHERE line > 3)
SELECT row_id, coalesce(p.bits, 0) AS pair_bits, coalesce(x.bits, 0) AS a_bits, coalesce(z.bits, 0) AS b_bits FROM t LEFT JOIN p ON least(a, b) = lo AND greatest(a, b) = hi LEFT JOIN g x ON a = x.entity LEFT JOIN g z ON b = z.entity""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    sources = rows.filter("line <= 3").select("a", "b", F.when(F.col("line") == 1, 1).when(F.col("line") == 2, 2).otherwise(4).alias("bit"))
    return P.exposure_flags(rows.filter("line > 3"), sources).select("row_id", "pair_bits", "a_bits", "b_bits")


_FOREIGN = X.ctes("pairs") + """, raw AS (SELECT p_partkey AS k, p_brand || ':' || p_type || ':' || p_size AS seq, p_size FROM part),
ent AS (SELECT 'p' || k AS entity, sha256(regexp_replace(upper(seq), '[UZOBJ]', 'X', 'g')) AS h FROM raw UNION ALL SELECT 's' || s_suppkey, sha256(regexp_replace(upper('nation ' || s_nationkey), '[UZOBJ]', 'X', 'g')) FROM supplier),
fs AS (SELECT 'x' || k AS id, sha256(regexp_replace(upper(lower(seq)), '[UZOBJ]', 'X', 'g')) AS h, length(seq) AS n FROM raw WHERE p_size > 3 UNION ALL
  SELECT 'y' || s_suppkey, sha256(regexp_replace(upper('Nation ' || s_nationkey), '[UZOBJ]', 'X', 'g')), length('Nation ' || s_nationkey) FROM supplier),
src AS (SELECT CASE line WHEN 1 THEN 'one' ELSE 'two' END AS split, line AS bit, 'x' || substr(a, 2) AS a, 'y' || substr(b, 2) AS b, y FROM pairs WHERE line <= 2),
met AS (SELECT src.*, u.h AS ha, v.h AS hb, coalesce(u.n BETWEEN 8 AND 20 AND v.n BETWEEN 8 AND 20, false) AS inside FROM src LEFT JOIN fs u ON u.id = src.a LEFT JOIN fs v ON v.id = src.b),
t AS (SELECT * FROM pairs WHERE line > 3), """


def foreign(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines 1 and 2 as two source splits with ids of their own; small parts' sequences are missing there; lines over 3 as test pairs."""
    rows, part, supplier = X.pairs(spark, d), X.table(spark, d, "part"), X.table(spark, d, "supplier")
    seq = F.concat_ws(":", "p_brand", "p_type", F.col("p_size").cast("string"))
    nation = lambda word: F.concat(F.lit(f"{word} "), F.col("s_nationkey").cast("string"))
    named = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    entities = part.select(named("p", "p_partkey").alias("entity"), seq.alias("seq")).union(supplier.select(named("s", "s_suppkey"), nation("nation")))
    own = part.filter("p_size > 3").select(named("x", "p_partkey").alias("id"), F.lower(seq).alias("seq")).union(supplier.select(named("y", "s_suppkey"), nation("Nation")))
    sequences = own.select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("split"), "id", "seq")
    end = lambda letter, column: F.concat(F.lit(letter), F.substr(column, F.lit(2)))
    sources = rows.filter("line <= 2").select(F.when(F.col("line") == 1, "one").otherwise("two").alias("split"), F.col("line").cast("int").alias("bit"), end("x", "a").alias("a"), end("y", "b").alias("b"), "y")
    return P.sequence_exposure(rows.filter("line > 3"), entities, sources, sequences, (8, 20), P.normal_sequence)


@query("j9_sequence_exposure", _FOREIGN + """k AS (SELECT least(ha, hb) AS lo, greatest(ha, hb) AS hi, CAST(bit_or(CAST(bit AS INTEGER)) AS INTEGER) AS bits FROM met WHERE inside AND ha IS NOT NULL AND hb IS NOT NULL GROUP BY ALL),
e AS (SELECT h, CAST(bit_or(CAST(bit AS INTEGER)) AS INTEGER) AS bits FROM (SELECT ha AS h, bit FROM met WHERE inside UNION ALL SELECT hb, bit FROM met WHERE inside) GROUP BY h)
SELECT row_id, coalesce(k.bits, 0) AS pair_bits, coalesce(ea.bits, 0) AS a_bits, coalesce(eb.bits, 0) AS b_bits FROM t JOIN ent x ON x.entity = t.a JOIN ent z ON z.entity = t.b
LEFT JOIN k ON k.lo = least(x.h, z.h) AND k.hi = greatest(x.h, z.h) LEFT JOIN e ea ON ea.h = x.h LEFT JOIN e eb ON eb.h = z.h""")
def j9_sequences(spark: SparkSession, d: str) -> DataFrame:
    return foreign(spark, d)[0].select("row_id", "pair_bits", "a_bits", "b_bits")


@query("j9_exposure_audit", _FOREIGN + """u AS (SELECT DISTINCT t.a, t.b, least(x.h, z.h) AS lo, greatest(x.h, z.h) AS hi FROM t JOIN ent x ON x.entity = t.a JOIN ent z ON z.entity = t.b),
m AS (SELECT split, count(*) AS matched FROM met JOIN u ON lo = least(ha, hb) AND hi = greatest(ha, hb) WHERE inside GROUP BY split),
o AS (SELECT split, count(DISTINCT id) AS missing FROM (SELECT split, a AS id FROM met WHERE ha IS NULL UNION ALL SELECT split, b FROM met WHERE hb IS NULL) GROUP BY split)
SELECT met.split, count(*) AS source_rows, CAST(sum(y) AS BIGINT) AS positive_rows, coalesce(max(missing), 0) AS missing_ids, count(*) FILTER (NOT inside) AS filtered_rows, coalesce(max(matched), 0) AS matched
FROM met LEFT JOIN m ON m.split = met.split LEFT JOIN o ON o.split = met.split GROUP BY met.split""")
def j9_audit(spark: SparkSession, d: str) -> DataFrame:
    return foreign(spark, d)[1]


@query("j10_endpoint_unexposed", X.ctes("pairs", "split") + """, e AS (SELECT a AS x FROM split WHERE split = 'val' AND y = 1 UNION SELECT b FROM split WHERE split = 'val' AND score > 0.099)
SELECT row_id, y FROM split WHERE split = 'test' AND a NOT IN (SELECT x FROM e) AND b NOT IN (SELECT x FROM e)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    rows = X.split(spark, d)
    val = rows.filter("split = 'val'")
    seen = val.filter("y = 1").select(F.col("a").alias("entity")).union(val.filter("score > 0.099").select("b"))
    return P.drop_touching(rows.filter("split = 'test'"), seen).select("row_id", "y")


@query("j15_split_overlap", X.ctes("pairs") + """, s AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, y, line FROM pairs), r AS (SELECT lo, hi, max(y) AS y1, min(y) AS y0 FROM s WHERE line <= 4 GROUP BY ALL),
t AS (SELECT lo, hi, max(y) AS t1, min(y) AS t0 FROM s WHERE line > 4 GROUP BY ALL)
SELECT count(*) AS shared_pairs, count(*) FILTER ((y1 = 1 AND t1 = 1) OR (y0 = 0 AND t0 = 0)) AS same_label, count(*) FILTER ((y1 = 1 AND t0 = 0) OR (y0 = 0 AND t1 = 1)) AS opposite_label FROM t JOIN r USING (lo, hi)""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    return P.split_overlap(X.pairs(spark, d).withColumn("split", F.when(F.col("line") <= 4, "train").otherwise("test")))


@query("j18_overlay_merge", X.ctes("pairs") + """SELECT p.row_id, coalesce(n.share, p.score) AS score, CASE WHEN n.share IS NOT NULL THEN 'patch' ELSE 'base' END AS source
FROM pairs p LEFT JOIN (SELECT row_id, share FROM pairs WHERE y = 1 AND line = 2) n USING (row_id)""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    patch = rows.filter("y = 1 AND line = 2").select("row_id", F.col("share").alias("score"))
    return P.overlay(rows.select("row_id", "score"), patch, ["row_id"], "score")


@query("j17_prior_result_reuse", X.ctes("pairs", "split") + """, v AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, max(score) AS known FROM split WHERE line <= 2 GROUP BY ALL)
SELECT line, count(known) AS reused, count(*) - count(known) AS missing FROM split LEFT JOIN v ON least(a, b) = lo AND greatest(a, b) = hi WHERE line > 2 GROUP BY line""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    keyed = P.canonical_pair(X.split(spark, d))
    prior = keyed.filter("line <= 2").groupBy("lo", "hi").agg(F.max("score").alias("known"))
    rows = keyed.filter("line > 2").select("line", "lo", "hi", F.lit(None).cast("double").alias("known"))
    merged = P.overlay(rows, prior, ["lo", "hi"], "known")
    return merged.groupBy("line").agg(F.sum((F.col("source") == "patch").cast("long")).alias("reused"), F.sum((F.col("source") == "missing").cast("long")).alias("missing"))


@query("s14_both_orientations", X.ctes("pairs") + "SELECT a, b, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM (SELECT a, b, y FROM pairs UNION ALL SELECT b, a, y FROM pairs) GROUP BY ALL")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return P.both_orientations(X.pairs(spark, d)).groupBy("a", "b").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))


@query("a1_multiset_difference", X.ctes("pairs") + """, o AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, y, count(*) AS l FROM pairs WHERE line <> 7 GROUP BY ALL), n AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, y, count(*) AS r FROM pairs GROUP BY ALL)
SELECT lo, hi, y, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM o FULL JOIN n USING (lo, hi, y) WHERE coalesce(l, 0) <> coalesce(r, 0)""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    keyed = P.canonical_pair(X.pairs(spark, d))
    return P.multiset_difference(keyed.filter("line <> 7"), keyed, ["lo", "hi", "y"])


@query("a4_version_diff", _KEYED + """, o AS (SELECT lo, hi, max(score) AS s0 FROM k WHERE line > 1 GROUP BY ALL), n AS (SELECT lo, hi, max(score) AS s1 FROM k WHERE line < 7 GROUP BY ALL)
SELECT count(*) FILTER (s0 IS NOT NULL AND s1 IS NOT NULL) AS shared, count(*) FILTER (s0 IS NULL) AS added, count(*) FILTER (s1 IS NULL) AS removed, count(*) FILTER (s0 <> s1) AS changed FROM o FULL JOIN n USING (lo, hi)""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    return P.version_diff(P.collapse_edges(rows.filter("line > 1")), P.collapse_edges(rows.filter("line < 7")))


@query("a7_score_invariance", _KEYED + "SELECT lo, hi, min(score) AS least, max(score) AS most, count(*) AS rows FROM k GROUP BY lo, hi HAVING max(score) > min(score)")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return P.score_invariance(X.pairs(spark, d))


@query("a8_balance_violations", _DEGREES + """, u AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS n, sum(y) AS p FROM pairs GROUP BY ALL)
SELECT count(*) FILTER (lo = hi) AS self_pairs, count(*) FILTER (n > 1) AS repeated_pairs, CAST(abs(2 * sum(p) - sum(n)) AS BIGINT) AS label_imbalance, (SELECT count(*) FROM g WHERE neg > 6 * pos) AS over_cap FROM u""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return P.balance_violations(X.pairs(spark, d))


@query("a9_directed_consistency", _KEYED + "SELECT lo, hi, count(*) AS rows, count(DISTINCT (score, tax)) AS tuples, count(DISTINCT (score, tax)) = 1 AS consistent FROM k GROUP BY lo, hi")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return P.directed_consistency(X.pairs(spark, d), ["score", "tax"])


@query("a11_labelled_union", X.ctes("pairs") + "SELECT y, count(*) AS rows, count(DISTINCT a) AS left_ends FROM pairs GROUP BY y")
def a11(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    union = P.labelled_union(rows.filter("y = 1"), rows.filter("y = 0"), ["a", "b", "row_id"])
    return union.groupBy("y").agg(F.count("*").alias("rows"), F.count_distinct("a").alias("left_ends"))


@query("j14_swap_quartets", X.ctes("blocs") + """SELECT p.a, p.b, q.a AS c, q.b AS d FROM blocs p JOIN blocs q ON p.y = 1 AND q.y = 1 AND p.a < q.a AND p.b <> q.b
JOIN blocs x ON x.a = p.a AND x.b = q.b AND x.y = 0 JOIN blocs z ON z.a = q.a AND z.b = p.b AND z.y = 0""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    return P.swap_quartets(X.blocs(spark, d))


@query("w5_top_hits_per_query", "WITH" + _HITS[1:] + """, best AS (SELECT q, t, max(bits) AS bits FROM hits GROUP BY q, t), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bits DESC, t) AS rank FROM best)
SELECT q, t, bits, rank FROM r WHERE rank <= 5""")
def w5(spark: SparkSession, d: str) -> DataFrame:
    best = hits(spark, d).groupBy("q", "t").agg(F.max("bits").alias("bits"))
    return P.rank_within(best, ["q"], [F.desc("bits"), F.col("t")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("w5_exact_first_hits", "WITH" + _HITS[1:] + """, best AS (SELECT q, t, max(bits) AS bits FROM hits GROUP BY q, t), every AS (SELECT q, t, bits FROM best UNION ALL SELECT p_partkey, p_partkey, NULL FROM part WHERE (p_partkey, p_partkey) NOT IN (SELECT (q, t) FROM best)),
r AS (SELECT q, t, bits, q = t AS exact, row_number() OVER (PARTITION BY q ORDER BY q = t DESC, bits DESC NULLS LAST, t) AS rank FROM every) SELECT * FROM r WHERE rank <= 5""")
def w5_exact(spark: SparkSession, d: str) -> DataFrame:
    """A part's exact match is the supplier of its number; most parts have none and get one."""
    queries = X.table(spark, d, "part").select(F.col("p_partkey").alias("q"))
    return P.exact_first_hits(hits(spark, d), queries, 5).withColumn("rank", F.col("rank").cast("long"))


@query("w11_hash_priority_sample", X.ctes("pairs") + ", r AS (SELECT b, row_id, row_number() OVER (PARTITION BY b ORDER BY sha256(CAST(row_id AS VARCHAR))) AS rank FROM pairs) SELECT * FROM r WHERE rank <= 64")
def w11(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.col("row_id").cast("string").cast("binary"), 256)
    return P.rank_within(X.pairs(spark, d).select("b", "row_id"), ["b"], [key], 64).withColumn("rank", F.col("rank").cast("long"))



@query("j12_interolog_lookup", X.ctes("blocs") + """, h AS (SELECT q, t, w FROM (SELECT DISTINCT x.a AS q, z.a AS t, 0.9 AS w FROM blocs x JOIN blocs z ON x.n_rows = z.n_rows AND x.a <> z.a)
UNION ALL SELECT DISTINCT a, a, 1.0 FROM blocs UNION ALL SELECT DISTINCT b, b, 1.0 FROM blocs),
e AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM blocs WHERE y = 1), m AS (SELECT lo AS u, hi AS v FROM e UNION ALL SELECT hi, lo FROM e),
s AS (SELECT p.a, p.b, max(x.w * z.w) AS interolog, count(*) AS support FROM blocs p JOIN h x ON x.q = p.a JOIN m ON m.u = x.t JOIN h z ON z.q = p.b AND z.t = m.v GROUP BY ALL)
SELECT p.a, p.b, round(coalesce(interolog, 0), 6) AS interolog, coalesce(support, 0) AS support FROM blocs p LEFT JOIN s USING (a, b)""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    blocs = X.blocs(spark, d)
    left, right = blocs.select(F.col("a").alias("q"), "n_rows"), blocs.select(F.col("a").alias("t"), "n_rows")
    similar = left.join(right, "n_rows").filter("q <> t").select("q", "t").distinct().withColumn("w", F.lit(0.9))
    same = blocs.select("a").union(blocs.select("b")).distinct().select(F.col("a").alias("q"), F.col("a").alias("t"), F.lit(1.0).alias("w"))
    edges = P.canonical_pair(blocs.filter("y = 1")).select("lo", "hi")
    rows = blocs.withColumn("row_id", F.concat_ws(":", "a", "b"))
    return rounded(P.interolog_scores(rows, similar.union(same), edges).select("a", "b", "interolog", "support"), "interolog")
