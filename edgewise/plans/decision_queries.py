"""Queries for audits, exposure and decisions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators import audits as A
from edgewise.operators import decide as D
from edgewise.operators import metrics as M
from edgewise.operators import pairs as P

from . import fixtures as X
from .metric_queries import rounded
from .registry import query

_H = "('0x' || substr(sha256({}), 1, 15))::BIGINT"


@query("a2_multiset_digest", X.ctes("pairs") + f", g AS (SELECT a, b, y, count(*) AS n FROM pairs GROUP BY ALL) SELECT bit_xor({_H.format('concat_ws(chr(124), a, b, y, n)')}) AS digest, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows FROM g")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return A.multiset_digest(X.pairs(spark, d), ["a", "b", "y"])


_FIELDS = " || ".join(f"'v' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in ("a", "b", "y"))


@query("a2_additive_digest", X.ctes("pairs") + ", r AS (SELECT " + _FIELDS + " AS t FROM pairs) SELECT " + ", ".join(f"CAST(sum(CAST({_H.format(f"'{p}|' || t")} AS HUGEINT)) % 2305843009213693951 AS BIGINT) AS d{p}" for p in range(4)) + ", count(*) AS rows FROM r")
def a2_additive(spark: SparkSession, d: str) -> DataFrame:
    return A.additive_digest(X.pairs(spark, d), ["a", "b", "y"])


@query("a3_split_disjointness", X.ctes("entity") + """, s AS (SELECT *, CASE WHEN entity % 3 = 0 THEN 'test' WHEN entity % 3 = 1 THEN 'train' ELSE 'val' END AS split FROM entity),
l AS (SELECT DISTINCT split, 'sha' AS key, sha AS v FROM s UNION SELECT DISTINCT split, 'family', family FROM s UNION SELECT DISTINCT split, 'entity', CAST(entity AS VARCHAR) FROM s),
p AS (SELECT x.split AS one, z.split AS two FROM (SELECT DISTINCT split FROM s) x JOIN (SELECT DISTINCT split FROM s) z ON x.split < z.split), k AS (SELECT DISTINCT key FROM l)
SELECT k.key, one, two, (SELECT count(*) FROM l x JOIN l z ON x.key = z.key AND x.v = z.v WHERE x.key = k.key AND x.split = one AND z.split = two) AS shared FROM p, k""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    third = F.col("entity") % 3
    rows = X.entity(spark, d).withColumn("split", F.when(third == 0, "test").when(third == 1, "train").otherwise("val"))
    return A.disjointness(rows, "split", ["sha", "family", "entity"])


_SHARDS = X.ctes("pairs") + """, act AS (SELECT row_id, CASE WHEN line = 6 AND share > 0.9 THEN 1 - y ELSE y END AS y, row_id % 8 AS shard, CASE WHEN line = 5 AND share < 0.1 THEN 'nan'::DOUBLE ELSE share END AS v FROM pairs WHERE NOT (line = 7 AND share > 0.5)
UNION ALL SELECT row_id, y, row_id % 8, share FROM pairs WHERE line = 2 AND share > 0.8 UNION ALL SELECT -row_id, y, row_id % 8, share FROM pairs WHERE line = 3 AND share > 0.95)"""


@query("a5_shard_coverage", _SHARDS + """, c AS (SELECT row_id, count(*) AS times, min(shard) AS shard, min(y) AS label, max(CAST(isnan(v) AS INTEGER)) AS bad FROM act GROUP BY row_id), j AS (SELECT p.y AS want, c.* EXCLUDE (row_id) FROM pairs p FULL JOIN c USING (row_id))
SELECT coalesce(CAST(shard AS VARCHAR), 'absent') AS shard, count(*) AS rows, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (want IS NULL) AS extra, count(*) FILTER (times > 1) AS repeated, count(*) FILTER (want <> label) AS other_label, count(*) FILTER (bad = 1) AS not_finite FROM j GROUP BY 1""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    shard = F.col("row_id") % 8
    base = rows.filter("NOT (line = 7 AND share > 0.5)").select("row_id", F.when((F.col("line") == 6) & (F.col("share") > 0.9), 1 - F.col("y")).otherwise(F.col("y")).alias("y"), shard.alias("shard"), F.when((F.col("line") == 5) & (F.col("share") < 0.1), float("nan")).otherwise(F.col("share")).alias("v"))
    twice = rows.filter("line = 2 AND share > 0.8").select("row_id", "y", shard.alias("shard"), F.col("share").alias("v"))
    extra = rows.filter("line = 3 AND share > 0.95").select((-F.col("row_id")).alias("row_id"), "y", shard.alias("shard"), F.col("share").alias("v"))
    return A.shard_coverage(rows, base.union(twice).union(extra), "row_id", "y", ["v"])


@query("a6_feature_contract", """WITH e AS (SELECT vec_id, label, embedding, CASE WHEN label = 3 THEN 0.0 WHEN label = 9 THEN 1.5 ELSE label / 10.0 END AS gate, label <> 0 AS available FROM embeddings)
SELECT count(*) AS rows, count(*) FILTER (len(embedding) <> 64) AS wrong_dims, 0::BIGINT AS not_finite, count(*) FILTER (gate NOT BETWEEN 0 AND 1) AS gate_outside, count(*) FILTER ((gate > 0) <> available) AS gate_disagrees,
count(*) FILTER (NOT available AND list_max(list_transform(embedding, lambda v: abs(v))) > 0) AS evidence_without_support FROM e""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    gate = F.when(F.col("label") == 3, 0.0).when(F.col("label") == 9, 1.5).otherwise(F.col("label") / 10.0)
    rows = X.table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("v"), gate.alias("gate"), (F.col("label") != 0).alias("available"))
    return A.feature_contract(rows, "v", 64, "gate", "available")


@query("a10_exposure_description", X.ctes("entity") + """, h AS (SELECT CAST(e.entity AS VARCHAR) AS entity, sha, family FROM entity e JOIN labels l ON l.doc_id = e.entity UNION ALL SELECT 'b' || item_id, sha256(text), NULL FROM benchmark),
n AS (SELECT CAST(entity AS VARCHAR) AS entity, sha, family FROM entity WHERE grp = 'en'), t AS (SELECT DISTINCT * FROM h)
SELECT count(*) AS ends, count(*) FILTER (entity IN (SELECT entity FROM n)) AS known_ids, count(*) FILTER (sha IN (SELECT sha FROM n)) AS known_sequences, count(*) FILTER (family IN (SELECT family FROM n)) AS known_families,
count(*) FILTER (entity NOT IN (SELECT entity FROM n) AND sha NOT IN (SELECT sha FROM n)) AS unresolved, (SELECT count(*) FROM h) AS rows FROM t""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    entity = X.entity(spark, d).withColumn("entity", F.col("entity").cast("string"))
    labels = X.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("entity"))
    bench = X.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("entity"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit(None).cast("string").alias("family"))
    history = entity.join(labels, "entity").select("entity", "sha", "family").union(bench)
    return A.exposure_description(history, entity.filter("grp = 'en'"))


@query("a12_log_agreement", "WITH r AS (SELECT user_id % 4 AS run, event_id // 8 AS upd, event_type AS v FROM events), g AS (SELECT upd, count(DISTINCT run) AS runs, count(DISTINCT v) AS vals FROM r GROUP BY upd) SELECT count(*) AS shared_updates, count(*) FILTER (vals = 1) AS agreeing FROM g WHERE runs > 1")
def a12(spark: SparkSession, d: str) -> DataFrame:
    log = X.log(spark, d).withColumn("upd", F.floor(F.col("upd") / 8))
    return A.log_agreement(log, "run", "upd", "kind")


@query("j11_panel_funnel", X.ctes("pairs") + """, t AS (SELECT DISTINCT a, b FROM pairs WHERE line = 1), f AS (SELECT *, (a, b) NOT IN (SELECT (a, b) FROM t) AS dis FROM pairs WHERE line > 1),
s AS (SELECT y, unnest(list_filter(['1 source', CASE WHEN score > 0.02 THEN '2 historical' END, CASE WHEN score > 0.02 AND dis THEN '3 disjoint' END, CASE WHEN score > 0.02 AND dis AND share BETWEEN 0.2 AND 0.9 THEN '4 length' END], lambda x: x IS NOT NULL)) AS step FROM f)
SELECT step, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM s GROUP BY step""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    seen = rows.filter("line = 1").select("a", "b").distinct().withColumn("seen", F.lit(1))
    panel = rows.filter("line > 1").join(seen, ["a", "b"], "left")
    return A.funnel(panel, [("1 source", F.lit(True)), ("2 historical", F.col("score") > 0.02), ("3 disjoint", F.col("seen").isNull()), ("4 length", F.col("share").between(0.2, 0.9))])


@query("j16_triple_overlap", """WITH r AS (SELECT p_brand AS w, p_type AS m, s_nationkey AS p, l_linenumber AS line FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey), o AS (SELECT * FROM r WHERE line = 1), t AS (SELECT * FROM r WHERE line = 2)
SELECT count(*) AS rows, count(*) FILTER ((w, m, p) IN (SELECT (w, m, p) FROM o)) AS shared_triples, count(*) FILTER ((w, m) IN (SELECT (w, m) FROM o)) AS shared_pairs, count(*) FILTER (w IN (SELECT w FROM o)) AS shared_members FROM t""")
def j16(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, part = (X.table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return A.triple_overlap(rows.withColumn("split", F.col("l_linenumber").cast("string")), "split", "1", "2", ("p_brand", "p_type", "s_nationkey"))


@query("g36_catalogue_coverage", "SELECT o_orderpriority AS split, count(*) AS wanted, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)) AS matched FROM orders GROUP BY 1")
def g36(spark: SparkSession, d: str) -> DataFrame:
    wanted = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("split"))
    return A.catalogue_coverage(wanted, X.table(spark, d, "lineitem").filter("l_discount > 0.05").select(F.col("l_orderkey").alias("key")), "key", "split")


_BY_LINE = X.ctes("pairs", "scores") + """, g AS (SELECT line, model, score, sum(y) AS tp, sum(1 - y) AS fp FROM scores GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY line, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT line, model, sum(tp * ct / (ct + cf)) / sum(tp) AS ap, sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp) AS auroc FROM c GROUP BY ALL),
p AS (SELECT line, max(ap) FILTER (model = 'm0') AS control, max(ap) FILTER (model = 'm2') AS candidate, max(auroc) FILTER (model = 'm0') AS c_roc, max(auroc) FILTER (model = 'm2') AS d_roc FROM m GROUP BY line)"""


def by_line(spark: SparkSession, d: str) -> DataFrame:
    per = M.ap_auroc(X.scores(spark, d), ["line", "model"])
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("ap")))
    return per.groupBy("line").agg(pick("m0").alias("control"), pick("m2").alias("candidate"))


@query("e1_fold_promotion", _BY_LINE + " SELECT count(*) AS folds, round(avg(candidate - control), 6) AS mean_gain, count(*) FILTER (candidate > control) AS positive_folds, round(min(candidate - control), 6) AS worst, avg(candidate - control) >= 0.01 AND count(*) FILTER (candidate > control) >= 5 AND min(candidate - control) >= -0.02 AS promote FROM p")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.fold_promotion(by_line(spark, d), 0.01, 5, 0.02), "mean_gain", "worst")


@query("e2_practical_gain", _BY_LINE + " SELECT line, round(candidate - control, 6) AS point, candidate - control >= 0.05 AS large_enough, candidate - control - 0.02 > 0 AS above_zero, candidate - control > 0.001 * line AS beyond_control, control > -0.01 AS auroc_held, candidate - control >= 0.05 AND candidate - control > 0.02 AND candidate - control > 0.001 * line AS accept FROM p")
def e2(spark: SparkSession, d: str) -> DataFrame:
    point = F.col("candidate") - F.col("control")
    rows = by_line(spark, d).select("line", point.alias("point"), (point - 0.02).alias("low"), (0.001 * F.col("line")).alias("control_point"), F.col("control").alias("auroc_low"))
    return rounded(D.practical_gain(rows, 0.05, 0.01).drop("low", "control_point", "auroc_low"), "point")


@query("e3_interval_verdict", """WITH i AS (SELECT l_suppkey AS s, avg(l_discount) - 0.05 - 0.002 AS low, avg(l_discount) - 0.05 + 0.002 AS high FROM lineitem GROUP BY 1)
SELECT s, CASE WHEN low > 0 THEN 'superior' WHEN high < -0.001 THEN 'inferior' WHEN low > -0.001 AND high < 0.001 THEN 'equivalent' WHEN low > -0.001 THEN 'not inferior' ELSE 'open' END AS verdict FROM i""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    """Exact decimal sums face the limits times the rows, so a mean at a limit is decided without rounding; no discount is open, and a group with one beyond 1e9, infinite or NaN takes its mean in doubles."""
    discount, plain = F.col("l_discount"), F.abs("l_discount") < 1e9
    exact, kind = F.sum(F.when(plain, discount).cast("decimal(28,18)")), "decimal(37,18)"
    sums = X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(exact.cast(kind).alias("total"), F.count("l_discount").alias("n"), F.count_if(~plain).alias("odd"), F.avg("l_discount").alias("m"))
    times = lambda limit: (F.col("n") * F.lit(Decimal(limit))).cast(kind)
    verdict = D.interval_verdict(F.col("total") - times("0.052"), F.col("total") - times("0.048"), times("0.001"))
    rough = D.interval_verdict(F.col("m") - 0.05 - 0.002, F.col("m") - 0.05 + 0.002, 0.001)
    return sums.select("s", F.when(F.col("n") == 0, "open").when(F.col("odd") > 0, rough).otherwise(verdict).alias("verdict"))


@query("e4_support_floors", X.ctes("pairs") + "SELECT b, count(*) AS rows, count(DISTINCT a) AS anchors, CAST(sum(y) AS BIGINT) AS positives, count(*) >= 580 AND count(DISTINCT a) >= 500 AND sum(y) >= 190 AS supported FROM pairs GROUP BY b")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return D.support_floors(X.pairs(spark, d), ["b"], {"rows": (F.count("*"), 580), "anchors": (F.count_distinct("a"), 500), "positives": (F.sum("y").cast("long"), 190)})


@query("e5_swap_credit", X.ctes("blocs") + """, q AS (SELECT p.a, p.b, q.a AS c, q.b AS d FROM blocs p JOIN blocs q ON p.y = 1 AND q.y = 1 AND p.a < q.a AND p.b <> q.b JOIN blocs x ON x.a = p.a AND x.b = q.b AND x.y = 0 JOIN blocs z ON z.a = q.a AND z.b = p.b AND z.y = 0)
SELECT q.*, CASE WHEN ab.n_rows + cd.n_rows = ad.n_rows + cb.n_rows THEN 0.5 WHEN ab.n_rows + cd.n_rows > ad.n_rows + cb.n_rows THEN 1.0 ELSE 0.0 END::DOUBLE AS credit FROM q JOIN blocs ab ON ab.a = q.a AND ab.b = q.b JOIN blocs cd ON cd.a = c AND cd.b = d
JOIN blocs ad ON ad.a = q.a AND ad.b = d JOIN blocs cb ON cb.a = c AND cb.b = q.b""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    blocs = X.blocs(spark, d)
    return D.swap_credit(P.swap_quartets(blocs), blocs.select("a", "b", F.col("n_rows").cast("double").alias("score")))


@query("e6_capped_quartets")
def e6(spark: SparkSession, d: str) -> DataFrame:
    """Rows only: the caps are checked in the tests."""
    return D.capped_quartets(P.swap_quartets(X.blocs(spark, d)), 40, 2000, edge_cap=5)


@query("e7_paired_comparison", _BY_LINE + " SELECT line, round(control, 6) AS control_ap, round(candidate, 6) AS candidate_ap, round(candidate - control, 6) AS ap_gain, round(d_roc - c_roc, 6) AS auroc_gain FROM p")
def e7(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d).withColumns({"control": F.col("score") * 10, "candidate": (F.col("tax") * 100 + F.col("y") * 4) / 13.0})
    return rounded(D.paired_comparison(rows, "control", "candidate", "line"), "control_ap", "candidate_ap", "ap_gain", "auroc_gain")


@query("e8_leave_group_out", X.ctes("pairs") + """, t AS (SELECT b AS o FROM pairs GROUP BY b ORDER BY count(*) DESC, b LIMIT 10), e AS (SELECT o, share AS s, y FROM pairs, (SELECT o FROM t UNION ALL SELECT 'none') WHERE b <> o),
g AS (SELECT o, s, sum(y) AS tp, sum(1 - y) AS fp FROM e GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY o ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT o AS left_out, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS ap, round(sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp), 6) AS auroc FROM c GROUP BY o""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.leave_group_out(X.pairs(spark, d), "b", 10, "share"), "ap", "auroc")


@query("e9_null_adequacy", "SELECT l_returnflag AS level, count(*) AS rows, round(avg(CASE WHEN l_quantity / 50 >= 0.5 THEN 1.0 ELSE 0 END), 6) AS adequate FROM lineitem GROUP BY 1")
def e9(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("level"), (F.col("l_quantity") / 50).alias("changed"))
    return rounded(D.null_adequacy(rows, "changed", "level"), "adequate")
