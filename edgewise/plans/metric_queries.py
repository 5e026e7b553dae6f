"""Queries over frozen scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw
from edgewise.operators import metrics as M
from edgewise.operators.pairs import entity_degrees

from . import fixtures as X
from .registry import query


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})  # no negative zeros


_CURVE = X.ctes("pairs", "scores") + """,
g AS (SELECT model, score, sum(y) AS tp, sum(1 - y) AS fp FROM scores GROUP BY model, score),
c AS (SELECT *, sum(tp) OVER w AS cum_tp, sum(fp) OVER w AS cum_fp, sum(tp) OVER (PARTITION BY model) AS all_p, sum(fp) OVER (PARTITION BY model) AS all_n
      FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query("w1_weighted_ap_auroc", X.ctes("pairs", "scores") + """,
g AS (SELECT model, score, sum(line * y) AS tp, sum(line * (1 - y)) AS fp FROM scores GROUP BY model, score),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, CAST(sum(tp) AS DOUBLE) AS p, CAST(sum(fp) AS DOUBLE) AS n, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS ap,
       round(sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp), 6) AS auroc FROM c GROUP BY model""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.ap_auroc(X.scores(spark, d), ["model"], weight="line"), "ap", "auroc")


@query("w2_auroc_unweighted", _CURVE + "SELECT model, round(sum(fp * (cum_tp - tp / 2.0)) / sum(tp) / sum(fp), 6) AS auroc FROM c GROUP BY model")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.ap_auroc(X.scores(spark, d), ["model"]).select("model", "auroc"), "auroc")


@query("w3_curve_points", _CURVE + """SELECT model, round(score, 6) AS score, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(cum_tp AS DOUBLE) AS cum_tp,
    CAST(cum_fp AS DOUBLE) AS cum_fp, CAST(all_p AS DOUBLE) AS all_p, CAST(all_n AS DOUBLE) AS all_n FROM c""")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.curve(X.scores(spark, d), ["model"]), "score")


@query("w3_trapezoid_pr_area", _CURVE + """, r AS (SELECT model, score, cum_tp / (cum_tp + cum_fp) AS pr, cum_tp / all_p AS rc FROM c),
l AS (SELECT *, coalesce(lag(pr) OVER w, 1.0) AS pr0, coalesce(lag(rc) OVER w, 0.0) AS rc0 FROM r WINDOW w AS (PARTITION BY model ORDER BY score DESC))
SELECT model, round(sum((rc - rc0) * (pr + pr0) / 2), 6) AS pr_area FROM l GROUP BY model""")
def w3_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.trapezoid_pr_area(X.scores(spark, d), ["model"]), "pr_area")


@query("w4_best_f1_threshold", _CURVE + """, f AS (SELECT model, score, round(2 * cum_tp / (cum_tp + cum_fp + all_p), 12) AS f1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score DESC) AS k FROM f)
SELECT model, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM r WHERE k = 1""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.best_f1(X.scores(spark, d), ["model"]), "threshold", "f1")


@query("w6_spearman", X.ctes("pairs") + """, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS x,
    rank() OVER (ORDER BY share) + (count(*) OVER (PARTITION BY share) - 1) / 2.0 AS z FROM pairs) SELECT round(corr(x, z), 6) AS spearman FROM r""")
def w6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.spearman(X.pairs(spark, d), [], "score", "share"), "spearman")


_ANCHOR = X.ctes("pairs", "scores") + """,
anchors AS (SELECT a AS anchor, model, score, y FROM scores UNION ALL SELECT b, model, score, y FROM scores),
g AS (SELECT anchor, model, score, sum(y) AS tp, sum(1 - y) AS fp FROM anchors GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY anchor, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT anchor, model, sum(tp) AS p, sum(fp) AS n, sum(CASE WHEN ct + cf > 0 THEN tp * ct / (ct + cf) ELSE 0 END) AS s, sum(fp * (ct - tp / 2.0)) AS area FROM c GROUP BY ALL)
"""


@query("w7_anchor_concordance", _ANCHOR + "SELECT model, count(*) AS anchors, round(avg(area / p / n), 6) AS concordance FROM m WHERE p >= 2 AND n >= 2 GROUP BY model")
def w7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.anchor_concordance(X.scores(spark, d), ["model"]), "concordance")


@query("g19_macro_ap", _ANCHOR + "SELECT model, count(*) AS anchors, round(avg(s / p), 6) AS macro_ap, round(avg(area / p / n), 6) AS macro_auroc FROM m WHERE p + n >= 10 AND p > 0 AND n > 0 GROUP BY model")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.macro_ap(X.scores(spark, d), ["model"]), "macro_ap", "macro_auroc")


@query("w9_early_retrieval", X.ctes("pairs") + """,
g AS (SELECT b, score, CAST(sum(y) AS DOUBLE) AS p, count(*) AS n FROM pairs GROUP BY b, score),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY b ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS st FROM g),
r AS (SELECT b, p, n, st, greatest(least(st + n, 20) - st, 0) AS inside FROM s),
t AS (SELECT b, sum(p / n * inside) AS found, sum(CASE WHEN inside > 0 THEN p / n * list_sum(list_transform(range(st + 1, least(st + n, 20) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0 END) AS dcg, sum(p) AS all_p FROM r GROUP BY b)
SELECT b, all_p, round(CASE WHEN all_p > 0 THEN found / all_p ELSE 0 END, 6) AS recall_at_k,
       round(CASE WHEN all_p > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(all_p, 20) AS BIGINT) + 1), lambda i: 1 / log2(i + 1.0))) ELSE 0 END, 6) AS ndcg_at_k FROM t""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.early_retrieval(X.pairs(spark, d), ["b"], 20), "recall_at_k", "ndcg_at_k")


@query("w10_top_k_overlap", X.ctes("pairs") + """,
o AS (SELECT row_id, y AS y1 FROM pairs ORDER BY score DESC, row_id LIMIT 1000), t AS (SELECT row_id, y AS y2 FROM pairs ORDER BY share DESC, row_id LIMIT 1000),
j AS (SELECT * FROM o FULL JOIN t USING (row_id))
SELECT count(*) FILTER (y1 IS NOT NULL AND y2 IS NOT NULL) AS shared, count(*) FILTER (y1 = 1) AS positives_one, count(*) FILTER (y2 = 1) AS positives_two,
       count(*) FILTER (y1 = 1 AND y2 IS NULL) AS only_one, count(*) FILTER (y2 = 1 AND y1 IS NULL) AS only_two FROM j""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return M.top_k_overlap(X.pairs(spark, d), "score", "share", 1000)


@query("t3_precision_at_budget", X.ctes("pairs") + ", o AS (SELECT y FROM pairs ORDER BY share DESC, row_id LIMIT 500) SELECT count(*) AS rows, round(avg(y), 6) AS precision FROM o")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return X.pairs(spark, d).orderBy(F.desc("share"), "row_id").limit(500).agg(F.count("*").alias("rows"), F.round(F.avg("y"), 6).alias("precision"))


@query("g8_binned_strata", X.ctes("pairs", "scores") + """,
s AS (SELECT *, unnest(list_filter(['all', CASE WHEN line <= 2 THEN 'early' END, CASE WHEN line > 4 THEN 'late' END], lambda x: x IS NOT NULL)) AS stratum FROM scores),
g AS (SELECT stratum, model, score, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY stratum, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT stratum, model, CAST(sum(tp) AS DOUBLE) AS p, CAST(sum(fp) AS DOUBLE) AS n, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS ap, round(sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp), 6) AS auroc
FROM c GROUP BY ALL""")
def g8(spark: SparkSession, d: str) -> DataFrame:
    strata = {"all": F.lit(True), "early": F.col("line") <= 2, "late": F.col("line") > 4}
    return rounded(M.strata_metrics(X.scores(spark, d), strata, ["model"]), "ap", "auroc")


@query("g9_train_quantile_bins", X.ctes("pairs", "split") + """,
q AS (SELECT list_distinct(quantile_cont(share, [0.25, 0.5, 0.75])) AS cuts FROM split WHERE split = 'train')
SELECT split, CAST(len(list_filter(cuts, lambda c: c < share)) AS INTEGER) AS bin, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM split, q GROUP BY ALL""")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return M.train_quantile_bins(X.split(spark, d), "share", F.col("split") == "train").groupBy("split", "bin").agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))


@query("g10_operating_point", X.ctes("pairs", "scores") + """,
c AS (SELECT model, CAST(count(*) FILTER (score >= 0.5 AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (score >= 0.5 AND y = 0) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (score < 0.5 AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (score < 0.5 AND y = 0) AS DOUBLE) AS tn FROM scores GROUP BY model)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
       round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.operating_point(X.scores(spark, d), ["model"], 0.5), "precision", "recall", "specificity", "f1", "accuracy", "mcc")


@query("g11_brier_and_bce", X.ctes("pairs", "scores") + """, c AS (SELECT *, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM scores)
SELECT model, round(avg((score - y) * (score - y)), 5) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bce, round(min(score), 6) AS least, round(max(score), 6) AS most,
       count(DISTINCT score) AS distinct_scores, count(*) FILTER (score = 0) AS zeros FROM c GROUP BY model""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(M.score_summary(X.scores(spark, d), ["model"]), "bce", "least", "most"), "brier", places=5)


@query("g12_calibration_bins", X.ctes("pairs", "scores") + """SELECT model, CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS rows, round(avg(score), 6) AS predicted, round(avg(y), 6) AS observed
FROM scores GROUP BY ALL""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.calibration_bins(X.scores(spark, d), ["model"]), "predicted", "observed")


_LOGITS = X.ctes("pairs", "scores") + ", l AS (SELECT *, score * 4 - 2 AS ab, score * 4 - 2 + (line - 3) / 10.0 AS ba FROM scores) "


@query("g13_orientation_gaps", _LOGITS + """SELECT model, round(avg(abs(ab - ba)), 6) AS logit_gap, round(avg(abs(1 / (1 + exp(-ab)) - 1 / (1 + exp(-ba)))), 6) AS probability_gap,
    count(*) FILTER ((ab >= 0) <> (ba >= 0)) AS flips, round(corr(ab, ba), 6) AS correlation FROM l GROUP BY model""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    base = F.col("score") * 4 - 2
    return rounded(M.orientation_gaps(X.scores(spark, d).withColumns({"logit_ab": base, "logit_ba": base + (F.col("line") - 3) / 10.0}), ["model"]), "logit_gap", "probability_gap", "correlation")


@query("g14_score_concordance", X.ctes("pairs") + """, c AS (SELECT score * 10 AS one, share AS two FROM pairs)
SELECT round(avg(abs(one - two)), 6) AS mae, round(max(abs(one - two)), 6) AS most, round(quantile_cont(abs(one - two), 0.5), 6) AS median, round(quantile_cont(abs(one - two), 0.99), 6) AS p99,
       count(*) FILTER ((one >= 0.5) <> (two >= 0.5)) AS flips FROM c""")
def g14(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.concordance(X.pairs(spark, d).withColumn("one", F.col("score") * 10), [], "one", "share"), "mae", "most", "median", "p99")


@query("g15_quantile_summary", X.ctes("entity") + """SELECT grp, min(len) AS least, round(quantile_cont(len, 0.1), 6) AS q10, round(quantile_cont(len, 0.25), 6) AS q25, round(quantile_cont(len, 0.5), 6) AS median,
    round(quantile_cont(len, 0.75), 6) AS q75, round(quantile_cont(len, 0.9), 6) AS q90, max(len) AS most FROM entity GROUP BY grp""")
def g15(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.quantiles(X.entity(spark, d).withColumn("len", F.col("len").cast("long")), ["grp"], "len"), "q10", "q25", "median", "q75", "q90")


@query("g16_mcnemar", X.ctes("pairs") + """, c AS (SELECT line, (score * 10 >= 0.5) = (y = 1) AS r1, (share >= 0.5) = (y = 1) AS r2 FROM pairs),
n AS (SELECT line, CAST(count(*) FILTER (r1 AND NOT r2) AS DOUBLE) AS only_one, CAST(count(*) FILTER (NOT r1 AND r2) AS DOUBLE) AS only_two FROM c GROUP BY line)
SELECT *, round(pow(only_one - only_two, 2) / (only_one + only_two), 6) AS chi2, round(pow(greatest(abs(only_one - only_two) - 1, 0), 2) / (only_one + only_two), 6) AS chi2_corrected FROM n""")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.mcnemar(X.pairs(spark, d).withColumn("one", F.col("score") * 10), ["line"], "one", "share"), "chi2", "chi2_corrected")


@query("g17_degree_concentration", X.ctes("pairs") + """, e AS (SELECT a AS entity, y FROM pairs UNION ALL SELECT b, y FROM pairs),
g AS (SELECT entity, sum(y) AS pos, sum(1 - y) AS neg, count(*) AS d FROM e GROUP BY entity), r AS (SELECT *, row_number() OVER (ORDER BY d DESC, entity) AS k, count(*) OVER () AS n,
    rank() OVER (ORDER BY pos) + (count(*) OVER (PARTITION BY pos) - 1) / 2.0 AS rp, rank() OVER (ORDER BY neg) + (count(*) OVER (PARTITION BY neg) - 1) / 2.0 AS rn FROM g)
SELECT round(corr(rp, rn), 6) AS degree_spearman, count(*) AS entities, CAST(sum(d) AS BIGINT) AS rows, count(*) FILTER (pos > 0 AND neg = 0) AS positive_only, count(*) FILTER (pos = 0 AND neg > 0) AS negative_only,
       CAST(sum(d) FILTER (k <= greatest(1, ceil(n / 100.0))) AS BIGINT) AS top_rows FROM r""")
def g17(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.degree_concentration(entity_degrees(X.pairs(spark, d))), "degree_spearman")


@query("g18_coverage_by_class", X.ctes("pairs") + "SELECT y, count(*) AS rows, count(*) FILTER (score > 0) AS scored, count(*) FILTER (score > 0 AND tax > 0) AS both FROM pairs GROUP BY y")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return M.coverage_by_class(X.pairs(spark, d), {"scored": F.col("score") > 0, "both": (F.col("score") > 0) & (F.col("tax") > 0)})


@query("g20_balanced_ap", X.ctes("pairs", "scores") + """, n AS (SELECT model, sum(y) AS p, sum(1 - y) AS q FROM scores GROUP BY model),
g AS (SELECT s.model, score, sum(y * 0.5 / p) AS tp, sum((1 - y) * 0.5 / q) AS fp FROM scores s JOIN n USING (model) GROUP BY s.model, score),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS balanced_ap FROM c GROUP BY model""")
def g20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.balanced_ap(X.scores(spark, d), ["model"]), "balanced_ap")


@query("g31_log_windows", X.ctes("log") + "SELECT run, CAST(floor(upd / 500) AS BIGINT) AS \"window\", count(*) AS rows, round(avg(value), 6) AS mean, max(value) AS most, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END), 6) AS above_one FROM log GROUP BY ALL")
def g31(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.log_windows(X.log(spark, d), "run", "upd", "value", 500), "mean", "above_one")


@query("g31_trailing_windows", X.ctes("log") + """, t AS (SELECT run, upd, count(*) OVER w AS rows, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS most, round(avg(CASE WHEN value > 1 THEN 1.0 ELSE 0.0 END) OVER w, 6) AS above_one
FROM log WINDOW w AS (PARTITION BY run ORDER BY upd RANGE BETWEEN 499 PRECEDING AND CURRENT ROW)) SELECT * FROM t""")
def g31_trailing(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.trailing_windows(X.log(spark, d), "run", "upd", "value", 500), "mean", "above_one")


@query("w1_continuous_scores", X.ctes("pairs") + """, s AS (SELECT line AS model, ('0x' || substr(sha256('cont:' || row_id), 1, 15))::BIGINT / 1152921504606846976.0 + y / 4.0 AS score, y FROM pairs),
g AS (SELECT model, score, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY model, score),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT model, CAST(sum(tp) AS DOUBLE) AS p, CAST(sum(fp) AS DOUBLE) AS n, round(sum(tp * ct / (ct + cf)) / sum(tp), 6) AS ap, round(sum(fp * (ct - tp / 2.0)) / sum(tp) / sum(fp), 6) AS auroc FROM c GROUP BY model""")
def w1_continuous(spark: SparkSession, d: str) -> DataFrame:
    """Scores without ties: every row is a point of its curve."""
    draw = hash_draw(F.concat(F.lit("cont:"), F.col("row_id").cast("string"))) / F.lit(float(1 << 60))
    rows = X.pairs(spark, d).select(F.col("line").alias("model"), (draw + F.col("y") / 4.0).alias("score"), "y")
    return rounded(M.ap_auroc(rows, ["model"]), "ap", "auroc")


@query("g32_best_checkpoint", X.ctes("log") + """, g AS (SELECT *, value - lag(value) OVER (PARTITION BY run ORDER BY upd) AS gain, row_number() OVER (PARTITION BY run ORDER BY value DESC, upd) AS k,
    max(upd) OVER (PARTITION BY run) AS last FROM log)
SELECT run, max(upd) FILTER (k = 1) AS best_update, max(value) FILTER (k = 1) AS best_value, max(upd) FILTER (k = 1) = max(last) AS at_horizon, round(max(gain) FILTER (upd = last), 6) AS last_gain FROM g GROUP BY run""")
def g32(spark: SparkSession, d: str) -> DataFrame:
    return rounded(M.best_checkpoint(X.log(spark, d), "run", "upd", "value"), "last_gain")


@query("g33_macro_over_sets", X.ctes("pairs", "scores") + """,
g AS (SELECT line AS test, model, score, sum(y) AS tp, sum(1 - y) AS fp FROM scores GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY test, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT test, model, round(sum(tp * ct / (ct + cf)) / sum(tp), 9) AS ap FROM c GROUP BY ALL), r AS (SELECT *, max(ap) OVER (PARTITION BY test) AS best FROM m)
SELECT model, count(*) AS sets, round(avg(ap), 6) AS mean, count(*) FILTER (ap = best) AS wins FROM r GROUP BY model""")
def g33(spark: SparkSession, d: str) -> DataFrame:
    by_set = M.ap_auroc(X.scores(spark, d).withColumnRenamed("line", "test"), ["test", "model"]).withColumn("ap", F.round("ap", 9))
    return rounded(M.macro_over_sets(by_set), "mean")


@query("g35_run_accounting", X.ctes("log") + """, e AS (SELECT run, count(*) AS rows, count(DISTINCT kind) AS kinds, round(date_diff('second', min(ts), max(ts)) / 3600.0, 2) AS hours, max(value) AS best FROM log GROUP BY run),
f AS (SELECT run, value AS final FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY upd DESC) AS k FROM log) WHERE k = 1) SELECT e.*, f.final, round(e.best - f.final, 6) AS lost FROM e JOIN f USING (run)""")
def g35(spark: SparkSession, d: str) -> DataFrame:
    log = X.log(spark, d)
    hours = F.round((F.date_trunc("second", F.max("ts")).cast("long") - F.date_trunc("second", F.min("ts")).cast("long")) / 3600.0, 2)
    facts = log.groupBy("run").agg(F.count("*").alias("rows"), F.count_distinct("kind").alias("kinds"), hours.alias("hours"), F.max("value").alias("best"), F.max_by("value", "upd").alias("final"))
    return facts.withColumn("lost", F.round(F.col("best") - F.col("final"), 6))
