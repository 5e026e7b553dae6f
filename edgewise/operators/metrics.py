"""Evaluation of frozen scores: tie-aware curves, operating points, ranks and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewise.functions.expressions import safe_ratio
from edgewise.functions.shared import materialise


def tie_groups(df: DataFrame, keys: list[str], score: str = "score", label: str = "y", weight: str | None = None) -> DataFrame:
    """Weighted positives ``tp`` and negatives ``fp`` of each score: a row a tie group, combined before any window."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).alias("tp"), F.sum(w * (1 - F.col(label))).alias("fp"))


def running_sums(groups: DataFrame, keys: list[str], order: str, values: list[str], descending: bool = False) -> DataFrame:
    """Add ``cum_`` and ``all_`` of each value, per ``keys`` along ``order``, without a task that holds a whole key.

    The rows are dealt by ranges of (keys, order) and written; each range is
    summed; the sums of the ranges before it, a row a range and key, start the
    running sums inside it.
    """
    along = F.desc(order) if descending else F.col(order)
    placed = materialise(groups.repartitionByRange(*keys, along).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, "__part").agg(*[F.sum(v).alias(v) for v in values])
    before, whole = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    start = [F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__before_{v}") for v in values]
    starts = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__range"), *start, *[F.sum(v).over(whole).alias(f"all_{v}") for v in values])
    same = F.col("__part") == F.col("__range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    run = Window.partitionBy(*keys, "__part").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, same)
    return joined.select(*groups.columns, *[(F.sum(v).over(run) + F.col(f"__before_{v}")).alias(f"cum_{v}") for v in values], *[f"all_{v}" for v in values])


def curve(df: DataFrame, keys: list[str], score: str = "score", label: str = "y", weight: str | None = None, many: bool = False) -> DataFrame:
    """Cumulative weighted positives and negatives at tie-group ends, from the highest score down.

    ``many`` keys (anchors) get a window each; few keys are summed in ranges of
    scores.
    """
    groups = tie_groups(df, keys, score, label, weight)
    if not many:
        return running_sums(groups, keys, "score", ["tp", "fp"], descending=True).withColumnsRenamed({"all_tp": "all_p", "all_fp": "all_n"})
    run = Window.partitionBy(*keys).orderBy(F.desc("score"))
    whole = Window.partitionBy(*keys)
    at = run.rowsBetween(Window.unboundedPreceding, 0)
    return groups.select(*keys, "score", "tp", "fp", F.sum("tp").over(at).alias("cum_tp"), F.sum("fp").over(at).alias("cum_fp"), F.sum("tp").over(whole).alias("all_p"), F.sum("fp").over(whole).alias("all_n"))


def ap_auroc(df: DataFrame, keys: list[str], score: str = "score", label: str = "y", weight: str | None = None, many: bool = False) -> DataFrame:
    """Weighted tie-grouped average precision and AUROC (ties half); null where a class has no mass."""
    points = curve(df, keys, score, label, weight, many)
    precision = safe_ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp"))
    area = F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)
    sums = points.groupBy(*keys).agg(F.sum(F.col("tp") * precision).alias("ap"), F.sum(area).alias("area"), F.max("all_p").alias("p"), F.max("all_n").alias("n"))
    ok = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(*keys, "p", "n", F.when(ok, F.col("ap") / F.col("p")).alias("ap"), F.when(ok, F.col("area") / F.col("p") / F.col("n")).alias("auroc"))


def trapezoid_pr_area(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 at precision 1."""
    points = curve(df, keys, score, label)
    tp, seen = F.col("cum_tp") - F.col("tp"), F.col("cum_tp") + F.col("cum_fp") - F.col("tp") - F.col("fp")
    recall = safe_ratio(F.col("tp"), F.col("all_p"))
    before, now = F.when(seen > 0, tp / seen).otherwise(1.0), F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    steps = points.withColumn("slice", recall * (now + before) / 2)
    return steps.groupBy(*keys).agg(F.sum("slice").alias("pr_area"))


def best_f1(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """The threshold of the greatest F1, the highest such threshold on ties."""
    f1 = safe_ratio(2 * F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp") + F.col("all_p"))
    points = curve(df, keys, score, label).withColumn("f1", F.round(f1, 12))
    best = points.groupBy(*keys).agg(F.max(F.struct("f1", "score")).alias("best"))
    return best.select(*keys, F.col("best.score").alias("threshold"), F.col("best.f1").alias("f1"))


def operating_point(df: DataFrame, keys: list[str], threshold: float, score: str = "score", label: str = "y") -> DataFrame:
    """Counts and rates at a threshold; a rate without rows is 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    c = df.groupBy(*keys).agg(count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({
        "precision": safe_ratio(tp, tp + fp), "recall": safe_ratio(tp, tp + fn), "specificity": safe_ratio(tn, tn + fp), "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn), "mcc": safe_ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def score_summary(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Brier score, cross entropy, range, distinct and zero scores."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = -(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"), F.avg(bce).alias("bce"), F.min(score).alias("least"), F.max(score).alias("most"), F.count_distinct(score).alias("distinct_scores"), F.sum(F.when(F.col(score) == 0, 1).otherwise(0)).cast("long").alias("zeros"))


def calibration_bins(df: DataFrame, keys: list[str], score: str = "score", label: str = "y", bins: int = 10) -> DataFrame:
    """Mean score and observed share in equal bins of [0, 1]."""
    bin_of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, bin_of.alias("bin")).agg(F.count("*").alias("rows"), F.avg(score).alias("predicted"), F.avg(label).alias("observed"))


def orientation_gaps(df: DataFrame, keys: list[str], ab: str = "logit_ab", ba: str = "logit_ba") -> DataFrame:
    """How much two orders of a pair differ."""
    one, two = F.col(ab), F.col(ba)
    p = lambda x: 1 / (1 + F.exp(-x))
    return df.groupBy(*keys).agg(F.avg(F.abs(one - two)).alias("logit_gap"), F.avg(F.abs(p(one) - p(two))).alias("probability_gap"), F.sum(F.when((one >= 0) != (two >= 0), 1).otherwise(0)).cast("long").alias("flips"), F.corr(ab, ba).alias("correlation"))


def average_rank(keys: list[str], column: str) -> Column:
    """Rank with ties at their mean."""
    order = Window.partitionBy(*keys).orderBy(column)
    ties = Window.partitionBy(*keys, column)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks. Ranks come from grouped values, so ties meet before they are summed in ranges."""
    def ranks(column: str, name: str) -> DataFrame:
        sizes = df.groupBy(*keys, column).agg(F.count("*").alias("__n"))
        summed = running_sums(sizes, keys, column, ["__n"])
        return summed.select(*keys, column, (F.col("cum___n") - (F.col("__n") - 1) / 2).alias(name))

    ranked = df.join(ranks(x, "__rx"), [*keys, x]).join(ranks(y, "__ry"), [*keys, y])
    return ranked.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"))


def percentiles(df: DataFrame, keys: list[str], column: str, at: dict[str, float]) -> DataFrame:
    """Exact percentiles, linear between rows; places come from running counts, so no task holds all values of a key. Null values are left out."""
    sizes = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    summed = running_sums(sizes, keys, "__v", ["__n"])
    value, first, last = F.col("__v").cast("double"), F.col("cum___n") - F.col("__n"), F.col("cum___n") - 1
    out = []
    for name, q in at.items():
        place = F.lit(q) * (F.col("all___n") - 1)
        low, high = F.floor(place), F.ceil(place)
        inside = lambda k: F.max(F.when((first <= k) & (k <= last), value))
        between = F.max(place - low)
        out.append((inside(low) * (1 - between) + inside(high) * between).alias(name))
    return summed.groupBy(*keys).agg(*out)


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a key (or one row in all) side by side; null is a key."""
    if not keys:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, same).drop(*[f"__{k}" for k in keys])


def concordance(df: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """Distance between two scores of the same rows and decisions that flip at one half."""
    gaps = df.withColumn("__gap", F.abs(F.col(one) - F.col(two)))
    flips = F.sum(F.when((F.col(one) >= 0.5) != (F.col(two) >= 0.5), 1).otherwise(0)).cast("long")
    whole = gaps.groupBy(*keys).agg(F.avg("__gap").alias("mae"), F.max("__gap").alias("most"), flips.alias("flips"))
    places = percentiles(gaps, keys, "__gap", {"median": 0.5, "p99": 0.99})
    return _beside(whole, places, keys).select(*keys, "mae", "most", "median", "p99", "flips")


def quantiles(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Least, tenth, quarter, half, three quarters, nine tenths and most, linear between rows."""
    ends = df.groupBy(*keys).agg(F.min(column).alias("least"), F.max(column).alias("most"))
    places = percentiles(df, keys, column, {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9})
    return _beside(ends, places, keys).select(*keys, "least", "q10", "q25", "median", "q75", "q90", "most")


def mcnemar(df: DataFrame, keys: list[str], one: str, two: str, label: str = "y", threshold: float = 0.5) -> DataFrame:
    """Discordant counts of two classifiers and the statistic with and without continuity correction."""
    right = lambda c: (F.col(c) >= threshold) == (F.col(label) == 1)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    n = df.groupBy(*keys).agg(count(right(one) & ~right(two)).alias("only_one"), count(~right(one) & right(two)).alias("only_two"))
    gap, total = F.abs(F.col("only_one") - F.col("only_two")), F.col("only_one") + F.col("only_two")
    return n.withColumns({"chi2": safe_ratio(gap * gap, total), "chi2_corrected": safe_ratio(F.pow(F.greatest(gap - 1, F.lit(0.0)), 2), total)})


def degree_concentration(degrees: DataFrame, share: float = 0.01) -> DataFrame:
    """Rows at the top ``share`` of entities by degree, entities with one label only, and how positive and negative degrees go together.

    The cut-off degree comes from running counts of degrees, so no task sorts
    the top entities; entities at the cut-off count as far as the share goes.
    """
    sizes = degrees.withColumn("d", F.col("pos") + F.col("neg"))
    counts = running_sums(sizes.groupBy("d").agg(F.count("*").alias("n")), [], "d", ["n"], descending=True)
    wanted = F.greatest(F.lit(1), F.ceil(F.col("all_n") * int(share * 10_000) / 10_000))
    head = counts.agg(F.sum(F.col("d") * F.greatest(F.lit(0), F.least("n", wanted - (F.col("cum_n") - F.col("n"))))).cast("long").alias("top_rows"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    rest = sizes.agg(F.count("*").alias("entities"), F.sum("d").cast("long").alias("rows"), count((F.col("pos") > 0) & (F.col("neg") == 0)).alias("positive_only"), count((F.col("pos") == 0) & (F.col("neg") > 0)).alias("negative_only"))
    return rest.crossJoin(head).crossJoin(spearman(sizes, [], "pos", "neg").withColumnRenamed("spearman", "degree_spearman"))  # single rows


def anchor_rows(df: DataFrame, keep: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Each row once for each of its ends, as ``anchor``."""
    return df.select(F.explode(F.array_distinct(F.array(a, b))).alias("anchor"), *keep)


def macro_ap(df: DataFrame, keys: list[str], least_rows: int = 10, score: str = "score", label: str = "y") -> DataFrame:
    """Mean over anchors of AP and AUROC, of anchors with enough rows and both labels."""
    per = ap_auroc(anchor_rows(df, [*keys, score, label]), [*keys, "anchor"], score, label, many=True)
    kept = per.filter((F.col("p") + F.col("n") >= least_rows) & F.col("ap").isNotNull())
    return kept.groupBy(*keys).agg(F.count("*").alias("anchors"), F.avg("ap").alias("macro_ap"), F.avg("auroc").alias("macro_auroc"))


def anchor_concordance(df: DataFrame, keys: list[str], least_each: int = 2, score: str = "score", label: str = "y") -> DataFrame:
    """Chance that an anchor's positive outranks its negative (ties half), mean over anchors."""
    per = ap_auroc(anchor_rows(df, [*keys, score, label]), [*keys, "anchor"], score, label, many=True)
    kept = per.filter((F.col("p") >= least_each) & (F.col("n") >= least_each))
    return kept.groupBy(*keys).agg(F.count("*").alias("anchors"), F.avg("auroc").alias("concordance"))


def balanced_ap(df: DataFrame, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """AP with each class weighing one half; rows with a null key are left out.

    Both classes' sizes come with the curve, so rows meet by score and never by
    key alone.
    """
    points = curve(df.dropna(subset=keys) if keys else df, keys, score, label)
    recall, fallout = safe_ratio(F.col("cum_tp"), F.col("all_p")), safe_ratio(F.col("cum_fp"), F.col("all_n"))
    area = F.sum(F.col("tp") * safe_ratio(recall, recall + fallout))
    ok = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    return points.groupBy(*keys).agg(F.when(ok, area / F.max("all_p")).alias("balanced_ap"))


def early_retrieval(df: DataFrame, keys: list[str], k: int, score: str = "score", label: str = "y") -> DataFrame:
    """Expected recall and NDCG at ``k`` when ties fall in random order, per key."""
    groups = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(label).cast("double").alias("p"), F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("start", F.coalesce(F.sum("n").over(run), F.lit(0)))
    inside = F.greatest(F.least(F.col("start") + F.col("n"), F.lit(k)) - F.col("start"), F.lit(0))
    discount = lambda low, high: F.aggregate(F.sequence(low + 1, high), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    end = F.least(F.col("start") + F.col("n"), F.lit(k).cast("long"))
    gain = F.when(inside > 0, F.col("p") / F.col("n") * discount(F.col("start"), end)).otherwise(0.0)
    sums = placed.groupBy(*keys).agg(F.sum(F.col("p") / F.col("n") * inside).alias("found"), F.sum(gain).alias("dcg"), F.sum("p").alias("all_p"))
    best = F.least(F.col("all_p"), F.lit(float(k))).cast("long")
    ideal = F.when(best > 0, discount(F.lit(0).cast("long"), best)).otherwise(0.0)
    return sums.select(*keys, "all_p", safe_ratio(F.col("found"), F.col("all_p")).alias("recall_at_k"), safe_ratio(F.col("dcg"), ideal).alias("ndcg_at_k"))


def top_k_overlap(df: DataFrame, one: str, two: str, k: int, row: str = "row_id", label: str = "y") -> DataFrame:
    """The ``k`` best rows of two scores (ties by row): positives in each, in both, in either alone."""
    pick = lambda c: df.select(row, label, c).orderBy(F.desc(c), row).limit(k)  # noqa: E731  the top-k report
    a, b = pick(one).select(row, F.col(label).alias("y1")), pick(two).select(row, F.col(label).alias("y2"))
    joined = a.join(b, row, "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    both = F.col("y1").isNotNull() & F.col("y2").isNotNull()
    return joined.agg(count(both).alias("shared"), count(F.col("y1") == 1).alias("positives_one"), count(F.col("y2") == 1).alias("positives_two"), count((F.col("y1") == 1) & F.col("y2").isNull()).alias("only_one"), count((F.col("y2") == 1) & F.col("y1").isNull()).alias("only_two"))


def train_quantile_bins(df: DataFrame, column: str, train: Column, name: str = "bin") -> DataFrame:
    """Bin by the quartiles of the training rows (three numbers, one row)."""
    cuts = percentiles(df.filter(train), [], column, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).select(F.array("q1", "q2", "q3").alias("__cuts"))
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, F.size(F.filter(F.array_distinct("__cuts"), lambda c: c < F.col(column)))).drop("__cuts")


def strata_metrics(df: DataFrame, strata: dict[str, Column], keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Metrics of each named stratum; a row counts in all strata that it is in."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in strata.items()]))
    rows = df.withColumn("stratum", F.explode(names))
    return ap_auroc(rows, ["stratum", *keys], score, label)


def coverage_by_class(df: DataFrame, flags: dict[str, Column], label: str = "y") -> DataFrame:
    """Of each label, rows and rows where each flag holds."""
    return df.groupBy(label).agg(F.count("*").alias("rows"), *[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in flags.items()])


def macro_over_sets(df: DataFrame, model: str = "model", metric: str = "ap") -> DataFrame:
    """Unweighted mean over test sets and how often each model is the best (ties count for each)."""
    best = F.max(metric).over(Window.partitionBy("test"))
    marked = df.withColumn("__win", (F.col(metric) == best).cast("int"))
    return marked.groupBy(model).agg(F.count("*").alias("sets"), F.avg(metric).alias("mean"), F.sum("__win").cast("long").alias("wins"))


def best_checkpoint(df: DataFrame, run: str, update: str, metric: str) -> DataFrame:
    """The greatest metric of each run, the earliest update on ties; whether it is the last; the last gain."""
    order = Window.partitionBy(run).orderBy(update)
    gains = df.withColumn("__gain", F.col(metric) - F.lag(metric).over(order))
    agg = gains.groupBy(run).agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col(update)).alias("u"))).alias("best"), F.max(update).alias("last_update"), F.max_by("__gain", update).alias("last_gain"))
    return agg.select(run, (-F.col("best.u")).alias("best_update"), F.col("best.m").alias("best_value"), (-F.col("best.u") == F.col("last_update")).alias("at_horizon"), "last_gain")


def log_windows(df: DataFrame, run: str, update: str, value: str, width: int) -> DataFrame:
    """Per run and range of updates the rows, mean, most and share above one."""
    return df.groupBy(run, F.floor(F.col(update) / width).alias("window")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.avg(F.when(F.col(value) > 1, 1.0).otherwise(0.0)).alias("above_one"))


def trailing_windows(df: DataFrame, run: str, update: str, value: str, width: int) -> DataFrame:
    """At each update of a run the mean, most and share above one of its last ``width`` updates, and the rows there are."""
    last = Window.partitionBy(run).orderBy(update).rangeBetween(-(width - 1), 0)
    over = F.avg(F.when(F.col(value) > 1, 1.0).otherwise(0.0)).over(last)
    return df.select(run, update, F.count("*").over(last).alias("rows"), F.avg(value).over(last).alias("mean"), F.max(value).over(last).alias("most"), over.alias("above_one"))
