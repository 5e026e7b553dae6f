"""Queries on alignments and matrices.

The alignments are the embeddings: a label is an alignment, a vector a row, a
dimension a column, its value in twenty steps a token and near zero a gap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.operators import align as A
from edgewise.operators import similar as R

from . import fixtures as X
from .metric_queries import rounded
from .registry import query

_CELLS = """WITH raw AS (SELECT label AS uid, vec_id AS row, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS col FROM embeddings),
cells AS (SELECT uid, row, CAST(col AS INTEGER) AS col, CAST(CASE WHEN abs(v) < 0.03 THEN 25 ELSE least(19, greatest(0, floor((v + 0.5) * 20))) END AS INTEGER) AS token, v FROM raw)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    vectors = X.table(spark, d, "embeddings").select(F.col("label").alias("uid"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("v"))
    token = lambda x: F.when(F.abs(x) < 0.03, A.GAP).otherwise(F.least(F.lit(19), F.greatest(F.lit(0), F.floor((x + 0.5) * 20)))).cast("int")
    return vectors.select("uid", "row", F.transform("v", token).alias("tokens"), "v")


def cells(spark: SparkSession, d: str) -> DataFrame:
    return A.to_cells(rows(spark, d))


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """Values of the vectors of a label, by a label's vector order, mapped to [0, 1]."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("uid").orderBy("row")) - 1
    flat = rows(spark, d).withColumn("i", order).select("uid", "i", F.posexplode("v").alias("j", "x"))
    return flat.select("uid", "i", "j", F.round(1 / (1 + F.exp(-F.col("x") * 8)), 6).alias("p"))


_MATRIX = _CELLS + ", mat AS (SELECT uid, dense_rank() OVER (PARTITION BY uid ORDER BY row) - 1 AS i, col AS j, round(1 / (1 + exp(-v * 8)), 6) AS p FROM cells)"
_COLUMNS = _CELLS + """, n AS (SELECT uid, col, token, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT uid, col, sum(n) AS depth, sum(n) FILTER (token < 25) AS letters FROM n GROUP BY ALL),
e AS (SELECT uid, col, -sum(n / letters * ln(n / letters)) AS entropy FROM n JOIN s USING (uid, col) WHERE token < 25 GROUP BY ALL),
c AS (SELECT uid, col, CAST(depth AS BIGINT) AS depth, 1 - coalesce(letters, 0) / depth AS gap_share, coalesce(entropy, 0) AS entropy FROM s LEFT JOIN e USING (uid, col))"""


@query("g21_column_profile", _COLUMNS + " SELECT uid, col, depth, round(gap_share, 6) AS gap_share, round(entropy, 6) + 0.0 AS entropy FROM c")
def g21(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.column_profile(cells(spark, d)), "gap_share", "entropy")


@query("g21_query_profile", _COLUMNS + """ SELECT uid, round(avg(gap_share), 6) AS gap_share, round(avg(entropy), 6) AS entropy, round(quantile_cont(entropy, 0.25), 6) AS q25, round(quantile_cont(entropy, 0.5), 6) AS median,
 round(quantile_cont(entropy, 0.75), 6) AS q75, round(ln(count(*)), 6) AS log_length, round(ln(max(depth)), 6) AS log_depth FROM c GROUP BY uid""")
def g21_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.query_profile(cells(spark, d)), "gap_share", "entropy", "q25", "median", "q75", "log_length", "log_depth")


@query("g22_block_profile", _COLUMNS + " SELECT uid, CAST(CASE WHEN col < 44 THEN col // 11 ELSE 4 + (col - 44) // 10 END AS INTEGER) AS block, count(*) AS columns, round(avg(gap_share), 6) AS gap_share, round(avg(entropy), 6) AS entropy FROM c GROUP BY ALL")
def g22(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.block_profile(cells(spark, d), 64, 6), "gap_share", "entropy")


_PROFILE = _COLUMNS + """, prof AS (SELECT uid, 0 AS k, ln(1 + count(*)) AS value FROM c GROUP BY uid UNION ALL SELECT uid, 1, ln(1 + max(depth)) FROM c GROUP BY uid UNION ALL SELECT uid, 2, avg(CASE WHEN col % 5 <> 0 THEN 1.0 ELSE 0 END) FROM c GROUP BY uid
UNION ALL SELECT uid, 3, avg(gap_share) FROM c GROUP BY uid UNION ALL SELECT uid, 4, avg(entropy) FROM c WHERE col % 5 <> 0 GROUP BY uid UNION ALL SELECT uid, 5, quantile_cont(entropy, 0.25) FROM c WHERE col % 5 <> 0 GROUP BY uid
UNION ALL SELECT uid, 6, quantile_cont(entropy, 0.75) FROM c WHERE col % 5 <> 0 GROUP BY uid
UNION ALL SELECT uid, 7 + t, coalesce(sum(n / letters) / 64.0, 0) FROM (SELECT DISTINCT uid FROM c) CROSS JOIN (SELECT unnest(range(0, 25)) AS t) LEFT JOIN (SELECT uid, token AS t, n, letters FROM n JOIN s USING (uid, col) WHERE token < 25) USING (uid, t) GROUP BY uid, t)"""


@query("g21_alignment_profile", _PROFILE + " SELECT uid, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM prof")
def g21_profile(spark: SparkSession, d: str) -> DataFrame:
    """All 32 numbers of each alignment, a row a number."""
    found = A.alignment_profile(cells(spark, d), F.col("col") % 5 != 0)
    return rounded(found.select("uid", F.posexplode("profile").alias("k", "value")), "value")


@query("g21_pair_features", _PROFILE + """, two AS (SELECT x.uid AS a, z.uid AS b, x.k, x.value AS u, z.value AS v FROM prof x JOIN prof z ON z.uid = x.uid + 1 AND z.k = x.k),
f AS (SELECT a, b, k, (u + v) / 2 AS value FROM two UNION ALL SELECT a, b, 32 + k, abs(u - v) FROM two UNION ALL SELECT DISTINCT a, b, 64, ln(1 + a + b) FROM two UNION ALL SELECT DISTINCT a, b, 65, ln(1 + 2.0 * b) FROM two
UNION ALL SELECT a, b, 66, (u + v) / 2 FROM two WHERE k = 2 UNION ALL SELECT a, b, 67, abs(u - v) FROM two WHERE k = 2) SELECT a, b, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM f""")
def g21_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All 68 numbers of each pair of neighbouring alignments, a row a number."""
    found = A.alignment_profile(cells(spark, d), F.col("col") % 5 != 0)
    left, right = found.select(F.col("uid").alias("a"), F.col("profile").alias("u")), found.select(F.col("uid").alias("b"), F.col("profile").alias("v"))
    pairs = left.join(right, F.col("b") == F.col("a") + 1).withColumns({"common": (F.col("a") + F.col("b")).cast("double"), "neff": 2.0 * F.col("b"), "qa": F.col("u")[2], "qb": F.col("v")[2]})
    features = A.pair_profile(pairs, "u", "v", "common", "neff", "qa", "qb")
    return rounded(features.select("a", "b", F.posexplode("features").alias("k", "value")), "value")


_FACING = _CELLS + """, q AS (SELECT uid, min(row) AS first FROM cells GROUP BY uid), qt AS (SELECT uid, col, token AS own FROM cells JOIN q USING (uid) WHERE row = first), h AS (SELECT uid, row, col, token FROM cells JOIN q USING (uid) WHERE row <> first)"""


@query("g22_wide_block_profile", _FACING + """, n AS (SELECT uid, col, token, count(*) AS n FROM h GROUP BY ALL),
s AS (SELECT uid, col, sum(n) AS depth, coalesce(sum(n) FILTER (token < 25), 0) AS letters, coalesce(sum(n) FILTER (token = own), 0) AS agree, coalesce(sum(n) FILTER (token >= 20 AND token < 25), 0) AS unsure FROM n JOIN qt USING (uid, col) GROUP BY ALL),
e AS (SELECT uid, col, -sum(n / letters * ln(n / letters)) AS entropy FROM n JOIN s USING (uid, col) WHERE token < 25 GROUP BY ALL),
c AS (SELECT uid, col, col % 5 <> 0 AS good, depth, coalesce(entropy, 0) AS entropy, letters / depth AS occupied, agree / depth AS same, unsure / depth AS vague, unnest([-1, col // 16]) AS block FROM s LEFT JOIN e USING (uid, col)),
g AS (SELECT * FROM c WHERE good), m AS (SELECT uid, block, count(*) AS cols FROM g GROUP BY ALL),
f AS (SELECT uid, block, t AS k, coalesce(sum(n / depth), 0) / max(cols) AS value FROM m CROSS JOIN (SELECT unnest(range(0, 26)) AS t) LEFT JOIN (SELECT uid, block, token AS t, n.n, g.depth FROM n JOIN g USING (uid, col)) USING (uid, block, t) GROUP BY ALL
UNION ALL SELECT uid, block, unnest(range(26, 35)), unnest([avg(entropy), stddev_pop(entropy), quantile_cont(entropy, 0.25), quantile_cont(entropy, 0.75), avg(occupied), quantile_cont(occupied, 0.25), min(occupied), avg(same), avg(vague)]) FROM g GROUP BY uid, block
UNION ALL SELECT uid, block, 35, avg(CASE WHEN good THEN 1.0 ELSE 0 END) FROM c GROUP BY uid, block) SELECT uid, CAST(block AS INTEGER) AS block, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM f""")
def g22_wide(spark: SparkSession, d: str) -> DataFrame:
    """All 36 numbers of the whole and of four blocks of each alignment, a row a number."""
    query_cells, rest = facing(spark, d)
    found = A.wide_block_profile(rest, query_cells, F.col("col") % 5 != 0)
    return rounded(found.select("uid", "block", F.posexplode("values").alias("k", "value")), "value")


def facing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cells of each alignment's first row, its query, and of the others."""
    every = cells(spark, d)
    first = X.table(spark, d, "embeddings").groupBy(F.col("label").alias("uid")).agg(F.min("vec_id").alias("first"))
    told = every.join(first, "uid")
    return told.filter("row = first").select("uid", "col", "token"), told.filter("row <> first").select("uid", "row", "col", "token")


@query("g22_base_profile", _CELLS + """, f AS (SELECT * FROM cells WHERE token < 25), sz AS (SELECT uid, row, count(*) AS size FROM f GROUP BY ALL),
p AS (SELECT x.uid, x.row, z.row AS other, count(*) AS n, count(*) FILTER (x.token = z.token) AS same FROM f x JOIN f z ON x.uid = z.uid AND x.col = z.col GROUP BY ALL),
r AS (SELECT uid, row, count(*) FILTER (row = other OR (n >= 0.5 * size AND same >= 0.18 * n)) AS k, count(*) FILTER (n >= 0.5 * size) AS cmp FROM p JOIN sz USING (uid, row) GROUP BY ALL),
d AS (SELECT uid, count(*) AS depth, sum(1.0 / k) AS neff, sum(cmp) * 1.0 / (count(*) * count(*)) AS comparable FROM r GROUP BY uid),
t AS (SELECT uid, fam, count(*) AS m FROM (SELECT DISTINCT uid, row, CASE WHEN row % 7 <> 0 THEN row % 7 END AS fam FROM cells) GROUP BY ALL), u AS (SELECT uid, sum(m) FILTER (fam IS NOT NULL) AS known, sum(m) AS every FROM t GROUP BY uid),
v AS (SELECT uid, count(*) AS families, exp(-sum(m / known * ln(m / known))) AS effective FROM t JOIN u USING (uid) WHERE fam IS NOT NULL GROUP BY uid),
w AS (SELECT uid, unnest(range(0, 12)) AS k, unnest([ln(65), ln(1 + depth), ln(1 + least(depth, 40)), ln(1 + depth), ln(1 + least(depth, 40)), ln(1 + neff), comparable, ln(1 + families), ln(1 + effective), 1 - known / every, CAST(depth > 40 AS INTEGER), 0.8]) AS value FROM d JOIN u USING (uid) JOIN v USING (uid))
SELECT uid, CAST(k AS INTEGER) AS k, round(value, 6) + 0.0 AS value FROM w""")
def g22_base(spark: SparkSession, d: str) -> DataFrame:
    """The 12 numbers ahead of the blocks, from effective depths and taxa; a row's place modulo seven is its taxon."""
    every = rows(spark, d)
    taxa = A.family_diversity(every.select("uid", F.when(F.col("row") % 7 != 0, F.col("row") % 7).alias("fam")), "uid", "fam")
    depth = F.col("rows")
    told = R.effective_depth(every, 0.18, 0.5).join(taxa, "uid").withColumns({"length": F.lit(64), "cached": F.least(depth, F.lit(40)), "filtered": depth, "retained": F.least(depth, F.lit(40)), "capped": depth > 40, "quality": F.lit(0.8)})
    values = A.base_profile("length", "rows", "cached", "filtered", "retained", "neff", comparable="comparable", families="families", effective="effective", unknown="unknown", capped="capped", quality="quality")
    return rounded(told.select("uid", F.posexplode(values).alias("k", "value")), "value")


@query("g23_effective_depth", _CELLS + """, f AS (SELECT * FROM cells WHERE token < 25), sz AS (SELECT uid, row, count(*) AS size FROM f GROUP BY ALL),
p AS (SELECT x.uid, x.row, z.row AS other, count(*) AS n, count(*) FILTER (x.token = z.token) AS same FROM f x JOIN f z ON x.uid = z.uid AND x.col = z.col GROUP BY ALL),
r AS (SELECT uid, row, count(*) FILTER (row = other OR (n >= 0.5 * size AND same >= 0.18 * n)) AS k, count(*) FILTER (n >= 0.5 * size) AS cmp FROM p JOIN sz USING (uid, row) GROUP BY ALL)
SELECT uid, count(*) AS rows, round(sum(1.0 / k), 6) AS neff, round(sum(cmp) * 1.0 / (count(*) * count(*)), 6) AS comparable FROM r GROUP BY uid""")
def g23(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.effective_depth(rows(spark, d), 0.18, 0.5), "neff", "comparable")


@query("g24_joint_support", _CELLS + """, f AS (SELECT uid, row, col FROM cells WHERE token < 25), n AS (SELECT uid, count(DISTINCT row) AS n FROM cells GROUP BY uid),
p AS (SELECT x.uid, x.col, z.col AS other, count(*) AS joint FROM f x JOIN f z ON x.uid = z.uid AND x.row = z.row AND x.col < z.col GROUP BY ALL)
SELECT uid, round(sum(joint) / 2016.0, 4) AS mean_support, round(count(*) FILTER (joint >= 34) / 2016.0, 6) AS enough, round(count(*) FILTER (joint >= n / 2.0) / 2016.0, 6) AS half FROM p JOIN n USING (uid) GROUP BY uid""")
def g24(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(R.joint_support(rows(spark, d), 34), "enough", "half"), "mean_support", places=4)


@query("g25_family_diversity", """WITH n AS (SELECT lang AS g, CASE WHEN source <> 'src0' THEN source END AS f, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT g, sum(n) FILTER (f IS NOT NULL) AS known, sum(n) AS every FROM n GROUP BY g),
e AS (SELECT g, count(*) AS families, exp(-sum(n / known * ln(n / known))) AS effective FROM n JOIN s USING (g) WHERE f IS NOT NULL GROUP BY g)
SELECT g, families, round(effective, 6) AS effective, round(1 - known / every, 6) AS unknown FROM s JOIN e USING (g)""")
def g25(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents").select(F.col("lang").alias("g"), F.when(F.col("source") != "src0", F.col("source")).alias("f"))
    return rounded(A.family_diversity(docs, "g", "f"), "effective", "unknown")


@query("g26_covariance_energy", _CELLS + """, p AS (SELECT x.uid, x.col, x.token, z.token AS other FROM cells x JOIN cells z ON x.uid = z.uid AND x.row = z.row AND z.col = x.col + 1), j AS (SELECT uid, col, token, other, count(*) AS nxy FROM p GROUP BY ALL),
n AS (SELECT uid, col, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT uid, col, token, count(*) AS nx FROM p GROUP BY ALL), b AS (SELECT uid, col, other, count(*) AS ny FROM p GROUP BY ALL)
SELECT uid, col, round(sum(pow(coalesce(nxy, 0) / n - nx / n * (ny / n), 2)), 6) AS energy FROM a JOIN b USING (uid, col) LEFT JOIN j USING (uid, col, token, other) JOIN n USING (uid, col) GROUP BY ALL""")
def g26(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.covariance_energy(cells(spark, d)), "energy")


@query("g27_profile_variation", _CELLS + """, o AS (SELECT uid, col, token, count(*) AS n FROM cells WHERE row % 2 = 0 GROUP BY ALL), t AS (SELECT uid, col, token, count(*) AS n FROM cells WHERE row % 2 = 1 GROUP BY ALL),
p AS (SELECT uid, col, token, n / sum(n) OVER (PARTITION BY uid, col) AS p FROM o), q AS (SELECT uid, col, token, n / sum(n) OVER (PARTITION BY uid, col) AS q FROM t),
v AS (SELECT uid, col, sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS tv FROM p FULL JOIN q USING (uid, col, token) GROUP BY ALL) SELECT uid, round(avg(tv), 6) AS tv, round(max(tv), 6) AS most FROM v GROUP BY uid""")
def g27(spark: SparkSession, d: str) -> DataFrame:
    every = cells(spark, d)
    return rounded(A.profile_variation(every.filter("row % 2 = 0"), every.filter("row % 2 = 1")), "tv", "most")


@query("g27_variation_summary", _FACING + """, z AS (SELECT uid, row, col, CASE WHEN (row * 7 + col) % 3 = 0 THEN (token + 1) % 26 ELSE token END AS token FROM h),
o AS (SELECT uid, col, token, count(*) AS n FROM h GROUP BY ALL), t AS (SELECT uid, col, token, count(*) AS n FROM z GROUP BY ALL), p AS (SELECT uid, col, token, n / sum(n) OVER (PARTITION BY uid, col) AS p FROM o), r AS (SELECT uid, col, token, n / sum(n) OVER (PARTITION BY uid, col) AS r FROM t),
v AS (SELECT uid, col, sum(abs(coalesce(p, 0) - coalesce(r, 0))) / 2 AS tv FROM p FULL JOIN r USING (uid, col, token) GROUP BY ALL), a AS (SELECT uid, avg(tv) AS tv, max(tv) AS most FROM v GROUP BY uid),
b AS (SELECT uid, avg(CASE WHEN h.token <> z.token THEN 1.0 ELSE 0 END) AS changed FROM h JOIN z USING (uid, row, col) GROUP BY uid),
x AS (SELECT uid, row, avg(CASE WHEN token = own THEN 1.0 ELSE 0 END) AS same, avg(CASE WHEN token = 25 THEN 1.0 ELSE 0 END) AS gap FROM h JOIN qt USING (uid, col) GROUP BY ALL), y AS (SELECT uid, row, avg(CASE WHEN token = own THEN 1.0 ELSE 0 END) AS same, avg(CASE WHEN token = 25 THEN 1.0 ELSE 0 END) AS gap FROM z JOIN qt USING (uid, col) GROUP BY ALL),
i AS (SELECT uid, avg(same) AS bsm, stddev_pop(same) AS bss, avg(gap) AS bgm, stddev_pop(gap) AS bgs FROM x GROUP BY uid), j AS (SELECT uid, avg(same) AS asm, stddev_pop(same) AS ass, avg(gap) AS agm, stddev_pop(gap) AS ags FROM y GROUP BY uid)
SELECT uid, round(tv, 6) AS tv, round(most, 6) AS most, round(changed, 6) AS changed, round(bsm, 6) AS before_same_mean, round(bss, 6) AS before_same_std, round(bgm, 6) AS before_gap_mean, round(bgs, 6) AS before_gap_std,
 round(asm, 6) AS after_same_mean, round(ass, 6) AS after_same_std, round(agm, 6) AS after_gap_mean, round(ags, 6) AS after_gap_std FROM a JOIN b USING (uid) JOIN i USING (uid) JOIN j USING (uid)""")
def g27_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every third cell takes the next token."""
    query_cells, rest = facing(spark, d)
    moved = rest.withColumn("token", F.when((F.col("row") * 7 + F.col("col")) % 3 == 0, (F.col("token") + 1) % 26).otherwise(F.col("token")).cast("int"))
    found = A.variation_summary(rest, moved, query_cells)
    return rounded(found, *[c for c in found.columns if c != "uid"])


_ROUNDED_MEAN = "round(avg(p), 5)"


@query("g28_matrix_summary", _MATRIX + """, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p DESC, i, j) AS k FROM mat), s AS (SELECT uid, i, sum(p) AS s FROM mat GROUP BY ALL), q AS (SELECT uid, s / sum(s) OVER (PARTITION BY uid) AS q FROM s),
e AS (SELECT uid, -sum(q * ln(q)) / ln(count(*)) AS row_entropy FROM q GROUP BY uid), sj AS (SELECT uid, j, sum(p) AS s FROM mat GROUP BY ALL), qj AS (SELECT uid, s / sum(s) OVER (PARTITION BY uid) AS q FROM sj), ej AS (SELECT uid, -sum(q * ln(q)) / ln(count(*)) AS col_entropy FROM qj GROUP BY uid)
SELECT uid, round(max(col_entropy), 5) AS col_entropy, round(avg(p) FILTER (k <= 20), 5) AS top_mean, round(avg(CASE WHEN p >= 0.9 THEN 1.0 ELSE 0 END), 5) AS share, round(count(DISTINCT i) FILTER (p >= 0.9) * 1.0 / count(DISTINCT i), 5) AS row_part,
 round(count(DISTINCT j) FILTER (p >= 0.9) * 1.0 / count(DISTINCT j), 5) AS col_part, round(max(row_entropy), 5) AS row_entropy FROM r JOIN e USING (uid) JOIN ej USING (uid) GROUP BY uid""")
def g28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.matrix_summary(matrix(spark, d), 20, 0.9), "top_mean", "share", "row_part", "col_part", "row_entropy", "col_entropy", places=5)


@query("g29_window_peak", _MATRIX + """, s AS (SELECT *, sum(p) OVER w AS s, count(*) OVER w AS n FROM mat WINDOW w AS (PARTITION BY uid, i ORDER BY j ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
t AS (SELECT uid, sum(s) OVER w AS t, count(*) OVER w AS m FROM s WHERE n = 5 WINDOW w AS (PARTITION BY uid, j ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT uid, round(max(t) / 25, 6) AS peak FROM t WHERE m = 5 GROUP BY uid""")
def g29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.window_peak(matrix(spark, d), 5), "peak")


_BLOCK = "CASE WHEN {x} < (L{x} % n{x}) * (L{x} // n{x} + 1) THEN {x} // (L{x} // n{x} + 1) ELSE L{x} % n{x} + ({x} - (L{x} % n{x}) * (L{x} // n{x} + 1)) // (L{x} // n{x}) END"


@query("g30_block_pooling", _MATRIX + f""", z AS (SELECT uid, max(i) + 1 AS Li, max(j) + 1 AS Lj, CAST(ceil((max(i) + 1) / 7.0) AS BIGINT) AS ni, CAST(ceil((max(j) + 1) / 7.0) AS BIGINT) AS nj FROM mat GROUP BY uid),
b AS (SELECT uid, i, j, p, i % 4 <> 0 AND i % 5 <> 1 AS gi, j % 3 <> 0 AS gj, {_BLOCK.format(x="i")} AS ti, {_BLOCK.format(x="j")} AS tj FROM mat JOIN z USING (uid)),
t AS (SELECT uid, ti, tj, avg(p) FILTER (gi AND gj) AS m, count(DISTINCT i) FILTER (gi) >= 0.6 * count(DISTINCT i) AND count(DISTINCT j) FILTER (gj) >= 0.6 * count(DISTINCT j) AS ok FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY m DESC, ti, tj) AS u, row_number() OVER (PARTITION BY uid ORDER BY m, ti, tj) AS d FROM t WHERE ok AND m IS NOT NULL),
g AS (SELECT uid, count(*) AS tiles, avg(m) FILTER (u <= 3) AS top, avg(m) FILTER (d <= 3) AS bottom FROM r GROUP BY uid), w AS (SELECT uid, avg(p) AS mean, stddev_pop(p) AS std, quantile_cont(p, 0.95) AS q95, max(p) AS most FROM b WHERE gi AND gj GROUP BY uid)
SELECT uid, tiles, round(top, 5) AS top, round(bottom, 5) AS bottom, round(mean, 5) AS mean, round(std, 5) AS std, round(q95, 5) AS q95, round(most, 5) AS most FROM g JOIN w USING (uid)""")
def g30(spark: SparkSession, d: str) -> DataFrame:
    marked = matrix(spark, d).withColumns({"good_i": (F.col("i") % 4 != 0) & (F.col("i") % 5 != 1), "good_j": F.col("j") % 3 != 0})
    return rounded(A.block_pool(marked, 7, 3, 0.6), "top", "bottom", "mean", "std", "q95", "most", places=5)


@query("p13_quality_mask", _CELLS + " SELECT uid, row, count(*) FILTER (col % 3 = 0) AS masked, CAST(sum(CASE WHEN col % 3 = 0 THEN 26 ELSE token END) AS BIGINT) AS total FROM cells GROUP BY ALL")
def p13(spark: SparkSession, d: str) -> DataFrame:
    good = F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: i % 3 != 0)
    masked = A.mask_columns(rows(spark, d), good)
    count = F.size(F.filter("tokens", lambda t: t == A.PAD)).cast("long")
    return masked.select("uid", "row", count.alias("masked"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_PAIRED = """WITH r AS (SELECT conv_id AS key, turn, role AS tax, text FROM conversations), x AS (SELECT key, turn AS a, CASE WHEN turn % 4 < 2 THEN 'even' ELSE 'odd' END AS tax, replace(text, ' ', '-') AS seq FROM r WHERE tax = 'user'),
z AS (SELECT key, turn AS b, CASE WHEN turn % 3 < 2 THEN 'even' ELSE 'odd' END AS tax, replace(text, ' ', '-') AS seq FROM r WHERE tax <> 'user'),
p AS (SELECT key, a, b, CASE WHEN x.tax <> z.tax THEN 'taxonomy' WHEN replace(x.seq, '-', '') = replace(z.seq, '-', '') THEN 'identical' WHEN least(length(replace(x.seq, '-', '')) / length(x.seq), length(replace(z.seq, '-', '')) / length(z.seq)) < 0.83 THEN 'coverage' ELSE 'paired' END AS outcome
FROM x JOIN z USING (key))"""


def paired(spark: SparkSession, d: str) -> DataFrame:
    talks = X.table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("row"), "role", F.replace("text", F.lit(" "), F.lit("-")).alias("seq"))
    left = talks.filter("role = 'user'").withColumn("tax", F.when(F.col("row") % 4 < 2, "even").otherwise("odd"))
    right = talks.filter("role <> 'user'").withColumn("tax", F.when(F.col("row") % 3 < 2, "even").otherwise("odd"))
    return A.pair_rows(left, right, 0.83)


@query("j13_alignment_pairing", _PAIRED + " SELECT outcome, count(*) AS rows FROM p GROUP BY outcome")
def j13(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).groupBy("outcome").agg(F.count("*").alias("rows"))


@query("j13_paired_rows", _PAIRED + " SELECT key, a AS row_a, b AS row_b FROM p WHERE outcome = 'paired'")
def j13_rows(spark: SparkSession, d: str) -> DataFrame:
    return paired(spark, d).filter("outcome = 'paired'").select("key", "row_a", "row_b")


@query("n5_hierarchical_rotation", """WITH r AS (SELECT label AS uid, vec_id AS row, vec_id // 3 AS fam, vec_id // 40 AS ord, ('0x' || substr(sha256('rot:' || vec_id), 1, 15))::BIGINT AS h FROM embeddings),
w AS (SELECT *, count(*) OVER (PARTITION BY uid, fam) AS nf, count(*) OVER (PARTITION BY uid, ord) AS no, coalesce(lead(row) OVER (PARTITION BY uid, fam ORDER BY h, row), first_value(row) OVER (PARTITION BY uid, fam ORDER BY h, row)) AS xf,
coalesce(lead(row) OVER (PARTITION BY uid, ord ORDER BY h, row), first_value(row) OVER (PARTITION BY uid, ord ORDER BY h, row)) AS xo FROM r)
SELECT uid, row, CASE WHEN nf > 1 THEN xf WHEN no > 1 THEN xo ELSE row END AS rotated, CASE WHEN nf > 1 THEN 'fam' WHEN no > 1 THEN 'ord' ELSE 'none' END AS level FROM w""")
def n5(spark: SparkSession, d: str) -> DataFrame:
    named = rows(spark, d).select("uid", "row", F.floor(F.col("row") / 3).alias("fam"), F.floor(F.col("row") / 40).alias("ord"))
    return A.rotate_within(named, ["fam", "ord"], "row", "rot").select("uid", "row", "rotated", "level")


@query("n6_column_shuffle", _CELLS + """, k AS (SELECT uid, col, row, token, row_number() OVER (PARTITION BY uid, col ORDER BY row) AS a, row_number() OVER (PARTITION BY uid, col ORDER BY ('0x' || substr(sha256('mix:' || uid || ':' || col || ':' || row), 1, 15))::BIGINT, row) AS b FROM cells)
SELECT x.uid, x.row, x.col, z.token FROM k x JOIN k z ON x.uid = z.uid AND x.col = z.col AND x.a = z.b""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return A.shuffle_columns(cells(spark, d), "mix")


@query("n7_matched_samples", """WITH r AS (SELECT label % 5 AS uid, label < 5 AS l, vec_id AS row FROM embeddings), x AS (SELECT uid, row AS row_a, row_number() OVER (PARTITION BY uid ORDER BY ('0x' || substr(sha256('sa:' || row), 1, 15))::BIGINT, row) AS place FROM r WHERE l),
z AS (SELECT uid, row AS row_b, row_number() OVER (PARTITION BY uid ORDER BY ('0x' || substr(sha256('sb:' || row), 1, 15))::BIGINT, row) AS place FROM r WHERE NOT l) SELECT * FROM x JOIN z USING (uid, place)""")
def n7(spark: SparkSession, d: str) -> DataFrame:
    named = rows(spark, d).select((F.col("uid") % 5).alias("uid"), "row", (F.col("uid") < 5).alias("l"))
    return A.matched_samples(named.filter("l"), named.filter("NOT l"), "s").withColumn("place", F.col("place").cast("long"))


@query("n8_nested_depths", """WITH r AS (SELECT label AS uid, vec_id AS row, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(sha256('deep:' || vec_id), 1, 15))::BIGINT, vec_id) AS place FROM embeddings) SELECT uid, row, place, place <= 8 AS in_small FROM r WHERE place <= 32""")
def n8(spark: SparkSession, d: str) -> DataFrame:
    return A.nested_depths(rows(spark, d).select("uid", "row"), 8, 32, "deep").withColumn("place", F.col("place").cast("long"))


_THINNED = """, t AS (SELECT uid, row, list(token ORDER BY col) AS k, row_number() OVER (PARTITION BY uid ORDER BY row) AS n FROM cells GROUP BY uid, row),
f AS (SELECT uid, row, col, token FROM cells WHERE token < 25), z AS (SELECT uid, row, count(*) AS letters FROM f GROUP BY ALL), j AS (SELECT x.uid, x.row AS early, y.row AS late, count(*) AS n, count(*) FILTER (x.token = y.token) AS same
  FROM f x JOIN f y ON x.uid = y.uid AND x.col = y.col AND x.row < y.row GROUP BY ALL),
e AS (SELECT j.uid, late, list(early) AS before FROM j JOIN z ON z.uid = j.uid AND z.row = late WHERE n >= 0.5 * letters AND same >= 0.2 * n GROUP BY ALL),
o AS (SELECT t.uid, t.n, t.row, coalesce(before, []) AS before FROM t LEFT JOIN e ON e.uid = t.uid AND e.late = t.row),
g(uid, n, kept) AS (SELECT DISTINCT uid, 0::BIGINT, []::BIGINT[] FROM t UNION ALL
  SELECT o.uid, o.n, CASE WHEN list_has_any(g.kept, o.before) THEN g.kept ELSE list_append(g.kept, o.row) END FROM g JOIN o ON o.uid = g.uid AND o.n = g.n + 1),
l AS (SELECT uid, arg_max(kept, n) AS kept FROM g GROUP BY uid)
SELECT uid, unnest(kept) AS row, CAST(unnest(range(0, len(kept))) AS INTEGER) AS place FROM l"""


@query("n9_redundancy_thinning", _CELLS.replace("WITH", "WITH RECURSIVE", 1) + _THINNED)
def n9(spark: SparkSession, d: str) -> DataFrame:
    """All rows of every alignment, in order of their numbers."""
    return R.thin_redundant(rows(spark, d).withColumn("order", F.col("row")), 0.2, 0.5)


@query("n10_position_scramble", _CELLS + """, f AS (SELECT * FROM cells WHERE token < 25), k AS (SELECT uid, row, col, token, row_number() OVER (PARTITION BY uid, row ORDER BY col) AS a,
row_number() OVER (PARTITION BY uid, row ORDER BY ('0x' || substr(sha256('scr:' || uid || ':' || row || ':' || col), 1, 15))::BIGINT, col) AS b FROM f) SELECT x.uid, x.row, x.col, z.token FROM k x JOIN k z ON x.uid = z.uid AND x.row = z.row AND x.a = z.b""")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return A.scramble_positions(cells(spark, d), "scr")


_SEEDS = _CELLS + """, t AS (SELECT row, list(token ORDER BY col) AS k FROM cells GROUP BY row), s AS (SELECT row, unnest(range(0, 60)) AS place, k FROM t),
d AS (SELECT row, place, 0 AS pattern, concat_ws('.', k[place + 1], k[place + 2], k[place + 4], k[place + 5]) AS seed FROM s UNION ALL SELECT row, place, 1, concat_ws('.', k[place + 1], k[place + 3], k[place + 4], k[place + 6]) FROM s WHERE place <= 58),
c AS (SELECT pattern, seed, count(DISTINCT row) AS n FROM d GROUP BY ALL), g AS (SELECT d.* FROM d JOIN c USING (pattern, seed) WHERE n > 1),
m AS (SELECT DISTINCT x.row AS p, z.row AS q, x.place AS p_at, z.place AS q_at FROM g x JOIN g z USING (pattern, seed) WHERE x.row < z.row)"""


_TWO = ["11011", "101101"]


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("row", "tokens")


@query("j19_seed_matches", _SEEDS + " SELECT p, q, p_at, q_at FROM m")
def j19(spark: SparkSession, d: str) -> DataFrame:
    return A.seed_matches(sequences(spark, d), _TWO).select("p", "q", F.col("p_at").cast("long").alias("p_at"), F.col("q_at").cast("long").alias("q_at"))


_SEGMENTS = _SEEDS + """, i AS (SELECT *, p_at - q_at AS diagonal, CASE WHEN p_at - lag(p_at) OVER w <= 6 THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY p, q, p_at - q_at ORDER BY p_at)),
l AS (SELECT *, sum(new) OVER (PARTITION BY p, q, diagonal ORDER BY p_at ROWS UNBOUNDED PRECEDING) AS island FROM i), seg AS (SELECT p, q, diagonal, min(p_at) AS p_start, max(p_at) + 6 AS p_end, count(*) AS seeds FROM l GROUP BY p, q, diagonal, island)"""


@query("w8_diagonal_segments", _SEGMENTS + " SELECT p, q, diagonal, p_start, p_end, seeds FROM seg")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return A.diagonal_segments(sequences(spark, d), _TWO, 6).select("p", "q", *[F.col(c).cast("long").alias(c) for c in ("diagonal", "p_start", "p_end", "seeds")])


@query("g34_trimmed_segments", _SEGMENTS + """, cov AS (SELECT p, q, diagonal, p_start, unnest(range(p_start, p_end)) AS pos FROM seg), few AS (SELECT p, pos FROM cov GROUP BY ALL HAVING count(*) <= 3),
runs AS (SELECT cov.*, pos - row_number() OVER (PARTITION BY p, q, diagonal, p_start ORDER BY pos) AS run FROM cov JOIN few USING (p, pos)) SELECT DISTINCT p, q, diagonal, min(pos) AS "start", max(pos) + 1 AS "end" FROM runs GROUP BY p, q, diagonal, p_start, run""")
def g34(spark: SparkSession, d: str) -> DataFrame:
    trimmed = A.trimmed_segments(sequences(spark, d), _TWO, 6, 3)
    return trimmed.select("p", "q", *[F.col(c).cast("long").alias(c) for c in ("diagonal", "start", "end")])


_SCORED = """, dg AS (SELECT DISTINCT p, q, p_at - q_at AS diagonal FROM m), sd AS (SELECT DISTINCT p, q, p_at - q_at AS diagonal, p_at FROM m),
pos AS (SELECT p, q, diagonal, unnest(range(greatest(0, diagonal), least(64, 64 + diagonal))) AS i FROM dg),
sc AS (SELECT p, q, diagonal, i, CASE WHEN x.k[i + 1] = z.k[i - diagonal + 1] THEN 5 WHEN abs(x.k[i + 1] - z.k[i - diagonal + 1]) = 1 THEN 1 ELSE -2 END AS s FROM pos JOIN t x ON x.row = p JOIN t z ON z.row = q),
w AS (SELECT p, q, diagonal, i, sum(s) OVER v AS score, count(*) OVER v AS n FROM sc WINDOW v AS (PARTITION BY p, q, diagonal ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
hi AS (SELECT *, i - row_number() OVER (PARTITION BY p, q, diagonal ORDER BY i) AS run FROM w WHERE n = 8 AND score >= 18),
sg AS (SELECT hi.p, hi.q, hi.diagonal, min(i) AS p_start, max(i) + 8 AS p_end, max(score) AS best, max(CASE WHEN p_at IS NOT NULL THEN 1 ELSE 0 END) AS seeded FROM hi LEFT JOIN sd ON sd.p = hi.p AND sd.q = hi.q AND sd.diagonal = hi.diagonal AND sd.p_at = hi.i GROUP BY hi.p, hi.q, hi.diagonal, run)
SELECT p, q, diagonal, CAST(p_start AS BIGINT) AS p_start, CAST(p_end AS BIGINT) AS p_end, CAST(best AS BIGINT) AS best FROM sg WHERE seeded = 1"""


def scored(spark: SparkSession, d: str, patterns: list[str]) -> DataFrame:
    """Equal tokens score 5, neighbours 1, others -2; windows of 8 with 18 at least."""
    gap = lambda x, y: F.abs(x - y)
    score = lambda x, y: F.when(gap(x, y) == 0, 5).when(gap(x, y) == 1, 1).otherwise(-2)
    found = A.seeded_segments(sequences(spark, d), patterns, score, 8, 18)
    return found.select("p", "q", *[F.col(c).cast("long").alias(c) for c in ("diagonal", "p_start", "p_end", "best")])


@query("w8_scored_segments", _SEEDS + _SCORED)
def w8_scored(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d, _TWO)


#: The four spaced seeds.
_PATTERNS = ["110000110001", "100101000101", "110010001001", "101000000111"]
_PLACES = [", ".join(f"k[place + {i + 1}]" for i, x in enumerate(p) if x == "1") for p in _PATTERNS]
_ALL_SEEDS = _CELLS + """, t AS (SELECT row, list(token ORDER BY col) AS k FROM cells GROUP BY row), s AS (SELECT row, unnest(range(0, 53)) AS place, k FROM t), d AS (""" + " UNION ALL ".join(f"SELECT row, place, {n} AS pattern, concat_ws('.', {k}) AS seed FROM s" for n, k in enumerate(_PLACES)) + """),
m AS (SELECT DISTINCT x.row AS p, z.row AS q, x.place AS p_at, z.place AS q_at FROM d x JOIN d z USING (pattern, seed) WHERE x.row < z.row)"""
_ALL_SEGMENTS = _SEGMENTS.replace(_SEEDS, _ALL_SEEDS).replace("OVER w <= 6", "OVER w <= 12").replace("max(p_at) + 6", "max(p_at) + 12")


@query("j19_all_seed_matches", _ALL_SEEDS + " SELECT p, q, p_at, q_at FROM m")
def j19_all(spark: SparkSession, d: str) -> DataFrame:
    """All four patterns and every shared seed value."""
    return A.seed_matches(sequences(spark, d), _PATTERNS).select("p", "q", F.col("p_at").cast("long").alias("p_at"), F.col("q_at").cast("long").alias("q_at"))


@query("w8_all_diagonal_segments", _ALL_SEGMENTS + " SELECT p, q, diagonal, p_start, p_end, seeds FROM seg")
def w8_all(spark: SparkSession, d: str) -> DataFrame:
    return A.diagonal_segments(sequences(spark, d), _PATTERNS, 12).select("p", "q", *[F.col(c).cast("long").alias(c) for c in ("diagonal", "p_start", "p_end", "seeds")])


@query("w8_all_scored_segments", _ALL_SEEDS + _SCORED)
def w8_all_scored(spark: SparkSession, d: str) -> DataFrame:
    """All four patterns, and no list of their matches."""
    return scored(spark, d, _PATTERNS)


@query("g34_all_trimmed_segments", _ALL_SEGMENTS + """, cov AS (SELECT p, q, diagonal, p_start, unnest(range(p_start, p_end)) AS pos FROM seg), few AS (SELECT p, pos FROM cov GROUP BY ALL HAVING count(*) <= 3),
runs AS (SELECT cov.*, pos - row_number() OVER (PARTITION BY p, q, diagonal, p_start ORDER BY pos) AS run FROM cov JOIN few USING (p, pos)) SELECT DISTINCT p, q, diagonal, min(pos) AS "start", max(pos) + 1 AS "end" FROM runs GROUP BY p, q, diagonal, p_start, run""")
def g34_all(spark: SparkSession, d: str) -> DataFrame:
    trimmed = A.trimmed_segments(sequences(spark, d), _PATTERNS, 12, 3)
    return trimmed.select("p", "q", *[F.col(c).cast("long").alias(c) for c in ("diagonal", "start", "end")])


@query("j20_propagated_scores", X.ctes("blocs") + """, seg AS (SELECT DISTINCT x.a AS p, z.a AS q, abs(x.n_rows - z.n_rows) + 1.0 AS s FROM blocs x JOIN blocs z ON x.b = z.b AND x.n_rows = z.n_rows UNION SELECT DISTINCT b, b, 2.0 FROM blocs),
len AS (SELECT a AS entity, 10.0 + count(*) AS len FROM blocs GROUP BY a UNION ALL SELECT b, 5.0 + count(*) FROM blocs GROUP BY b), e AS (SELECT a AS p1, b AS p2 FROM blocs WHERE y = 1), m AS (SELECT * FROM e UNION ALL SELECT p2, p1 FROM e),
r AS (SELECT w.a AS x, w.b AS z, sum(s1.s * (l2.len - 4 + 1) + s2.s * (l1.len - 4 + 1)) AS raw FROM blocs w JOIN seg s1 ON s1.q = w.a JOIN m ON m.p1 = s1.p JOIN seg s2 ON s2.p = m.p2 AND s2.q = w.b JOIN len l1 ON l1.entity = m.p1 JOIN len l2 ON l2.entity = m.p2 GROUP BY ALL)
SELECT a AS x, b AS y, round(coalesce(raw, 0) / (lx.len * ly.len), 6) AS score FROM blocs LEFT JOIN r ON r.x = a AND r.z = b JOIN len lx ON lx.entity = a JOIN len ly ON ly.entity = b""")
def j20(spark: SparkSession, d: str) -> DataFrame:
    blocs = X.blocs(spark, d)
    one, two = blocs.select("b", F.col("a").alias("p"), F.col("n_rows").alias("n1")), blocs.select("b", F.col("a").alias("q"), F.col("n_rows").alias("n2"))
    near = one.join(two, "b").filter("n1 = n2").select("p", "q", (F.abs(F.col("n1") - F.col("n2")) + 1.0).alias("s"))
    segments = near.union(blocs.select(F.col("b").alias("p"), F.col("b").alias("q"), F.lit(2.0).alias("s"))).distinct()
    lengths = blocs.groupBy(F.col("a").alias("entity")).agg((F.count("*") + 10.0).alias("len")).union(blocs.groupBy("b").agg((F.count("*") + 5.0).alias("len")))
    edges = blocs.filter("y = 1").select(F.col("a").alias("p1"), F.col("b").alias("p2"))
    wanted = blocs.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return rounded(A.propagated_scores(wanted, edges, segments, lengths, 4), "score")
