"""Queries that build and audit a registry of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.expressions import jaccard
from edgewise.functions.shared import materialise
from edgewise.operators import features as E
from edgewise.operators import metrics as M
from edgewise.operators import pairs as P

from . import fixtures as X
from .metric_queries import rounded
from .registry import query


@query("g1_collapse_entities", X.ctes("entity") + """SELECT sha, array_to_string(list_sort(list(DISTINCT entity)), ',') AS members, array_to_string(list_sort(list(DISTINCT family)), ',') AS families,
len(list_distinct(flatten(list(annots)))) AS n_annotations FROM entity GROUP BY sha""")
def g1(spark: SparkSession, d: str) -> DataFrame:
    found = P.collapse_entities(X.entity(spark, d), "seq", "entity", "family", "annots")
    return found.select("sha", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"), F.concat_ws(",", "families").alias("families"), F.size("annotations").cast("long").alias("n_annotations"))


@query("j1_resolve_aliases", """WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT 'nobody'),
al AS (SELECT p_name AS alias, count(DISTINCT p_brand) AS n, min(p_brand) AS one FROM part GROUP BY p_name)
SELECT name, CASE WHEN name IN (SELECT p_brand FROM part) THEN 'primary' WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
       CASE WHEN name IN (SELECT p_brand FROM part) THEN name WHEN n = 1 THEN one END AS "primary" FROM names LEFT JOIN al ON name = alias""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    part = X.table(spark, d, "part")
    names = part.select(F.explode(F.array("p_name", "p_brand", "p_type")).alias("name")).union(spark.createDataFrame([("nobody",)], "name string")).distinct()
    return P.resolve_aliases(names, part.select(F.col("p_brand").alias("primary")), part.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("primary")))


@query("j3_exclude_protected", X.ctes("entity") + """, p AS (SELECT d.doc_id, sha256(text) AS sha, CASE WHEN toxic = 1 AND quality = 0 THEN source END AS family FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)
SELECT entity, entity IN (SELECT doc_id FROM p) AS by_id, sha IN (SELECT sha FROM p) AS by_sequence, coalesce(family IN (SELECT family FROM p WHERE family IS NOT NULL), false) AS by_family,
  entity IN (SELECT doc_id FROM p) OR sha IN (SELECT sha FROM p) OR coalesce(family IN (SELECT family FROM p WHERE family IS NOT NULL), false) AS excluded FROM entity""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    labels = X.table(spark, d, "labels").filter("toxic = 1")
    entities = X.entity(spark, d)
    protected = entities.join(labels, F.col("entity") == F.col("doc_id")).select("entity", "sha", F.when(F.col("quality") == 0, F.col("family")).alias("family"))
    return P.exclude_protected(entities.select("entity", "sha", "family"), protected).select("entity", "by_id", "by_sequence", "by_family", "excluded")


@query("j6_family_blacklist", """WITH pr AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_type AS f1, p_brand AS f2, 'N' || s_nationkey AS g FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
known AS (SELECT DISTINCT unnest([p_type, p_brand]) AS fa, 'N' || s_nationkey AS fb FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08)
SELECT g, count(*) FILTER ((f1, g) IN (SELECT (fa, fb) FROM known) OR (f2, g) IN (SELECT (fa, fb) FROM known)) AS blocked, count(*) AS rows FROM pr GROUP BY g""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, part = (X.table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    row = ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    g = F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))
    rows = rows.select(row.alias("row_id"), F.array("p_type", "p_brand").alias("a_families"), F.array(g).alias("b_families"), g.alias("g"), "l_quantity", "l_discount", "l_tax")
    known = rows.filter("l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08").select(F.explode("a_families").alias("fa"), "g").select(F.least("fa", "g").alias("lo"), F.greatest("fa", "g").alias("hi"))
    return P.family_blacklist(rows, known).groupBy("g").agg(F.sum(F.col("blocked").cast("long")).alias("blocked"), F.count("*").alias("rows"))


@query("j7_label_conflicts", X.ctes("pairs") + """, k AS (SELECT row_id, a AS lo, b AS hi, a[1:3] AS flo, b[1:2] AS fhi, y, line FROM pairs)
SELECT row_id, (lo, hi) IN (SELECT (lo, hi) FROM k WHERE y = 1) AS exact_conflict, (flo, fhi) IN (SELECT (flo, fhi) FROM k WHERE y = 1 AND line = 7) AS family_conflict FROM k WHERE y = 0""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    keyed = P.canonical_pair(X.pairs(spark, d)).withColumns({"flo": F.substring("lo", 1, 3), "fhi": F.substring("hi", 1, 2)})
    positives = keyed.filter("y = 1")
    exact = positives.select("lo", "hi", F.lit(None).cast("string").alias("flo"), F.lit(None).cast("string").alias("fhi"))
    family = positives.filter("line = 7").select(F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"), "flo", "fhi")
    return P.label_conflicts(keyed.filter("y = 0"), exact.union(family)).select("row_id", "exact_conflict", "family_conflict")


@query("j21_annotation_witness", """WITH known AS (SELECT DISTINCT p_brand AS f FROM part WHERE p_size >= 49), w AS (SELECT p_partkey, CAST(p_brand IN (SELECT f FROM known) AS INTEGER) AS w FROM part WHERE p_size > 3)
SELECT CASE WHEN x.w IS NULL OR z.w IS NULL THEN -1 ELSE x.w + z.w END AS witnesses, count(*) AS rows FROM (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem) LEFT JOIN w x ON a = x.p_partkey LEFT JOIN w z ON b = z.p_partkey GROUP BY 1""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    part = X.table(spark, d, "part")
    annotation = part.select(F.col("p_partkey").alias("entity"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("family"))
    known = part.filter("p_size >= 49").select(F.col("p_brand").alias("family"))
    pairs = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return P.annotation_witness(pairs, annotation, known).groupBy("witnesses").agg(F.count("*").alias("rows"))


@query("n2_annotation_jaccard", X.ctes("entity") + """, p AS (SELECT c.conv_id, x.annots AS u, z.annots AS v FROM conversations c JOIN entity x ON x.entity = c.conv_id JOIN entity z ON z.entity = c.conv_id + c.turn + 1)
SELECT conv_id, round(len(list_intersect(u, v)) * 1.0 / len(list_distinct(list_concat(u, v))), 6) AS jaccard FROM p""")
def n2(spark: SparkSession, d: str) -> DataFrame:
    entities = X.entity(spark, d).select("entity", "annots")
    talks = X.table(spark, d, "conversations")
    left = talks.join(entities.withColumnRenamed("annots", "u"), F.col("conv_id") == F.col("entity")).drop("entity")
    both = left.join(entities.withColumnRenamed("annots", "v"), F.col("conv_id") + F.col("turn") + 1 == F.col("entity"))
    return both.select("conv_id", F.round(jaccard(F.col("u"), F.col("v")), 6).alias("jaccard"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("f1_sequence_composition", X.ctes("entity") + f""", c AS (SELECT entity, len, letter, len - length(replace(lower(seq), letter, '')) AS n FROM entity, (SELECT unnest(string_split('{_LETTERS}', '')) AS letter))
SELECT entity, letter, n, round(n * 1.0 / len, 6) AS share FROM c WHERE n > 0""")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.letter_shares(X.entity(spark, d), _LETTERS), "share")


@query("f1_two_mers", X.ctes("entity") + f""", t AS (SELECT entity, string_split(lower(seq), '') AS s FROM entity), m AS (SELECT entity, s[1:-2] AS x, s[2:] AS z FROM t WHERE len(s) > 1),
u AS (SELECT entity, unnest(x) AS p, unnest(z) AS q FROM m), c AS (SELECT entity, p || q AS mer, count(*) AS n FROM u WHERE p BETWEEN 'a' AND 'z' AND q BETWEEN 'a' AND 'z' AND contains('{_LETTERS}', p) AND contains('{_LETTERS}', q) GROUP BY ALL),
a AS (SELECT entity, sum(n) AS total FROM c GROUP BY entity) SELECT entity, mer, n, round(n * 1.0 / total, 6) AS share FROM c JOIN a USING (entity)""")
def f1_mers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.mer_shares(X.entity(spark, d), _LETTERS, 2), "share")


@query("f2_composition_cosine", X.ctes("entity") + f""", c AS (SELECT entity, letter AS x, len - length(replace(lower(seq), letter, '')) AS n FROM entity, (SELECT unnest(string_split('{_LETTERS}', '')) AS letter)),
v AS (SELECT entity, x, n / sqrt(sum(n * n) OVER (PARTITION BY entity)) AS w FROM c WHERE n > 0), p AS (SELECT DISTINCT conv_id AS a, conv_id + turn + 1 AS b FROM conversations)
SELECT a, b, round(sum(x.w * z.w), 6) AS cosine FROM p JOIN v x ON x.entity = a JOIN v z ON z.entity = b AND z.x = x.x GROUP BY ALL""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    talks = X.table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("conv_id") + F.col("turn") + 1).alias("b")).distinct()
    found = E.mer_cosines(talks, X.entity(spark, d), _LETTERS, [1]).select("a", "b", F.col("cosines")[0].alias("cosine"))
    return rounded(found.filter("cosine > 0"), "cosine")


@query("f1_composition_vector", X.ctes("entity") + """, t AS (SELECT entity, len, string_split(seq, '') AS s FROM entity WHERE len > 0), a AS (SELECT entity, len, list_transform(s, lambda x: CASE WHEN contains('acdefghiklmnpqrstvwy', x) THEN x END) AS s FROM t),
u AS (SELECT entity, max(len) AS len, count(z) AS valid, sum(strpos('acdefghiklmnpqrstvwy', z)) AS places FROM (SELECT entity, len, unnest(s) AS z FROM a) GROUP BY entity),
m AS (SELECT entity, count(*) FILTER (x IS NOT NULL AND z IS NOT NULL) AS pairs, sum(CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN (strpos('acdefghiklmnpqrstvwy', x) - 1) * 20 + strpos('acdefghiklmnpqrstvwy', z) ELSE 0 END) AS pair_places
      FROM (SELECT entity, unnest(s[1:-2]) AS x, unnest(s[2:]) AS z FROM a WHERE len > 1) GROUP BY entity)
SELECT e.entity, 422 AS dims, round(coalesce(ln(u.len), 0), 6) AS log_length, round(coalesce(valid / u.len, 0), 6) AS known, round(coalesce(places / u.len, 0), 6) AS places, round(coalesce(pairs / greatest(1, u.len - 1), 0), 6) AS pairs,
 round(coalesce(pair_places / greatest(1, u.len - 1), 0), 5) AS pair_places, round(coalesce(1 - valid / u.len, 0), 6) + 0.0 AS unknown FROM entity e LEFT JOIN u USING (entity) LEFT JOIN m USING (entity)""")
def f1_vector(spark: SparkSession, d: str) -> DataFrame:
    """All 422 numbers of each text, by sums over them."""
    found = E.composition_vector(X.entity(spark, d), "acdefghiklmnpqrstvwy")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    placed = lambda c: add(F.transform(c, lambda x, i: x * (i + 1)))
    letters, pairs = F.slice("v", 2, 20), F.slice("v", 22, 400)
    named = found.select("entity", F.size("v").alias("dims"), F.col("v")[0].alias("log_length"), add(letters).alias("known"), placed(letters).alias("places"), add(pairs).alias("pairs"), placed(pairs).alias("pair_places"), F.col("v")[421].alias("unknown"))
    return rounded(rounded(named, "log_length", "known", "places", "pairs", "unknown"), "pair_places", places=5)


@query("f2_sequence_controls", X.ctes("entity") + f""", c AS (SELECT entity, letter AS x, len - length(replace(lower(seq), letter, '')) AS n FROM entity, (SELECT unnest(string_split('{_LETTERS}', '')) AS letter)),
v AS (SELECT entity, x, n / sqrt(sum(n * n) OVER (PARTITION BY entity)) AS w FROM c WHERE n > 0), p AS (SELECT DISTINCT conv_id AS a, conv_id + turn + 1 AS b FROM conversations),
t AS (SELECT entity, string_split(lower(seq), '') AS s FROM entity WHERE len > 2), g AS (SELECT entity, unnest(s[1:-3]) AS x, unnest(s[2:-2]) AS z, unnest(s[3:]) AS o FROM t),
k AS (SELECT entity, x || z || o AS mer, count(*) AS n FROM g WHERE contains('{_LETTERS}', x) AND contains('{_LETTERS}', z) AND contains('{_LETTERS}', o) GROUP BY ALL), q AS (SELECT entity, mer, n / sqrt(sum(n * n) OVER (PARTITION BY entity)) AS w FROM k),
l AS (SELECT a, b, sum(x.w * z.w) AS cosine FROM p JOIN v x ON x.entity = a JOIN v z ON z.entity = b AND z.x = x.x GROUP BY ALL), r AS (SELECT a, b, sum(x.w * z.w) AS cosine FROM p JOIN q x ON x.entity = a JOIN q z ON z.entity = b AND z.mer = x.mer GROUP BY ALL)
SELECT a, b, round(coalesce(l.cosine, 0), 6) AS letter_cosine, round(coalesce(r.cosine, 0), 6) AS mer_cosine, round(CASE WHEN greatest(x.len, z.len) > 0 THEN least(x.len, z.len) / greatest(x.len, z.len) ELSE 0 END, 6) AS length_ratio
FROM p JOIN entity x ON x.entity = a JOIN entity z ON z.entity = b LEFT JOIN l USING (a, b) LEFT JOIN r USING (a, b)""")
def f2_controls(spark: SparkSession, d: str) -> DataFrame:
    talks = X.table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("conv_id") + F.col("turn") + 1).alias("b")).distinct()
    return rounded(E.sequence_controls(talks, X.entity(spark, d), _LETTERS), "letter_cosine", "mer_cosine", "length_ratio")


@query("f3_pair_baselines")
def f3_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Each text with the next one, positive if they have one language; a quarter of the pairs is held out. No SQL, as heads are fitted; the tests hold them against what their features can tell."""
    vectors = E.composition_vector(X.entity(spark, d), "acdefghiklmnpqrstvwy").select("entity", F.slice("v", 1, 21).alias("v"))
    named = materialise(vectors.join(X.entity(spark, d).select("entity", "grp"), "entity"), "vectors")
    left, right = named.select(F.col("entity").alias("a"), F.col("v").alias("u"), F.col("grp").alias("one")), named.select((F.col("entity") - 1).alias("a"), "v", F.col("grp").alias("two"))
    rows = left.join(right, "a").withColumn("y", F.col("one").eqNullSafe(F.col("two")).cast("int"))
    scored = E.pair_baselines(rows, F.pmod(F.xxhash64("a"), F.lit(4)) == 0)
    return rounded(M.ap_auroc(scored, ["baseline"]), "ap", "auroc")


@query("f4_transferred_value", X.ctes("pairs") + """, v AS (SELECT b AS entity, avg(y) AS value FROM pairs WHERE line <= 3 GROUP BY b), h AS (SELECT a AS q, b AS t, share * sqrt((1 - tax) * (1 - score)) AS w FROM pairs)
SELECT q, round(sum(w * value) / sum(w), 6) AS value FROM h JOIN v ON t = entity GROUP BY q""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d)
    values = rows.filter("line <= 3").groupBy(F.col("b").alias("entity")).agg(F.avg("y").alias("value"))
    hits = rows.select(F.col("a").alias("q"), F.col("b").alias("t"), F.col("share").alias("fident"), (1 - F.col("tax")).alias("qcov"), (1 - F.col("score")).alias("tcov"))
    wanted = rows.select(F.col("a").alias("entity")).distinct()
    found = E.transferred_value(wanted, hits, values)
    return rounded(found.select(F.col("entity").alias("q"), "value"), "value")


@query("f10_evidence_gate", X.ctes("pairs") + "SELECT row_id, round(least(1, share * 50 / 32) * least(1 - tax, 1 - score), 10) AS gate FROM pairs")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return X.pairs(spark, d).select("row_id", F.round(E.evidence_gate(F.col("share") * 50, F.array(1 - F.col("tax"), 1 - F.col("score"))), 10).alias("gate"))


_VECTORS = """WITH p AS (SELECT x.vec_id AS a, z.vec_id AS b, list_transform(x.embedding, lambda v: v::DOUBLE) AS u, list_transform(z.embedding, lambda v: v::DOUBLE) AS v FROM embeddings x JOIN embeddings z ON z.vec_id = x.vec_id + 1)"""


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding with the next one."""
    rows = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    left, right = rows.select(F.col("vec_id").alias("a"), F.col("v").alias("u")), rows.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), "v")
    return left.join(right, "a")


@query("f3_symmetric_pair_features", _VECTORS + " SELECT a, b, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: abs(u[i] - v[i]))), 6) AS sum_abs, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: u[i] * v[i])), 6) AS sum_product FROM p")
def f3(spark: SparkSession, d: str) -> DataFrame:
    found = E.symmetric_features(neighbours(spark, d), "u", "v")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return found.select("a", "b", total("abs_difference").alias("sum_abs"), total("product").alias("sum_product"))


@query("f11_block_distance", _VECTORS + " SELECT a, b, CAST(k AS INTEGER) AS block, round(sqrt(list_sum(list_transform(range(k * 16 + 1, k * 16 + 17), lambda i: pow(u[i] - v[i], 2))) / 16), 6) AS rms FROM p, (SELECT unnest(range(0, 4)) AS k)")
def f11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.block_rms(neighbours(spark, d), "u", "v", 16, 4).select("a", "b", "block", "rms"), "rms")


@query("f12_latent_pair_features", _VECTORS + " SELECT a, b, len(u) * 3 AS dims, round(list_sum(list_transform(range(1, len(u) + 1), lambda i: (u[i] + v[i]) / 2)), 6) AS sum_mean FROM p")
def f12(spark: SparkSession, d: str) -> DataFrame:
    found = E.symmetric_features(neighbours(spark, d), "u", "v")
    return found.select("a", "b", F.size(F.concat("mean", "abs_difference", "product")).cast("long").alias("dims"), F.round(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x), 6).alias("sum_mean"))


@query("f8_alpha_grid", X.ctes("pairs") + """, al AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS alpha), s AS (SELECT alpha, y, round(share + alpha * (CASE WHEN line > 2 THEN 1.0 ELSE 0.0 END) * (tax + y * 0.02), 6) AS z FROM pairs, al),
g AS (SELECT alpha, z, sum(y) AS tp, sum(1 - y) AS fp FROM s GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM g WINDOW w AS (PARTITION BY alpha ORDER BY z DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT alpha, sum(tp * ct / (ct + cf)) / sum(tp) AS ap FROM c GROUP BY alpha) SELECT CAST(alpha AS DOUBLE) AS alpha, round(ap, 6) AS ap FROM m ORDER BY ap DESC, alpha LIMIT 1""")
def f8(spark: SparkSession, d: str) -> DataFrame:
    rows = X.pairs(spark, d).select("y", F.col("share").alias("base"), (F.col("tax") + F.col("y") * 0.02).alias("evidence"), F.when(F.col("line") > 2, 1.0).otherwise(0.0).alias("gate"))
    return rounded(E.calibrate_alpha(rows, [0.0, 0.25, 0.5, 1.0]), "ap")
