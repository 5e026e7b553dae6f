"""Queries on graphs, splits and registries of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewise.operators import splits as S
from edgewise.operators.graph import connected_components, star_components

from . import fixtures as X
from .registry import _SQL, query

# An entity (supplier or part) belongs to a family, its nation or brand. Every supplier, part and order line is read.


def entities(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers and parts with their families."""
    supplier, part = X.table(spark, d, "supplier"), X.table(spark, d, "part")
    one = supplier.select(F.col("s_suppkey").cast("long").alias("entity"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("family"))
    return one.union(part.select((F.lit(100000000) + F.col("p_partkey")).alias("entity"), F.col("p_brand").alias("family")))


def line_hits(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as hits of supplier and part."""
    return X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), (F.lit(100000000) + F.col("l_partkey")).alias("t"), F.col("l_quantity").alias("bits"), F.col("l_linenumber").alias("qlen"), F.lit(5).alias("tlen"))


def family_members(spark: SparkSession, d: str) -> DataFrame:
    """All entities with their components, linked by family; no order line is a must-link."""
    every = entities(spark, d)
    edges = S.must_link_edges(every, line_hits(spark, d).limit(0))
    return S.with_components(every, connected_components(edges)).select("entity", "component")


_FAMILIES = """WITH RECURSIVE lines AS (SELECT l_suppkey AS s, l_partkey AS p, l_quantity AS w FROM lineitem),
ent AS (SELECT CAST(s_suppkey AS BIGINT) AS node, 'n' || s_nationkey AS family FROM supplier UNION ALL SELECT CAST(100000000 + p_partkey AS BIGINT), p_brand FROM part),
comp AS (SELECT node, min(node) OVER (PARTITION BY family) AS component FROM ent) """


@query("c1_all_components")
def c1_all(spark: SparkSession, d: str) -> DataFrame:
    """Families and all order lines as must-links; no SQL, as recursion over all lines is too slow. The tests hold it against union-find."""
    every = entities(spark, d)
    edges = S.must_link_edges(every, line_hits(spark, d))
    return S.with_components(every, connected_components(edges)).select(F.col("entity").alias("node"), "component")


@query("c1_connected_components", _FAMILIES + "SELECT node, component FROM comp")
def c1(spark: SparkSession, d: str) -> DataFrame:
    """Families alone as must-links: many components over all entities."""
    return family_members(spark, d).withColumnRenamed("entity", "node")


@query("c1_qualified_components", """WITH RECURSIVE part_family AS (SELECT CAST(100000000 + p_partkey AS BIGINT) AS node, p_brand || p_type || p_size AS family FROM part),
ent AS (SELECT node FROM part_family UNION ALL SELECT CAST(s_suppkey AS BIGINT) FROM supplier),
one AS (SELECT min(node) OVER (PARTITION BY family) AS u, node AS v FROM part_family UNION ALL SELECT l_suppkey, 100000000 + l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.095),
e AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM one UNION ALL SELECT v, u FROM one) WHERE u <> v),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM ent UNION
  SELECT e.v, min(cc.component) FROM cc JOIN e ON e.u = cc.node JOIN recurring.cc AS r ON r.node = e.v WHERE cc.component < r.component GROUP BY e.v)
SELECT node, component FROM cc""")
def c1_qualified(spark: SparkSession, d: str) -> DataFrame:
    """Parts of one brand, type and size as families, and as hits the order lines that qualify by quantity and discount: components of many links across."""
    part = X.table(spark, d, "part").select((F.lit(100000000) + F.col("p_partkey")).alias("entity"), F.concat("p_brand", "p_type", F.col("p_size").cast("string")).alias("family"))
    every = part.unionByName(X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("entity"), F.lit(None).cast("string").alias("family")))
    line = X.table(spark, d, "lineitem").filter("l_quantity >= 49 AND l_discount >= 0.095")
    hits = line.select(F.col("l_suppkey").cast("long").alias("q"), (F.lit(100000000) + F.col("l_partkey")).alias("t"))
    return S.with_components(every, star_components(S.must_link_edges(every, hits))[0]).select(F.col("entity").alias("node"), "component")


@query("c1_order_chains", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def c1_chains(spark: SparkSession, d: str) -> DataFrame:
    """Every order linked to its customer's next one by date: a long path a customer."""
    orders = X.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chained = orders.select(F.col("o_orderkey").alias("src"), F.coalesce(following, "o_orderkey").alias("dst"))
    return star_components(chained)[0]


@query("c2_contracted_graph", _FAMILIES + """, h AS (SELECT s AS q, 100000000 + p AS t, w FROM lines)
SELECT least(x.component, z.component) AS lo, greatest(x.component, z.component) AS hi,
  CAST(max(greatest(1, floor(100 * l_quantity / least(l_linenumber, 5) + 0.5))) AS BIGINT) AS weight
FROM lineitem JOIN comp x ON x.node = l_suppkey JOIN comp z ON z.node = 100000000 + l_partkey WHERE x.component <> z.component GROUP BY 1, 2""")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return S.contracted_graph(line_hits(spark, d), family_members(spark, d).withColumnRenamed("entity", "node"))


def _fold_sql(folds: int) -> str:
    """One component after the other, largest first, to the least-loaded of ``folds``."""
    first = ", ".join(["0"] * folds)
    return f""", size AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
o AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, ('0x' || substr(sha256('fold:' || component), 1, 15))::BIGINT, component) AS k FROM size),
r(k, component, fold, loads) AS (SELECT 0::BIGINT, 0::BIGINT, -1, [{first}]::BIGINT[] UNION ALL
  SELECT o.k, o.component, CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER),
         list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + o.size ELSE x END) FROM r JOIN o ON o.k = r.k + 1),
f AS (SELECT component, fold FROM r WHERE k > 0), m AS (SELECT node, component, fold FROM comp JOIN f USING (component)) """


@query("c4_component_folds", _FAMILIES + _fold_sql(4) + "SELECT node AS entity, component, fold FROM m")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return S.least_loaded_folds(family_members(spark, d), 4).select("entity", "component", "fold")


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    return line_hits(spark, d).select(F.col("q").alias("a"), F.col("t").alias("b"))


@query("c3_pair_roles", _FAMILIES + _fold_sql(2) + """SELECT CASE WHEN x.fold = z.fold THEN CAST(x.fold AS VARCHAR) ELSE 'crossing' END AS role, count(*) AS rows
FROM lineitem JOIN m x ON x.node = l_suppkey JOIN m z ON z.node = 100000000 + l_partkey GROUP BY 1""")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return S.pair_roles(line_pairs(spark, d), S.least_loaded_folds(family_members(spark, d), 2)).groupBy("role").agg(F.count("*").alias("rows"))


@query("c3_hash_order_sides", _FAMILIES + """, size AS (SELECT component, count(*) AS size FROM comp GROUP BY component),
o AS (SELECT component, size, row_number() OVER (ORDER BY ('0x' || substr(sha256('side:' || component), 1, 15))::BIGINT, component) AS k FROM size),
r(k, component, side, diff) AS (SELECT 0::BIGINT, 0::BIGINT, -1, 0::BIGINT UNION ALL
  SELECT o.k, o.component, CASE WHEN r.diff > 0 THEN 1 ELSE 0 END, CASE WHEN r.diff > 0 THEN r.diff - o.size ELSE r.diff + o.size END FROM r JOIN o ON o.k = r.k + 1),
m AS (SELECT node, side FROM comp JOIN r USING (component) WHERE k > 0)
SELECT CASE WHEN x.side = z.side THEN CAST(x.side AS VARCHAR) ELSE 'crossing' END AS role, count(*) AS rows
FROM lineitem JOIN m x ON x.node = l_suppkey JOIN m z ON z.node = 100000000 + l_partkey GROUP BY 1""")
def c3_hash(spark: SparkSession, d: str) -> DataFrame:
    """Whole families in hash order to two sides, and every order line by the sides of its ends."""
    sides = S.hash_order_sides(family_members(spark, d)).withColumnRenamed("side", "fold")
    return S.pair_roles(line_pairs(spark, d), sides).groupBy("role").agg(F.count("*").alias("rows"))


@query("c4_fold_membership", _FAMILIES + _fold_sql(4) + """, p AS (SELECT x.fold AS fa, z.fold AS fb FROM lineitem JOIN m x ON x.node = l_suppkey JOIN m z ON z.node = 100000000 + l_partkey)
SELECT CAST(g AS INTEGER) AS fold, CAST(fa = g AS INTEGER) + CAST(fb = g AS INTEGER) AS ends_inside, count(*) AS rows FROM p, (SELECT unnest(range(0, 4)) AS g) GROUP BY ALL""")
def c4_members(spark: SparkSession, d: str) -> DataFrame:
    return S.fold_membership(line_pairs(spark, d), S.least_loaded_folds(family_members(spark, d), 4), 4)


@query("c5_group_stratified_folds", """WITH RECURSIVE g AS (SELECT l_partkey || ':' || l_suppkey AS component, count(*) AS size, max(CAST(l_returnflag = 'R' AS INTEGER)) AS y FROM lineitem
  GROUP BY ALL HAVING max(CAST(l_returnflag = 'R' AS INTEGER)) = min(CAST(l_returnflag = 'R' AS INTEGER))),
c AS (SELECT y, size, count(*) AS n, row_number() OVER (PARTITION BY y ORDER BY size DESC) AS k FROM g GROUP BY y, size),
r(y, k, size, loads, taken) AS (SELECT DISTINCT y, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0]::BIGINT[], [0, 0, 0, 0]::BIGINT[] FROM g UNION ALL
  SELECT y, k, size, list_transform(loads, lambda x, i: x + size * len(list_filter(chosen, lambda v: v % 4 = i - 1))), list_transform(loads, lambda x, i: len(list_filter(chosen, lambda v: v % 4 = i - 1))::BIGINT) FROM (
    SELECT c.y, c.k, c.size, r.loads, list_sort(flatten(list_transform(range(0, 4), lambda f: list_transform(range(0, c.n), lambda j: (r.loads[f + 1] + c.size * j) * 4 + f))))[1:c.n] AS chosen FROM r JOIN c ON c.y = r.y AND c.k = r.k + 1)),
l AS (SELECT y, size, unnest(taken) AS n, CAST(unnest(range(0, 4)) AS INTEGER) AS fold FROM r WHERE k > 0)
SELECT y, fold, CAST(sum(n) AS BIGINT) AS groups, CAST(sum(n * size) AS BIGINT) AS rows FROM l GROUP BY ALL HAVING sum(n) > 0""")
def c5(spark: SparkSession, d: str) -> DataFrame:
    """All rows of pairs whose rows agree on the label, a pair a group; each label is dealt on its own."""
    line = X.table(spark, d, "lineitem")
    rows = line.select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("component"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    agree = rows.groupBy("component").agg(F.min("y").alias("low"), F.max("y").alias("high")).filter("low = high").select("component")
    dealt = S.least_loaded_folds(rows.join(agree, "component"), 4, stratum="y")
    return dealt.groupBy("y", "fold").agg(F.count_distinct("component").alias("groups"), F.count("*").alias("rows"))


@query("c5_all_stratified_folds", _FAMILIES + _fold_sql(4) + """, y AS (SELECT m.fold, l_returnflag = 'R' AS y FROM lineitem JOIN m ON node = l_suppkey)
SELECT fold, count(*) AS rows, count(*) FILTER (y) AS positives FROM y GROUP BY fold""")
def c5_all(spark: SparkSession, d: str) -> DataFrame:
    """All rows by the fold of their supplier's family, both labels in it."""
    members = S.least_loaded_folds(family_members(spark, d), 4)
    rows = X.table(spark, d, "lineitem").join(members, F.col("l_suppkey") == F.col("entity"))
    return rows.groupBy("fold").agg(F.count("*").alias("rows"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("positives"))


# Names of earlier rounds, when the queries above left out most lines.
for _old, _new, _function in (("c2_all_contracted_graph", "c2_contracted_graph", c2), ("c3_all_pair_roles", "c3_pair_roles", c3), ("c4_all_component_folds", "c4_component_folds", c4), ("c4_all_fold_membership", "c4_fold_membership", c4_members)):
    query(_old, _SQL[_new])(_function)


@query("c6_split_retention", """SELECT least(x.s_nationkey % 5, p_size % 5) AS lo, greatest(x.s_nationkey % 5, p_size % 5) AS hi, count(*) AS rows, least(x.s_nationkey % 5, p_size % 5) = greatest(x.s_nationkey % 5, p_size % 5) AS kept
FROM lineitem JOIN supplier x ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def c6(spark: SparkSession, d: str) -> DataFrame:
    line, supplier, part = (X.table(spark, d, n) for n in ("lineitem", "supplier", "part"))
    rows = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return S.retention(rows, F.col("s_nationkey") % 5, F.col("p_size") % 5)
