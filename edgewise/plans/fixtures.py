"""Views of the test tables that the queries run over, and the same views as SQL text.

All views cover whole tables. ``ctes`` gives the SQL of the named views in an
order in which each may use those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewise.functions.expressions import hash_draw

SQL = {
    "pairs": """SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, CAST(l_returnflag = 'R' AS INTEGER) AS y,
        ((l_orderkey * 1000000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS row_id, l_discount AS score, l_tax AS tax,
        l_quantity / 50.0 AS share, l_linenumber AS line FROM lineitem""",
    "scores": """SELECT a, b, y, row_id, model, CASE model WHEN 'm0' THEN score * 10 WHEN 'm1' THEN share ELSE (tax * 100 + y * 4) / 13.0 END AS score, line
        FROM pairs CROSS JOIN (SELECT unnest(['m0', 'm1', 'm2']) AS model)""",
    "split": """SELECT *, CASE WHEN ('0x' || substr(sha256('split:' || least(a, b) || ':' || greatest(a, b)), 1, 15))::BIGINT % 10 < 7 THEN 'train'
        WHEN ('0x' || substr(sha256('split:' || least(a, b) || ':' || greatest(a, b)), 1, 15))::BIGINT % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM pairs""",
    "entity": """SELECT doc_id AS entity, text AS seq, length(text) AS len, sha256(text) AS sha, source AS family, lang AS grp,
        list_distinct(string_split(text, ' ')) AS annots FROM documents""",
    "log": "SELECT user_id % 4 AS run, event_id AS upd, value, event_type AS kind, ts FROM events",
    "blocs": """SELECT 'n' || s.s_nationkey AS a, p.p_brand AS b, CAST(2 * sum(CAST(l.l_returnflag = 'R' AS INTEGER)) >= 0.66 * count(*) AS INTEGER) AS y,
        CAST(count(*) AS BIGINT) AS n_rows FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1, 2""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as labelled pairs of part and supplier."""
    row = ((F.col("l_orderkey") * 1000000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        row.alias("row_id"), F.col("l_discount").alias("score"), F.col("l_tax").alias("tax"), (F.col("l_quantity") / 50.0).alias("share"), F.col("l_linenumber").alias("line"),
    )


def by_model(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of ``pairs`` once for each of three frozen scores, two without information, one with; all with ties."""
    own = F.array(F.struct(F.lit("m0").alias("model"), (F.col("score") * 10).alias("score")), F.struct(F.lit("m1").alias("model"), F.col("share").alias("score")), F.struct(F.lit("m2").alias("model"), ((F.col("tax") * 100 + F.col("y") * 4) / 13.0).alias("score")))
    return rows.select(*keep, F.explode(own).alias("__s")).select(*keep, "__s.model", "__s.score")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frozen scores of every pair row."""
    return by_model(pairs(spark, sf_dir), "a", "b", "y", "row_id", "line").select("a", "b", "y", "row_id", "model", "score", "line")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = hash_draw(F.concat_ws(":", F.lit("split"), F.least("a", "b"), F.greatest("a", "b"))) % 10
    return pairs(spark, sf_dir).withColumn("split", F.when(draw < 7, "train").when(draw < 8, "val").otherwise("test"))


def entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("entity"), F.col("text").alias("seq"), F.char_length("text").alias("len"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("source").alias("family"), F.col("lang").alias("grp"),
        F.array_distinct(F.split("text", " ")).alias("annots"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("run"), F.col("event_id").alias("upd"), "value", F.col("event_type").alias("kind"), "ts")


def blocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All order lines gathered to pairs of supplier nation and part brand."""
    line, supplier, part = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "part"))
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    grouped = joined.groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("a"), F.col("p_brand").alias("b")).agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.count("*").alias("n_rows"))
    return grouped.select("a", "b", (2 * F.col("r") >= 0.66 * F.col("n_rows")).cast("int").alias("y"), "n_rows")
