"""Queries through sources, sinks and the run-log monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewise.functions.shared import fresh_path
from edgewise.operators import learn as L
from edgewise.sources import archive
from edgewise.sources import files as S
from edgewise.streaming import monitor

from . import fixtures as X
from .metric_queries import rounded
from .registry import query

_BARE = "regexp_replace(text, '\\s', '', 'g')"


@query("s1_fasta_round_trip", f"SELECT CAST(doc_id AS VARCHAR) AS id, sha256({_BARE}) AS sha FROM documents")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Writes all documents as FASTA (S2) and reads them back."""
    path = fresh_path(spark, "fasta")
    S.write_fasta(X.table(spark, d, "documents"), path, "doc_id", "text")
    return S.read_fasta(spark, path).select("id", F.sha2(F.col("seq").cast("binary"), 256).alias("sha"))


@query("s3_delimited_round_trip", "SELECT l_partkey AS q, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def s3(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "tsv")
    X.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").write.option("sep", "\t").option("compression", "gzip").csv(path)
    return S.read_delimited(spark, path, "q long, t long, quantity double").groupBy("q").agg(F.count("*").alias("rows"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("s4_catalogue_round_trip", """SELECT 'D' || doc_id AS "primary", 'A' || doc_id AS aliases, CASE WHEN n_chars % 2 = 0 AND lang = 'en' THEN 'GO:' || doc_id ELSE '' END AS annotations,
CASE WHEN n_chars % 3 = 0 THEN 'D' || doc_id || '-1' ELSE '' END AS displayed FROM documents""")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Writes all documents as nested catalogue entries with fields beside those in use, and reads them back."""
    path, ident = fresh_path(spark, "catalogue"), F.col("doc_id").cast("string")
    term = F.struct(F.lit("GoTerm").alias("key"), F.concat(F.when(F.col("lang") == "en", "P:").otherwise("F:"), "source").alias("value"))
    reference = F.struct(F.when(F.col("n_chars") % 2 == 0, "GO").otherwise("KEGG").alias("database"), F.concat(F.lit("GO:"), ident).alias("id"), F.array(term).alias("properties"))
    isoform = lambda status, k: F.struct(F.lit(status).alias("isoformSequenceStatus"), F.array(F.concat(F.lit("D"), ident, F.lit(k))).alias("isoformIds"))
    comment = F.struct(F.lit("ALTERNATIVE PRODUCTS").alias("commentType"), F.when(F.col("n_chars") % 3 == 0, F.array(isoform("Displayed", "-1"), isoform("Described", "-2"))).alias("isoforms"))
    entry = F.struct(F.concat(F.lit("D"), ident).alias("primaryAccession"), F.array(F.concat(F.lit("A"), ident)).alias("secondaryAccessions"), F.array(reference).alias("uniProtKBCrossReferences"), F.array(comment).alias("comments"), "text")
    X.table(spark, d, "documents").select(F.to_json(entry).alias("value")).write.text(path)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return S.read_catalogue(spark, path).select("primary", joined("aliases"), joined("annotations"), joined("displayed"))


@query("s5_alignment_scan", """WITH r AS (SELECT label, vec_id, min(vec_id) OVER (PARTITION BY label) AS first, embedding FROM embeddings), t AS (SELECT label, vec_id, first, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS col FROM r)
SELECT 'uid=' || label AS uid, count(DISTINCT vec_id) AS rows, count(DISTINCT vec_id) FILTER (vec_id % 7 = 0 AND vec_id <> first) AS bad, count(DISTINCT vec_id) FILTER (vec_id % 5 = 0 AND vec_id <> first) AS taxed,
 count(*) FILTER (abs(v) >= 0.03 AND (vec_id = first OR vec_id % 7 <> 0 OR col < 10)) AS letters FROM t GROUP BY label""")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Writes all embeddings as alignment files, a label a file, with insertions, taxa and rows cut short, and reads them back."""
    path, letters = fresh_path(spark, "alignments"), "ABCDEFGHIJKLMNOPQRST"
    vectors = X.table(spark, d, "embeddings").select(F.col("label").alias("uid"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("v"))
    letter = lambda x: F.when(F.abs(x) < 0.03, "-").otherwise(F.substring(F.lit(letters), F.least(F.lit(19), F.greatest(F.lit(0), F.floor((x + 0.5) * 20))).cast("int") + 1, 1))
    first = F.col("row") == F.min("row").over(Window.partitionBy("uid"))
    named = vectors.withColumns({"first": first, "seq": F.array_join(F.transform("v", letter), "")})
    cut = F.when((F.col("row") % 7 == 0) & ~F.col("first"), F.substring("seq", 1, 10)).otherwise(F.col("seq"))
    inserted = F.when(F.col("row") % 3 == 0, F.concat(F.substring(cut, 1, 5), F.lit("xy."), F.substring(cut, 6, 1000))).otherwise(cut)
    head = F.when(F.col("first"), "query").otherwise(F.concat(F.lit("k"), F.col("row").cast("string"), F.when(F.col("row") % 5 == 0, " d:p:c:o").otherwise("")))
    records = named.select("uid", "row", F.concat(F.lit(">"), head, F.lit("\n"), inserted).alias("value"))
    records.repartition("uid").sortWithinPartitions("uid", "row").select("uid", "value").write.partitionBy("uid").text(path)
    found = S.read_a3m(spark, f"{path}/*/*.txt").withColumn("uid", F.regexp_extract("uid", "uid=[0-9]+", 0))
    letters_of = F.char_length(F.regexp_replace("aligned", "-", ""))
    return found.groupBy("uid").agg(F.count("*").alias("rows"), F.sum(F.col("bad_length").cast("long")).alias("bad"), F.count("tax").alias("taxed"), F.sum(letters_of).cast("long").alias("letters"))


@query("s6_archive_selection", "WITH f AS (SELECT 'm' || doc_id AS name, sha256(text) AS sha FROM documents) SELECT sha, min(name) AS name FROM f WHERE sha IN (SELECT sha256(text) FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0) GROUP BY sha")
def s6(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("query"))
    wanted = docs.join(X.table(spark, d, "labels").filter("toxic = 0"), "doc_id").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return S.select_archive(files, wanted)


@query("s6_archive_members", """WITH d AS (SELECT doc_id, 'm' || doc_id || '.a3m' AS name, regexp_replace(text, '[^A-Za-z]', '', 'g') AS query FROM documents),
w AS (SELECT DISTINCT sha256(query) AS sha FROM d JOIN labels USING (doc_id) WHERE toxic = 0), f AS (SELECT sha256(query) AS sha, min(name) AS name FROM d WHERE sha256(query) IN (SELECT sha FROM w) GROUP BY ALL)
SELECT f.sha AS query_sha256, f.name, CAST(doc_id % 3 + 1 AS BIGINT) AS records, CAST((doc_id % 3 + 1) * length(query) AS BIGINT) AS letters FROM f JOIN d USING (name)""")
def s6_members(spark: SparkSession, d: str) -> DataFrame:
    """All documents as members of written archives, a third of them with one record, two or three; the wanted ones are read back."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    docs = X.table(spark, d, "documents").withColumn("query", letters)
    record = lambda k: F.concat(F.lit(">r"), k.cast("string"), F.lit(" t\n"), F.reverse("query"), F.lit("\n"))
    records = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 3), record), "")
    text = F.concat(F.lit(">mask\n"), F.repeat(F.lit("*"), F.char_length("query")), F.lit("\n>query\n"), F.col("query"), F.lit("\n"), records)
    path = fresh_path(spark, "archives")
    archive.write_archives(docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".a3m")).alias("name"), text.alias("text")), path)
    wanted = docs.join(X.table(spark, d, "labels").filter("toxic = 0"), "doc_id").select(F.sha2(F.col("query").cast("binary"), 256).alias("sha"))
    return archive.read_members(spark, path, wanted).groupBy("query_sha256", "name").agg(F.count("*").alias("records"), F.sum(F.char_length("aligned")).alias("letters"))


@query("s7_event_log_scan", "SELECT event_type AS kind, count(*) AS rows, CAST(max(event_id) AS BIGINT) AS last_update FROM events GROUP BY 1")
def s7(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    X.log(spark, d).select("run", "upd", "kind", "value").write.json(path)
    return S.read_event_log(spark, path, "run long, upd long, kind string, value double").groupBy("kind").agg(F.count("*").alias("rows"), F.max("upd").alias("last_update"))


@query("s9_wide_predictions", X.ctes("pairs", "scores") + "SELECT row_id, round(max(score) FILTER (model = 'm0'), 6) AS m0, round(max(score) FILTER (model = 'm1'), 6) AS m1, round(max(score) FILTER (model = 'm2'), 6) AS m2 FROM scores GROUP BY row_id")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.wide_predictions(X.scores(spark, d), ["m0", "m1", "m2"]), "m0", "m1", "m2")


@query("s8_shard_merge", X.ctes("pairs") + "SELECT row_id % 4 AS part, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives FROM pairs GROUP BY 1")
def s8(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "shards")
    X.pairs(spark, d).select("row_id", "y", (F.col("row_id") % 4).alias("part")).write.partitionBy("part").parquet(path)
    merged = S.read_shards(spark, [f"{path}/part={k}" for k in range(4)])
    return merged.groupBy((F.col("row_id") % 4).alias("part")).agg(F.count("*").alias("rows"), F.sum("y").cast("long").alias("positives"))


@query("s11_manifest", X.ctes("pairs") + "SELECT bit_xor(('0x' || substr(sha256(concat_ws('|', a, b, row_id)), 1, 15))::BIGINT) AS digest, count(*) AS rows FROM pairs")
def s11(spark: SparkSession, d: str) -> DataFrame:
    manifest = S.write_with_manifest(X.pairs(spark, d), fresh_path(spark, "published"), ["a", "b", "row_id"])
    return manifest.agg(F.bit_xor("digest").alias("digest"), F.sum("rows").alias("rows"))


@query("s12_tokenise", X.ctes("entity") + ", t AS (SELECT entity, unnest(string_split(lower(seq), '')) AS c FROM entity WHERE len > 0) SELECT entity, count(*) AS n, count(*) FILTER (NOT contains('abcdefghij', c)) AS n_unknown, CAST(sum(CASE WHEN contains('abcdefghij', c) THEN ascii(c) - 97 ELSE 10 END) AS BIGINT) AS total FROM t GROUP BY entity")
def s12(spark: SparkSession, d: str) -> DataFrame:
    rows = S.tokenise(X.entity(spark, d).withColumn("low", F.lower("seq")).filter("len > 0"), "abcdefghij", 10, "low")
    return rows.select("entity", F.size("tokens").cast("long").alias("n"), F.col("n_unknown").cast("long").alias("n_unknown"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("s13_task_rows", "SELECT count(*) AS rows, CAST(sum(l_suppkey) AS BIGINT) AS left_sum FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size + l_quantity > 50")
def s13(spark: SparkSession, d: str) -> DataFrame:
    line, part = X.table(spark, d, "lineitem"), X.table(spark, d, "part")
    pairs = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("row_id"), F.col("p_size").alias("len_a"), F.col("l_quantity").alias("len_b"))
    return S.task_rows(pairs, 1, True, 50).agg(F.count("*").alias("rows"), F.sum("a").alias("left_sum"))


@query("s13_task_catalogue", """WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, l_orderkey AS row_id, p_size + l_quantity AS len FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT 'all' AS task, count(*) AS rows, CAST(sum(a) AS BIGINT) AS left_sum FROM r UNION ALL SELECT 'every seventh', count(*), CAST(sum(a) AS BIGINT) FROM r WHERE row_id % 7 = 0
UNION ALL SELECT 'long, swapped', count(*), CAST(sum(b) AS BIGINT) FROM r WHERE len > 50""")
def s13_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Three tasks over all order lines; the stride is the task's own."""
    line, part = X.table(spark, d, "lineitem"), X.table(spark, d, "part")
    pairs = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("row_id"), F.col("p_size").alias("len_a"), F.col("l_quantity").alias("len_b"))
    tasks = {"all": {}, "every seventh": {"stride": 7}, "long, swapped": {"swap": True, "longer_than": 50}}
    return S.task_catalogue(pairs, tasks).groupBy("task").agg(F.count("*").alias("rows"), F.sum("a").alias("left_sum"))


@query("s15_clean_interactions", X.ctes("pairs") + ", e AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 10 UNION ALL SELECT 's' || s_suppkey FROM supplier) SELECT y, count(*) AS rows, count(*) FILTER (a NOT IN (SELECT id FROM e) OR b NOT IN (SELECT id FROM e)) AS missing FROM pairs GROUP BY y")
def s15(spark: SparkSession, d: str) -> DataFrame:
    part = X.table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("seq"))
    supplier = X.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("seq"))
    raw = X.pairs(spark, d).select("a", "b", F.col("y").cast("double").cast("string").alias("label"))
    return S.clean_interactions(raw, part.union(supplier)).groupBy("y").agg(F.count("*").alias("rows"), F.sum(F.col("missing").cast("long")).alias("missing"))


_MONITOR = "SELECT user_id % 4 AS run, date_trunc('hour', ts) AS window_start, count(*) AS rows, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY ALL"


@query("st1_run_monitor_batch", _MONITOR)
def st1_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(monitor.windowed(monitor.as_log(X.table(spark, d, "events")), "1 hour"), "mean")


@query("st1_run_monitor_stream", _MONITOR)
def st1(spark: SparkSession, d: str) -> DataFrame:
    """The same transform over a stream of the table's files, run to its end."""
    return rounded(monitor.run_once(spark, f"{d}/events.parquet", "1 hour", "30 minutes"), "mean")


@query("st1_alarms", "SELECT user_id % 4 AS run, count(*) AS alarms, CAST(min(event_id) AS BIGINT) AS first_update FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 GROUP BY 1")
def st1_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Logs in which some updates lost their value: none, or none that is finite."""
    log = X.log(spark, d)
    broken = log.withColumn("value", F.when(F.col("upd") % 97 == 0, F.lit(float("nan"))).when(F.col("upd") % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return monitor.alarms(broken).groupBy("run").agg(F.count("*").alias("alarms"), F.min("upd").alias("first_update"))


def _learning_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = X.table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") < 3).cast("int").alias("y"))


def held_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows to fit on and rows to score: a quarter by hash is held out."""
    rows = _learning_rows(spark, d).withColumn("held", F.pmod(F.xxhash64("row_id"), F.lit(4)) == 0)
    return rows.filter("NOT held"), rows.filter("held")


@query("f5_boosted_trees")
def f5(spark: SparkSession, d: str) -> DataFrame:
    """Rows held out from the fit. No SQL: another implementation of trees than the one compared with; the tests check the order of held-out rows."""
    train, held = held_rows(spark, d)
    return L.boosted_values(train, held, trees=20, depth=4)


@query("f6_scaled_pca_logistic")
def f6(spark: SparkSession, d: str) -> DataFrame:
    """Rows held out from the fit. No SQL: fitted numbers differ between libraries; the tests check them on rows held out."""
    train, held = held_rows(spark, d)
    return L.score_head(L.fit_head(train, components=32), held)


_W = ", ".join(f"{(i % 7 - 3) / 10.0}" for i in range(64))


@query("f7_frozen_head", f"SELECT vec_id AS row_id, round(0.25 + list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * ([{_W}])[i])), 6) AS logit FROM embeddings")
def f7(spark: SparkSession, d: str) -> DataFrame:
    weights = [(i % 7 - 3) / 10.0 for i in range(64)]
    return _learning_rows(spark, d).select("row_id", F.round(L.frozen_logit(F.col("v"), weights, 0.25), 6).alias("logit"))


@query("f9_cross_fitting")
def f9(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold scores of all rows. No SQL; the tests check that no fold sees its own labels."""
    return L.cross_fit(_learning_rows(spark, d).withColumn("fold", F.col("row_id") % 3), 3, components=32)


@query("st1_streamed_alarms", X.ctes("log") + """, t AS (SELECT run, upd, avg(value) OVER w AS mean, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY run ORDER BY upd ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT run, min(upd) AS upd FROM t WHERE n = 50 AND mean > 55 GROUP BY run) SELECT run, upd, 'mean' AS alarm, round(mean, 6) AS value FROM t JOIN f USING (run, upd)""")
def st1_streamed(spark: SparkSession, d: str) -> DataFrame:
    """All events as a folder of JSON lines that grows by a third of the updates at a time, watched again each time; alarms of the trailing mean."""
    rows = X.log(spark, d).select(F.col("run").cast("long").alias("run"), F.col("upd").cast("long").alias("upd"), "value")
    folder, out = fresh_path(spark, "growing"), fresh_path(spark, "watched")
    low, high = rows.agg(F.min("upd"), F.max("upd")).first()
    third = F.floor((F.col("upd") - low) * 3 / (high - low + 1))
    for k in range(3):
        rows.filter(third == k).write.mode("append").json(folder)
        monitor.watch(spark.readStream.schema("run long, upd long, value double").json(folder), 50, 55.0, out).awaitTermination()
    return rounded(spark.read.schema(monitor.ALARMS).parquet(f"{out}/alarms"), "value")
