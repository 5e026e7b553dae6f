"""The registered queries: one for each operator, and the pipeline's first stage as a helper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, language, media, mixing, near_dedup, neighbours, packing, quality, secrets, store, toxicity, whitening
from .common import held_out


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(_docs(spark, sf_dir)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify_quality(_docs(spark, sf_dir), _labels(spark, sf_dir))
    return found.select("doc_id", "held_out", *[F.round(c, 6).alias(c) for c in ("doc_chance", "host_mean", "path_mean", "score")], "kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir).select("doc_id", "text"), 1024)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    base = store.write_store(docs)
    return store.read_store(spark, base, docs.schema["doc_id"].dataType.simpleString()).withColumnRenamed("id", "doc_id")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.jaccard_classes(_docs(spark, sf_dir)).select("doc_id", "class_id", "rep_id", "n_links", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.learn_from_tables(docs, _labels(spark, sf_dir))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_docs(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_docs(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("__copy").cast("long").alias("copy"), F.col("__order").alias("order_key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_packets(media.text_media(_docs(spark, sf_dir))))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0, 20)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_docs(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_embeddings(spark, sf_dir).select("vec_id", "embedding"))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def queries() -> dict:
    found = (
        op1_secrets, op2_quality, op3_packing, op4_exact_dedup, op5_token_store, op6_ngram_jaccard, op7_toxicity, op8_language, op9_mixing, op10_matroska, op11_graph_neighbours, op12_token_alignment,
        op13_whitening,
    )
    return {f.__name__: f for f in found}


_OP4 = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""

_OP9 = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, pow(n, 0.5) / sum(pow(n, 0.5)) OVER () * sum(n) OVER () / n AS rate FROM sizes),
parts AS (SELECT d.doc_id, d.source, d.text, 'mix:' || coalesce(d.doc_id::VARCHAR, '') AS key,
                 CASE WHEN rate <= 500 THEN [''] ELSE list_transform(range(1, ceil(rate / 500)::BIGINT + 1), lambda i: 'part:' || i || ':') END AS names,
                 rate / greatest(ceil(rate / 500), 1) AS lam
          FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
counted AS (SELECT *, list_sum(list_transform(names, lambda p: len(list_filter(range(0, ceil(lam + 12 * sqrt(lam) + 24)::BIGINT),
                lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1.0))))
                          <= ('0x' || substr(sha256(p || key), 1, 15))::BIGINT / 1152921504606846976.0)))) AS k FROM parts),
copies AS (SELECT doc_id, source, text, key, unnest(range(1, k::BIGINT + 1)) AS copy FROM counted)
SELECT doc_id, source, copy, ('0x' || substr(sha256('order:' || key || ':' || copy), 1, 15))::BIGINT AS order_key, sha256(coalesce(text, '')) AS text_sha256 FROM copies
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": _OP4, "op9_mixing": _OP9}
