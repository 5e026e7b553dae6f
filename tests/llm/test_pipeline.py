"""The pipeline's stages, one after the other, against brute force on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, near_copies, plain_classes, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(12), [], []
    texts = [words(k, rng.randint(30, 90)) for k in range(260)]
    texts += [t.replace(" ", "  ", 3) for t in texts[:10]] + near_copies(4, words(300, 80), 20, 3)
    texts += [f"{words(400 + k, 30)} vilest vileness {words(500 + k, 30)}" for k in range(90)] + ["", None]
    for i, t in enumerate(texts):
        rows.append((i, t, "en", f"s{i % 3}", len(t or "")))
        labels.append((i, 1, int("vile" in (t or ""))))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    one, two, three, four, five = [f for _, f in corpus_pipeline.STAGES]

    clean = one(spark, docs, folder).cache()
    left = {r["doc_id"] for r in clean.collect()}
    assert not [d for d in left if "vile" in (text[d] or "")] and len([d for d in text if "vile" not in (text[d] or "") and d not in left]) <= 2
    assert clean.columns == docs.columns

    exact = two(spark, clean, folder).cache()
    kept = {r["doc_id"] for r in exact.collect()}
    groups = {}
    for d in sorted(left):
        groups.setdefault(" ".join((text[d] or "").split(" ")) if text[d] is None else __import__("re").sub(r"[\x20\x09-\x0D]+", " ", text[d]), d)
    assert kept == set(groups.values()) and exact.columns == docs.columns

    near = three(spark, exact, folder).cache()
    classes = plain_classes([(d, text[d]) for d in sorted(kept)])
    assert {r["doc_id"] for r in near.collect()} == {c for c, _ in classes.values()} and near.columns == docs.columns

    mixed = four(spark, near, folder).cache()
    assert mixed.columns == docs.columns and 0.7 * near.count() < mixed.count() < 1.3 * near.count()

    packed = five(spark, mixed, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
    assert packed.filter("piece = 0").count() == mixed.count()


def test_run(spark, corpus):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_and_empty_tables(spark, corpus):
    """Nulls, repeated rows and extra columns with helper names, stage by stage; then no rows at all."""
    folder, _ = corpus
    long = words(1, 4000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (5, long + " end", "en", None, 1), (None, "no id", "en", "t", 1), (6, "one two", "en", "t", 1)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("id", "key", "row", "own", "__sha", "__own", "__id", "__source", "__rate", "__order", "th", "label", "n")})
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, folder)
        if name != "packing":
            assert out.columns == odd.columns and {r["__own"] for r in out.collect()} <= {"mine"}
        sizes.append(out.count())
        assert stage(spark, odd.limit(0), folder).isEmpty()
    assert sizes[:3] == [7, 5, 6] and sizes[4] >= 7
