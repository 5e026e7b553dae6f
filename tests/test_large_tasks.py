"""No task holds what grows with the input: how rows are dealt, and the same results on odd rows."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgewise.operators import features, graph, metrics, pairs
from edgewise.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def uncoalesced(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_balanced_ap_joins_no_rows_by_model(spark, monkeypatch):
    seen, groups = [], metrics.tie_groups
    monkeypatch.setattr(metrics, "tie_groups", lambda df, *more: seen.append(plan(df)) or groups(df, *more))
    rows = [("x", 0.9, 1), ("x", 0.8, 0), ("x", 0.8, 1), ("x", 0.1, 0), ("x", 0.1, 0), ("one", 0.5, 1), ("none", 0.5, 0), (None, 0.5, 1), (None, 0.4, 0)]
    found = {r["model"]: r["balanced_ap"] for r in metrics.balanced_ap(spark.createDataFrame(rows, "model string, score double, y int"), ["model"]).collect()}
    assert seen and not any("Join" in p for p in seen)
    assert found == {"x": pytest.approx(0.5 + 0.5 * 1 / (1 + 1 / 3)), "one": None, "none": None}


def test_places_are_dealt_by_ranges(spark, monkeypatch, uncoalesced):
    tables, write = [], pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda df, *more: tables.append(write(df, *more)) or tables[-1])
    n = registry.queries()["t1_hash_order"](spark, DATA).count()
    sizes = [r["count"] for t in tables for r in t.groupBy("__part").count().collect()]
    assert sum(sizes) == n and max(sizes) < 0.5 * n and len(sizes) == 4


def test_places_of_ties_and_nulls(spark, uncoalesced):
    rows = [("a" if i % 3 else None, None if i % 7 == 0 else i % 50) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int")
    found = pairs.places_within(df, ["g"], [-F.col("v")], "k").collect()
    assert Counter((r["g"], r["v"]) for r in found) == Counter(rows)
    for g, n in Counter(g for g, _ in rows).items():
        own = sorted((r["k"], r["v"]) for r in found if r["g"] == g)
        values = [99 if v is None else v for _, v in own]
        assert [k for k, _ in own] == list(range(1, n + 1)) and values == sorted(values, reverse=True)
    assert pairs.places_within(df.limit(0), ["g"], [F.col("v")]).isEmpty()


TEXTS = [(i, t) for i, t in enumerate(["abcabc", "ABCXabc", "", None, "zz zz", "a", "İab", "abcabc" * 40, "no one asks"])]


def runs(text, k):
    text = (text or "").lower()
    return Counter(m for m in (text[i : i + k] for i in range(len(text) - k + 1)) if all("a" <= c <= "z" for c in m))


def test_text_counts_take_small_batches_and_no_shuffle(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df, letters = spark.createDataFrame(TEXTS, "entity long, seq string"), "abcdefghijklmnopqrstuvwxyz"
    found = features.mer_shares(df, letters, 2)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert not any(x in plan(found) for x in ("Join", "Aggregate"))
    for at in (2, 100):  # texts counted at a time
        monkeypatch.setattr(features, "_TEXTS", at)
        wanted = {(e, m, n, n / runs(t, 2).total()) for e, t in TEXTS for m, n in runs(t, 2).items()}
        assert {tuple(r) for r in features.mer_shares(df, letters, 2).collect()} == wanted


def test_cosines_count_each_end_once(spark, monkeypatch):
    tables, write = [], features.materialise
    monkeypatch.setattr(features, "materialise", lambda df, *more: tables.append(write(df, *more)) or tables[-1])
    df = spark.createDataFrame(TEXTS, "entity long, seq string")
    wanted = [(0, 1), (1, 0), (0, 7), (0, 0), (2, 0), (3, 0), (3, 2), (4, 5), (6, 0), (0, 99)]
    found = {(r["a"], r["b"]): r for r in features.sequence_controls(spark.createDataFrame(wanted, "a long, b long"), df, "abcdefghijklmnopqrstuvwxyz").collect()}
    assert set(found) == set(wanted[:-1]) and sorted(r["entity"] for r in tables[0].select("entity").collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    texts = dict(TEXTS)
    for (a, b), r in found.items():
        for k, name in ((1, "letter_cosine"), (3, "mer_cosine")):
            u, v = runs(texts[a], k), runs(texts[b], k)
            norm = math.sqrt(sum(n * n for n in u.values()) * sum(n * n for n in v.values()))
            assert r[name] == pytest.approx(sum(u[m] * v[m] for m in u) / norm if norm else 0.0)


def test_baselines_read_their_rows_once(spark):
    count = spark.sparkContext.accumulator(0)

    def label(a):
        count.add(1)
        return a % 2

    df = spark.range(200).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("u"), F.array(F.lit(2.0), F.rand(1)).alias("v"), F.udf(label, "int")("id").alias("y"), (F.col("id") % 4 == 0).alias("h"))
    assert features.pair_baselines(df, F.col("h")).count() == 4 * 50
    assert count.value == 200


def test_exposure_by_sequence_keeps_no_hashes(spark, monkeypatch):
    tables, write = [], pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda df, *more: tables.append(write(df, *more)) or tables[-1])
    tests = spark.createDataFrame([("p", "q", 1), ("q", "r", 2), ("p", None, 3), ("p", "unknown", 4), ("r", "p", 5), ("s", "s", 6)], "a string, b string, lo int")
    entities = spark.createDataFrame([("p", "AA"), ("q", "BB"), ("r", "BB"), ("s", None)], "entity string, seq string")
    sources = spark.createDataFrame([("one", 1, "x", "y", 1), ("one", 2, "y", "w", 0), ("one", 4, "y", "gone", 1), ("one", 4, "z", None, 1), ("one", 8, "y", "y", 0)], "split string, bit int, a string, b string, y int")
    sequences = spark.createDataFrame([("one", "x", "AA"), ("one", "y", "BB"), ("one", "w", "CC"), ("one", "z", None)], "split string, id string, seq string")
    flags, audit = pairs.sequence_exposure(tests, entities, sources, sequences, (1, 9))
    assert {r["lo"]: (r["pair_bits"], r["a_bits"], r["b_bits"]) for r in flags.collect()} == {1: (1, 1, 11), 2: (8, 11, 11), 3: (0, 1, 0), 4: (0, 1, 0), 5: (1, 11, 1), 6: (0, 0, 0)}
    # The first source meets p-q and p-r; the last meets q-r from both sides.
    assert [tuple(r) for r in audit.collect()] == [("one", 5, 3, 2, 2, 4)]
    strings = [c for t in tables for r in t.collect() for c in r if isinstance(c, str)]
    assert strings and max(map(len, strings)) < 32


def test_stars_without_hubs_look_for_them_once_a_round(spark, monkeypatch):
    searches, search = [], graph._hubs
    monkeypatch.setattr(graph, "_hubs", lambda edges, rows: searches.append(rows) or search(edges, rows))
    path = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found, left = graph.star_components(path)
    assert len(searches) == len(left) and found.filter("component <> 0").isEmpty() and found.count() == 201
    assert "Join" not in plan(graph._beside_least(path.toDF("u", "v"), None))
