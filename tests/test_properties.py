"""Properties and edge cases on small hand-made frames."""

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edgewise.functions.expressions import POISSON_CUTS
from edgewise.operators import align, decide, graph, metrics, pairs, resample, sampling, similar, splits
from edgewise.operators.graph import connected_components
from edgewise.sources import files


def plain_ap(scores, labels, weights):
    """Average precision at tie-group ends, written as a loop."""
    total, ap, tp, fp = sum(w for y, w in zip(labels, weights) if y), 0.0, 0.0, 0.0
    for s in sorted(set(scores), reverse=True):
        up = sum(w for x, y, w in zip(scores, labels, weights) if x == s and y)
        down = sum(w for x, y, w in zip(scores, labels, weights) if x == s and not y)
        tp, fp = tp + up, fp + down
        ap += up * tp / (tp + fp) if tp + fp else 0.0
    return ap / total if total else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1), st.integers(1, 4)), min_size=1, max_size=25))
def test_ap_matches_loop(spark, rows):
    df = spark.createDataFrame([(float(s), y, float(w)) for s, y, w in rows], "score double, y int, w double").withColumn("model", F.lit("m"))
    found = metrics.ap_auroc(df, ["model"], weight="w").first()
    if len({y for _, y, _ in rows}) < 2:
        assert found["ap"] is None and found["auroc"] is None
    else:
        s, y, w = zip(*rows)
        assert found["ap"] == pytest.approx(plain_ap(s, y, w))
        pos, neg = [(a, c) for a, b, c in rows if b], [(a, c) for a, b, c in rows if not b]
        area = sum(c * k * ((a > b) + (a == b) / 2) for a, c in pos for b, k in neg) / sum(c for _, c in pos) / sum(c for _, c in neg)
        assert found["auroc"] == pytest.approx(area)


def test_best_f1_takes_the_highest_threshold(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 1), (0.3, 0)], "score double, y int").withColumn("m", F.lit(1))
    best = metrics.best_f1(df, ["m"]).first()
    assert (best["threshold"], round(best["f1"], 6)) == (0.4, 0.8)


def test_gated_fusion_keeps_the_base_exactly_and_rejects_nan(spark):
    df = spark.createDataFrame([(0.1, 5.0, 0.0), (0.1, 5.0, 0.5)], "b double, e double, g double")
    out = [r[0] for r in df.select(pairs.gated_fusion(F.col("b"), F.col("e"), F.col("g"), 2.0)).collect()]
    assert out == [0.1, 0.1 + 2.0 * 0.5 * 5.0]
    bad = spark.createDataFrame([(0.1, float("nan"), 0.0)], "b double, e double, g double")
    with pytest.raises(Exception, match="not finite"):
        bad.select(pairs.gated_fusion(F.col("b"), F.col("e"), F.col("g"), 0.0)).collect()


def test_self_pairs_count_once(spark):
    df = spark.createDataFrame([("x", "x", 1), ("x", "z", 0), (None, "x", 1)], "a string, b string, y int")
    found = {r["entity"]: (r["pos"], r["neg"]) for r in pairs.entity_degrees(df).collect()}
    assert found["x"] == (2, 1) and found["z"] == (0, 1)


def test_alias_resolution(spark):
    names = spark.createDataFrame([("A",), ("q",), ("r",), ("zz",)], "name string")
    primary = spark.createDataFrame([("A",), ("B",)], "primary string")
    alias = spark.createDataFrame([("A", "B"), ("q", "B"), ("r", "A"), ("r", "B")], "alias string, primary string")
    found = {r["name"]: (r["status"], r["primary"]) for r in pairs.resolve_aliases(names, primary, alias).collect()}
    assert found == {"A": ("primary", "A"), "q": ("alias", "B"), "r": ("ambiguous", None), "zz": ("unresolved", None)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_match_union_find(spark, edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {x: find(x) for x in parent}


def test_long_chain_settles(spark):
    df = spark.range(0, 300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(df).select("component").distinct().collect()[0][0] == 0


def test_folds_keep_components_whole_and_balanced(spark):
    members = spark.createDataFrame([(i, i % 17) for i in range(200)], "entity long, component long")
    found = splits.least_loaded_folds(members, 4)
    assert found.groupBy("component").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    sizes = [r["count"] for r in found.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 24


def test_negatives_are_new_and_capped(spark):
    pos = spark.createDataFrame([(f"a{i % 30}", f"b{(i * 7) % 40}") for i in range(400)], "a string, b string").distinct()
    found = sampling.negative_candidates(pos, 2.0)
    keyed = pairs.canonical_pair(pos).select("lo", "hi")
    assert found.join(keyed, (F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi")), "left_semi").isEmpty()
    assert found.filter("a = b").isEmpty() and found.count() == found.distinct().count() > 100
    taken = sampling.degree_capped(found, pos, 1)
    room = {r["entity"]: r["pos"] for r in pairs.entity_degrees(pos.withColumn("y", F.lit(1))).collect()}
    used = taken.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").count().collect()
    assert taken.count() > 50 and all(r["count"] <= room[r["entity"]] for r in used)
    # Maximal: no candidate left could still be taken.
    load = {r["entity"]: r["count"] for r in used}
    rest = found.join(taken, ["a", "b"], "left_anti").collect()
    assert not [r for r in rest if load.get(r["a"], 0) < room.get(r["a"], 0) and load.get(r["b"], 0) < room.get(r["b"], 0)]


def test_capped_quartets(spark):
    q = spark.createDataFrame([(f"a{i}", f"b{j}", f"c{i}", f"d{j}") for i in range(8) for j in range(8)], "a string, b string, c string, d string")
    found = decide.capped_quartets(q, 3, 100)
    used = found.select(F.explode(F.array("a", "b", "c", "d")).alias("e")).groupBy("e").count().agg(F.max("count")).first()[0]
    assert used <= 3 and found.count() >= 15


def test_additive_scores_get_half_credit(spark):
    rng = np.random.default_rng(3)
    value = {x: float(v) for x, v in zip("abcdefgh", rng.normal(size=8))}
    blocs = spark.createDataFrame([(x, y, int((ord(x) + ord(y)) % 2)) for x in "abcd" for y in "efgh"], "a string, b string, y int")
    quartets = pairs.swap_quartets(blocs)
    scores = spark.createDataFrame([(x, y, value[x] + value[y]) for x in "abcd" for y in "efgh"], "a string, b string, score double")
    assert quartets.count() > 0 and {r["credit"] for r in decide.swap_credit(quartets, scores).collect()} == {0.5}


def test_shuffled_columns_keep_histograms(spark):
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame([(0, r, c, int(rng.integers(0, 4))) for r in range(20) for c in range(6)], "uid int, row long, col int, token int")
    count = lambda df: {(r["col"], r["token"]): r["count"] for r in df.groupBy("col", "token").count().collect()}
    assert count(align.shuffle_columns(cells, "s")) == count(cells)


def test_thinning_matches_a_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(u, r, [int(x) for x in rng.integers(0, 3, 12)]) for u in range(3) for r in range(15)]
    df = spark.createDataFrame(rows, "uid int, row long, tokens array<int>").withColumn("order", F.col("row"))
    found = {(r["uid"], r["row"]) for r in similar.thin_redundant(df, 0.6, 0.5, 8).collect()}
    wanted = set()
    for u in range(3):
        kept = []
        for uid, r, t in rows:
            if uid == u and len(kept) < 8 and not any(sum(a == b for a, b in zip(t, k)) >= 0.6 * 12 for k in kept):
                kept.append(t)
                wanted.add((u, r))
    assert found == wanted


def test_multinomial_draws_add_up(spark):
    entities = spark.range(50).select(F.col("id").cast("string").alias("entity"), F.col("id").alias("ix"))
    drawn = [r["mult"] for r in resample.multinomial_draws(entities, 4).collect()]
    assert np.array(drawn).sum(axis=0).tolist() == [50] * 4


def plain_curve(rows):
    """Weighted average precision and area, tie by tie."""
    tp = fp = ap = area = 0.0
    for score in sorted({s for s, _, _ in rows}, reverse=True):
        p, n = (sum(w for s, y, w in rows if s == score and y == one) for one in (1, 0))
        tp, fp = tp + p, fp + n
        ap += p * tp / (tp + fp) if tp + fp else 0.0
        area += n * (tp - p / 2)
    return ap / tp, area / tp / fp


@pytest.mark.parametrize("rows_of_range", [13, 10_000])
def test_replicates_match_a_loop(spark, monkeypatch, rows_of_range):
    """Several ranges of scores, small batches, ties over their borders."""
    monkeypatch.setattr(resample, "RANGE_ROWS", rows_of_range)
    rng = np.random.default_rng(6)
    rows = [("m" if i % 2 else "n", float(rng.integers(0, 12)), int(rng.integers(0, 2)), rng.integers(0, 3, 5).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "model string, score double, y int, weights array<int>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = resample.replicate_metrics(df, ["model"]).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 10
    for r in found:
        assert (r["ap"], r["auroc"]) == pytest.approx(plain_curve([(s, y, w[r["rep"]]) for m, s, y, w in rows if m == r["model"]]))


@pytest.mark.parametrize("hub_rows", [2, 10_000])
def test_star_components_match_union_find(spark, monkeypatch, hub_rows):
    """A hub in a third of all rows, paths, repeated and self edges, null ends."""
    monkeypatch.setattr(graph, "HUB_ROWS", hub_rows)
    monkeypatch.setattr(graph, "HUB_SHARE", 10)
    rng = np.random.default_rng(9)
    edges = [(f"h{i % 60}", "h9") for i in range(120)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(50)] + [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 150, (90, 2))] + [("alone", "alone")]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    frame = spark.createDataFrame([*edges, ("h1", None), (None, "q"), (None, None)], "src string, dst string")
    found, left = graph.star_components(frame)
    rows = found.collect()
    assert len(rows) == len(parent) and {r["node"]: r["component"] for r in rows} == {x: find(x) for x in parent}
    assert left[-1] == sum(find(x) != x for x in parent)


def test_star_components_of_a_long_path_take_few_rounds(spark):
    path = spark.range(2999).select((F.col("id") * 1237 % 3001).alias("src"), ((F.col("id") + 1) * 1237 % 3001).alias("dst"))
    found, left = graph.star_components(path)
    assert found.count() == 3000 and found.filter("component <> 0").isEmpty() and len(left) <= 14
    with pytest.raises(RuntimeError, match="settle"):
        graph.star_components(path, max_rounds=2)


def test_star_components_of_no_edges(spark):
    assert graph.star_components(spark.createDataFrame([], "src long, dst long"))[0].collect() == []


def hashed(key):
    return int(hashlib.sha256(key.encode()).hexdigest()[:15], 16)


def test_draws_match_a_loop(spark, monkeypatch):
    """Several blocks of places and pieces of a batch; names that are no ASCII; an entity that is never drawn has no row."""
    monkeypatch.setattr(resample, "BLOCK", 7)
    monkeypatch.setattr(resample, "CHUNK", 15)
    names = [f"é{i}" for i in range(40)]
    entities = spark.createDataFrame(list(zip(names, range(40))), "entity string, ix int")
    counts = np.zeros((40, 3), int)
    for rep in range(3):
        for ix in range(40):
            counts[hashed(f"boot:{rep}:{ix}") % 40, rep] += 1
    assert {r["entity"]: r["mult"] for r in resample.multinomial_draws(entities, 3).collect()} == {n: c.tolist() for n, c in zip(names, counts) if c.any()}
    poisson = {r["entity"]: r["mult"] for r in resample.poisson_draws(entities, 3).collect()}
    assert poisson == {n: [sum(hashed(f"poisson:{rep}:{n}") >= c for c in POISSON_CUTS) for rep in range(3)] for n in names}


def test_draws_of_empty_tables(spark):
    none = spark.createDataFrame([], "entity string, ix long")
    assert resample.multinomial_draws(none, 3).collect() == resample.poisson_draws(none, 3).collect() == []
    pairs = spark.createDataFrame([("a", "b", 0.5, 1)], "a string, b string, score double, y int")
    assert resample.replicate_metrics(resample.pair_weights(pairs, resample.poisson_draws(none, 3), ["score", "y"]), []).collect() == []


@pytest.mark.parametrize("weights", [[3, 0, 250], [3, 0, 60_000], [70_000, 1, 2]])
def test_packed_weights_are_read_back(weights):
    rows = np.array([weights, [0, 1, 2]])
    assert resample._weights(resample._packed(rows)).tolist() == rows.tolist()


def test_packed_weights_of_several_widths():
    mixed = pa.concat_arrays([resample._packed(np.array([[1, 2]])), resample._packed(np.array([[300, 2], [5, 6]])), resample._packed(np.array([[1 << 20, 9]]))])
    assert resample._weights(mixed).tolist() == [[1, 2], [300, 2], [5, 6], [1 << 20, 9]]
    assert resample._weights(mixed.slice(1, 2)).tolist() == [[300, 2], [5, 6]]
    assert resample._weights(mixed.slice(2)).tolist() == [[5, 6], [1 << 20, 9]]


@pytest.mark.parametrize("square", [False, True])
def test_weighted_pairs_match_a_loop(spark, square):
    """Drawn ends to metrics of each replicate: selves, ties and scores without ties, pairs whose ends are never drawn."""
    rng = np.random.default_rng(8)
    draws = {f"e{i}": rng.poisson(1, 4).tolist() for i in range(12)}
    pairs = [(f"e{rng.integers(14)}", f"e{rng.integers(14)}", float(rng.integers(0, 6)) if i % 2 else float(rng.random() * 6), int(rng.integers(0, 2))) for i in range(200)]
    table = spark.createDataFrame(list(draws.items()), "entity string, mult array<tinyint>")
    weighted = resample.pair_weights(spark.createDataFrame(pairs, "a string, b string, score double, y int"), table, ["score", "y"], square_self=square)
    found = resample.replicate_metrics(weighted, []).collect()
    assert len(found) == 4
    for r in found:
        k = r["rep"]
        rows = [(s, y, draws[a][k] * (1 if a == b and not square else draws[b][k])) for a, b, s, y in pairs if a in draws and b in draws]
        assert (r["ap"], r["auroc"]) == pytest.approx(plain_curve(rows))


def test_running_sums_and_percentiles_match_a_loop(spark):
    from edgewise.operators import metrics

    rng = np.random.default_rng(7)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, 200)]
    df = spark.createDataFrame(rows, "k string, v double")
    sums = metrics.running_sums(df.groupBy("k", "v").agg(F.count("*").alias("n")), ["k"], "v", ["n"]).collect()
    assert all(r["cum_n"] == sum(k == r["k"] and v <= r["v"] for k, v in rows) and r["all_n"] == 200 for r in sums)
    found = {r["k"]: (r["q"], r["m"]) for r in metrics.percentiles(df, ["k"], "v", {"q": 0.1, "m": 0.5}).collect()}
    assert found == {k: (pytest.approx(np.quantile([v for x, v in rows if x == k], 0.1)), pytest.approx(np.quantile([v for x, v in rows if x == k], 0.5))) for k in ("a", "b", None)}


def test_token_budget(spark):
    rows = spark.createDataFrame([(i, 1 + i % 30) for i in range(100)], "entity long, len int")
    batches = sampling.length_pool_batches(rows, "entity", "len", 16, "pool", batches=2)
    found = sampling.token_budget_batches(batches, "entity", "len", 60, 8).groupBy("pool", "batch", "micro").agg(F.max("len").alias("m"), F.count("*").alias("n"))
    assert found.filter("m * n > 60 AND n > 1 OR n > 8").isEmpty() and found.agg(F.sum("n")).first()[0] == 100


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">sp|P1|NAME extra\nAC\nDE\n>q2 words\nKK\n>q2\nKK\n")
    assert {(r["id"], r["seq"]) for r in files.read_fasta(spark, str(tmp_path / "x.fasta")).collect()} == {("P1", "ACDE"), ("q2", "KK")}
    (tmp_path / "y.fasta").write_text(">a\nAC\n>a\nAD\n")
    with pytest.raises(Exception, match="two sequences"):
        files.read_fasta(spark, str(tmp_path / "y.fasta")).collect()


def test_a3m(spark, tmp_path):
    (tmp_path / "one.a3m").write_text(">query\nACJD\n>k1 g:f:o:c:p\nAaC.-D\n>k2\nAC\n")
    found = {r["key"]: (r["aligned"], r["tax"], r["bad_length"]) for r in files.read_a3m(spark, str(tmp_path / "one.a3m")).collect()}
    assert found == {"query": ("ACXD", None, False), "k1": ("AC-D", "g:f:o:c:p", False), "k2": ("AC", None, True)}


def test_catalogue(spark, tmp_path):
    entry = {
        "primaryAccession": "P1", "secondaryAccessions": ["Q1"], "unused": 3,
        "uniProtKBCrossReferences": [{"database": "GO", "id": "GO:1", "properties": [{"key": "GoTerm", "value": "P:growth"}]}, {"database": "GO", "id": "GO:2", "properties": [{"key": "GoTerm", "value": "F:x"}]}],
        "comments": [{"commentType": "ALTERNATIVE PRODUCTS", "isoforms": [{"isoformSequenceStatus": "Displayed", "isoformIds": ["P1-1"]}, {"isoformSequenceStatus": "Described", "isoformIds": ["P1-2"]}]}, {"commentType": "OTHER"}],
    }
    (tmp_path / "c.json").write_text(json.dumps(entry) + "\n" + json.dumps({"primaryAccession": "P2"}) + "\n")
    found = {r["primary"]: (r["aliases"], r["annotations"], r["displayed"]) for r in files.read_catalogue(spark, str(tmp_path / "c.json")).collect()}
    assert found == {"P1": (["Q1"], ["GO:1"], ["P1-1"]), "P2": ([], [], [])}


def test_torn_last_line_is_dropped_and_others_are_errors(spark, tmp_path):
    log, schema = tmp_path / "log", "event string, update long"
    log.mkdir()
    (log / "one.jsonl").write_text('{"event": "a", "update": 1}\n{"event": "b", "upd')
    (log / "two.jsonl").write_text('{"event": "c", "update": 2}\n\n{"event": "d", "update": 3}\n')
    assert sorted(r["event"] for r in files.read_event_log(spark, str(log), schema).collect()) == ["a", "c", "d"]
    (log / "three.jsonl").write_text('{"event": "e", "upd\n{"event": "f", "update": 4}\n')
    with pytest.raises(Exception, match="before the last"):
        files.read_event_log(spark, str(log), schema).collect()


def test_publishing_is_whole_or_nothing(spark, tmp_path):
    path = f"{tmp_path}/table"
    manifest = files.write_with_manifest(spark.range(100), path, ["id"])
    assert manifest.agg(F.sum("rows")).first()[0] == 100 and spark.read.parquet(path).count() == 100
    with pytest.raises(FileExistsError):
        files.write_with_manifest(spark.range(5), path, ["id"])
    broken = spark.range(10).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        files.write_with_manifest(broken, f"{tmp_path}/other", ["id"])
    assert [p.name for p in tmp_path.iterdir() if "unpublished" not in p.name] == ["table"] and spark.read.parquet(path).count() == 100


def test_monitor_drops_late_rows(spark, tmp_path):
    """Third file: one row within the delay, one later than it. A batch drops rows by the watermark of the batch before it."""
    from datetime import datetime

    from edgewise.streaming import monitor

    kind = "user_id long, event_id long, value double, event_type string, ts timestamp"
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    first = [(0, 1, 1.0, "x", at(10, 0)), (0, 2, 3.0, "x", at(12, 5))]
    later = [(0, 3, 100.0, "x", at(10, 10)), (0, 4, 5.0, "x", at(11, 50)), (0, 5, 1.0, "x", at(15, 0))]
    for k, rows in enumerate((first, [(0, 7, 2.0, "x", at(12, 10))], later, [(0, 6, 1.0, "x", at(18, 0))], [(0, 8, 1.0, "x", at(20, 0))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    monitor.start_monitor(spark, stream, "1 hour", "30 minutes", f"{tmp_path}/out").awaitTermination()
    found = {r["window_start"].hour: (r["rows"], r["most"]) for r in spark.read.parquet(f"{tmp_path}/out/windows").collect()}
    assert found[10] == (1, 1.0) and found[11] == (1, 5.0) and found[12] == (2, 3.0)


def held_out_auroc(rows, score, label):
    rows = [(r[score], label[r["row_id"]]) for r in rows]
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)


def learning_table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        v = rng.normal(size=12)
        rows.append((i, v.tolist(), int(v[0] + 0.8 * v[1] - v[2] + 0.3 * rng.normal() > 0)))
    return spark.createDataFrame(rows, "row_id long, v array<double>, y int"), {i: y for i, _, y in rows}


def test_learned_heads_on_held_out_rows(spark):
    from edgewise.operators import learn

    df, label = learning_table(spark)
    train, held = df.filter("row_id % 4 <> 0"), df.filter("row_id % 4 = 0")
    scored = learn.score_head(learn.fit_head(train, components=12), held).collect()
    assert len(scored) == 100 and held_out_auroc(scored, "probability", label) > 0.95
    values = learn.boosted_values(train, held, trees=10, depth=3).collect()
    assert held_out_auroc(values, "value", label) > 0.85
    # Held-out labels never reach the fit.
    flipped = learn.score_head(learn.fit_head(train, components=12), held.withColumn("y", 1 - F.col("y"))).collect()
    assert [r["probability"] for r in flipped] == [r["probability"] for r in scored]


def test_composition_vector_matches_a_loop(spark):
    from edgewise.operators import features

    letters, texts = "ACDEFGHIKLMNPQRSTVWY", ["ACACX", "", None, "é日A", "W", "ACDEFGHIKLMNPQRSTVWY" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "entity long, seq string")
    for r in features.composition_vector(df).collect():
        t, v = texts[r["entity"]] or "", r["v"]
        assert len(v) == 422
        if not t:
            assert not any(v)
            continue
        assert v[0] == pytest.approx(math.log(len(t))) and v[421] == pytest.approx(sum(c not in letters for c in t) / len(t))
        assert v[1:21] == pytest.approx([t.count(c) / len(t) for c in letters])
        pairs = [sum(t[i : i + 2] == x + y for i in range(len(t) - 1)) / max(1, len(t) - 1) for x in letters for y in letters]
        assert v[21:421] == pytest.approx(pairs)


def test_baselines_tell_what_their_features_can(spark):
    """Labels that only the product of the ends tells, and labels that only their lengths tell."""
    from edgewise.operators import features, metrics

    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        u, v = rng.normal(size=4), rng.normal(size=4)
        rows.append((i, u.tolist(), v.tolist(), int(u[2] * v[2] > 0), int(u[0] + v[0] > 0)))
    df = spark.createDataFrame(rows, "i long, u array<double>, v array<double>, y int, z int")
    held = F.col("i") % 3 == 0
    auroc = lambda label: {r["baseline"]: r["auroc"] for r in metrics.ap_auroc(features.pair_baselines(df, held, label=label), ["baseline"]).collect()}
    found = auroc("y")
    assert found["constant"] == 0.5 and found["pair"] > 0.9 and found["additive"] < 0.65 and found["length only"] < 0.65
    assert auroc("z")["length only"] > 0.95


def test_cross_fitting_never_sees_its_fold(spark):
    from edgewise.operators import learn

    df, label = learning_table(spark)
    folds = df.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    found = {r["row_id"]: r["probability"] for r in learn.cross_fit(folds, 3, components=12).collect()}
    assert len(found) == 400 and held_out_auroc([{"row_id": k, "p": v} for k, v in found.items()], "p", label) > 0.95
    changed = folds.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r["row_id"]: r["probability"] for r in learn.cross_fit(changed, 3, components=12).collect()}
    assert all(again[k] == found[k] for k in found if k % 3 == 1) and any(again[k] != found[k] for k in found if k % 3 == 0)


def test_log_sigmoid_is_stable(spark):
    from edgewise.functions.expressions import log_sigmoid

    found = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(log_sigmoid(F.col("x"))).collect()]
    assert found == [-800.0, pytest.approx(-math.log(2)), 0.0]


def test_weights_are_not_shuffled_by_pairs(spark):
    """Neither pairs nor rows are joined with draws one by one."""
    draws = spark.createDataFrame([(f"e{i}", [1, i % 3]) for i in range(20)], "entity string, mult array<tinyint>")
    pairs = spark.createDataFrame([(f"e{i % 25}", f"e{i % 7}", i) for i in range(300)], "a string, b string, k int")
    weighted = resample.pair_weights(pairs, draws, ["k"])
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {r["k"]: resample._weights(pa.array([bytes(r["weights"])], pa.binary()))[0].tolist() for r in weighted.collect()} == {
        i: [1, (i % 25 % 3) * (i % 7 % 3) if i % 25 != i % 7 else i % 7 % 3] for i in range(300) if i % 25 < 20
    }
    rows = spark.createDataFrame([(i, f"e{i % 25}", f"e{i % 7}") for i in range(300)], "row_id long, x string, y string")
    each = resample.component_weights(rows, draws, ["x", "y"])
    assert "row_id" not in "".join(line for line in each._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_list" in line)
    assert {r["row_id"]: r["weights"] for r in each.collect()} == {i: [1, (i % 25 % 3) * (i % 7 % 3) if i % 25 != i % 7 else i % 7 % 3] for i in range(300) if i % 25 < 20}
