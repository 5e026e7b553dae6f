"""Queries and operators that must not leave part of the job out."""

import hashlib
import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewise.functions.shared import shared_dir
from edgewise.operators import align, decide, sampling, similar, splits
from edgewise.operators.graph import connected_components
from edgewise.plans import fixtures, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def roots(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_all_components_take_every_line_and_entity(spark):
    line, supplier, part = (fixtures.table(spark, DATA, n).toPandas() for n in ("lineitem", "supplier", "part"))
    nodes = [*supplier["s_suppkey"].tolist(), *(100000000 + part["p_partkey"]).tolist()]
    edges = list(zip(line["l_suppkey"].tolist(), (100000000 + line["l_partkey"]).tolist()))
    for _, keys in [*supplier.groupby("s_nationkey")["s_suppkey"], *(100000000 + part["p_partkey"]).groupby(part["p_brand"])]:
        edges += [(keys.iloc[0], k) for k in keys.tolist()]
    found = {r["node"]: r["component"] for r in registry.queries()["c1_all_components"](spark, DATA).collect()}
    assert found == roots(nodes, edges)


def test_isolated_entities_and_their_pairs_stay(spark):
    entities = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y"), (6, None)], "entity long, family string")
    hits = spark.createDataFrame([(3, 4), (5, 5)], "q long, t long")
    members = splits.with_components(entities, connected_components(splits.must_link_edges(entities, hits)))
    assert {r["entity"]: r["component"] for r in members.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    pairs = spark.createDataFrame([(a, b) for a in range(1, 7) for b in range(1, 7)], "a long, b long")
    assert splits.pair_roles(pairs, splits.least_loaded_folds(members, 2)).count() == 36


@pytest.mark.parametrize(("name", "times"), [("c3_all_pair_roles", 1), ("c4_all_fold_membership", 4), ("c5_all_stratified_folds", 1), ("c3_pair_roles", 1), ("c3_hash_order_sides", 1), ("c4_fold_membership", 4)])
def test_folds_take_every_line(spark, name, times):
    found = registry.queries()[name](spark, DATA).agg(F.sum("rows")).first()[0]
    assert found == times * fixtures.table(spark, DATA, "lineitem").count()


@pytest.mark.parametrize("block", [7, 1024])
def test_seeds_that_all_sequences_share_stay(spark, block):
    rows = [(r, [1, 1, 1, 1, 1, r % 3, r % 7, r % 2]) for r in range(70)]
    patterns = ["11011", "101101"]
    found = align.seed_matches(spark.createDataFrame(rows, "row long, tokens array<int>"), patterns, block=block).collect()
    wanted = set()
    for pattern in patterns:
        on = [i for i, x in enumerate(pattern) if x == "1"]
        places = range(8 - len(pattern) + 1)
        wanted |= {(p, q, a, b) for p, s in rows for q, t in rows if p < q for a in places for b in places if all(s[a + i] == t[b + i] for i in on)}
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == wanted


def left_over(quartets, taken, cap):
    load = {}
    for q in taken:
        for e in q:
            load[e] = load.get(e, 0) + 1
    assert max(load.values()) <= cap
    return [q for q in quartets if q not in taken and all(load.get(e, 0) < cap for e in q)]


def chain(n):
    """Quartets of one per round: each shares a member with the one before it in hash order."""
    from hashlib import sha256

    draw = lambda q: int(sha256(":".join(("quartet", *q)).encode()).hexdigest()[:15], 16)
    found, last, low = [], "e0", -1
    for i in range(n):
        q, low = next((q, h) for j in range(100000) if low < (h := draw(q := (last, f"b{i}-{j}", f"c{i}", f"e{i + 1}"))) < (i + 1) << 60 - 6)
        found, last = [*found, q], q[3]
    return found


def test_quartets_are_taken_until_none_fits(spark):
    quartets = chain(40)
    df = spark.createDataFrame(quartets, "a string, b string, c string, d string")
    taken = {tuple(r) for r in decide.capped_quartets(df, 1, 1000).collect()}
    # Every second quartet of the chain, one a round.
    assert taken == set(quartets[::2]) and not left_over(quartets, taken, 1)


def test_quartets_keep_edge_caps(spark):
    quartets = [(f"a{i}", f"b{i}", f"c{j}", f"d{j}") for i in range(6) for j in range(6)]
    df = spark.createDataFrame(quartets, "a string, b string, c string, d string")
    taken = [tuple(r) for r in decide.capped_quartets(df, 5, 1000, edge_cap=2).collect()]
    load = Counter(e for a, b, c, d in taken for e in ((a, b), (c, d)))
    assert max(load.values()) == 2 and not [q for q in quartets if q not in taken and load[q[:2]] < 2 and load[q[2:]] < 2]


def one_pass(rows, salt, keys, caps):
    """Rows in hash order, each taken while all its keys have room."""
    used, taken = Counter(), []
    for r in sorted(rows, key=lambda r: int(hashlib.sha256(":".join([salt, *r]).encode()).hexdigest()[:15], 16)):
        if all(used[k] < caps(k) for k in keys(r)):
            taken.append(r)
            used.update(keys(r))
    return taken


@pytest.fixture(scope="module")
def crowded():
    """Candidates between few ends, one of them in a third of all rows; some ends have no room."""
    pool = {(f"x{i % 13}", f"z{i % 11}") for i in range(110)} | {("hub", f"z{i}") for i in range(45)}
    room = {**{f"x{i}": i % 5 for i in range(13)}, **{f"z{i}": 1 + i % 4 for i in range(40)}, "hub": 9}
    return sorted(pool), room


@pytest.mark.parametrize("target", [1, 7, 14, None])
def test_capped_pairs_are_the_first_of_one_pass(spark, crowded, target):
    pool, room = crowded
    taken = one_pass(pool, "cap", lambda r: r, lambda e: room.get(e, 0))
    assert len(taken) > 20
    positives = [(e, f"{e}+{i}") for e, n in room.items() for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    found = sampling.degree_capped(frame(pool), frame(positives), 1, target=target or len(taken))
    assert {tuple(r) for r in found.collect()} == set(taken[:target])


@pytest.mark.parametrize("most", [5, 1000])
def test_capped_quartets_are_the_first_of_one_pass(spark, most):
    rows = sorted({(f"a{i % 5}", f"b{i % 7}", f"c{i % 6}", f"d{i % 11}") for i in range(150)})
    keys = lambda q: {*q, q[:2], q[2:]}
    wanted = one_pass(rows, "quartet", keys, lambda k: 2 if isinstance(k, tuple) else 6)
    found = decide.capped_quartets(spark.createDataFrame(rows, "a string, b string, c string, d string"), 6, most, edge_cap=2)
    assert len(wanted) > 8 and {tuple(r) for r in found.collect()} == set(wanted[:most])


def test_rounds_beyond_a_bound_raise(spark):
    quartets = spark.createDataFrame(chain(12), "a string, b string, c string, d string")
    with pytest.raises(RuntimeError, match="settle"):
        decide.capped_quartets(quartets, 1, 1000, max_rounds=2)
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    with pytest.raises(RuntimeError, match="settle"):
        sampling.degree_capped(pairs, pairs, 1, max_rounds=0)


def test_joint_support_is_summed_over_blocks(spark):
    rng = np.random.default_rng(5)
    tokens = rng.integers(20, 28, (90, 9))
    df = spark.createDataFrame([(i % 2, i, t.tolist()) for i, t in enumerate(tokens)], "uid int, row long, tokens array<int>")
    found = {r["uid"]: r for r in similar.joint_support(df, 18).collect()}
    for uid in (0, 1):
        full = (tokens[uid::2] < align.GAP).astype(int)
        upper = (full.T @ full)[np.triu_indices(9, 1)]
        assert [found[uid][c] for c in ("mean_support", "enough", "half")] == pytest.approx([upper.mean(), (upper >= 18).mean(), (upper >= 45 / 2).mean()])


def in_turn(sizes, folds):
    """Fold of each (size, key), in the order given, by the least load."""
    loads, out = [0] * folds, {}
    for size, key in sizes:
        k = loads.index(min(loads))
        loads[k] += size
        out[key] = k
    return out, loads


@pytest.mark.parametrize(("sizes", "folds"), [([1] * 50, 4), ([40, 1, 1, 1] + [2] * 9, 3), ([7, 7, 7, 5, 5, 3, 3, 3, 3, 1] * 4, 5), ([100] + [3] * 60 + [1] * 10, 4)])
def test_folds_are_dealt_in_turn(spark, monkeypatch, sizes, folds):
    """Against one component after the other; ranks come from several small blocks."""
    from hashlib import sha256

    monkeypatch.setattr(splits, "RANK_BLOCK", 4)
    members = spark.createDataFrame([(f"{k}-{i}", k) for k, n in enumerate(sizes) for i in range(n)], "entity string, component long")
    found = {r["component"]: r["fold"] for r in splits.least_loaded_folds(members, folds).collect()}
    order = sorted((-n, int(sha256(f"fold:{k}".encode()).hexdigest()[:15], 16), k) for k, n in enumerate(sizes))
    assert found == in_turn([(-n, k) for n, _, k in order], folds)[0]


def test_stratified_folds_are_alike_in_each_label(spark):
    rows = [(f"g{i}", int(i % 5 == 0)) for i in range(200) for _ in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "component string, y int")
    found = splits.least_loaded_folds(df, 4, stratum="y")
    sizes = {(r["y"], r["fold"]): r["count"] for r in found.groupBy("y", "fold").count().collect()}
    assert len(sizes) == 8 and all(max(v) - min(v) <= 1 for v in ([sizes[y, f] for f in range(4)] for y in (0, 1)))
    assert found.groupBy("component").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(ValueError, match="two values"):
        splits.least_loaded_folds(df.union(spark.createDataFrame([("g0", 0)], df.schema)), 4, stratum="y")


def test_negative_pool_reaches_its_target(spark):
    positives = spark.createDataFrame([(f"a{i % 30}", f"b{(i * 7) % 40}") for i in range(400)], "a string, b string").distinct()
    n = positives.count()
    notes = spark.createDataFrame([(f"a{i}", ["x"] if i < 3 else [f"own{i}"]) for i in range(30)] + [(f"b{i}", ["x"] if i < 2 else None) for i in range(40)], "entity string, annots array<string>")
    found = sampling.negative_candidates(positives, 4.0, annotations=notes).collect()
    assert len({tuple(r) for r in found}) == len(found) == 4 * n
    half = spark.createDataFrame([(f"a{i}", ["x"] if i < 15 else [f"own{i}"]) for i in range(30)] + [(f"b{i}", ["x"] if i < 20 else None) for i in range(40)], "entity string, annots array<string>")
    few = sampling.negative_candidates(positives, 0.1, annotations=half).collect()
    group = {*(f"a{i}" for i in range(15)), *(f"b{i}" for i in range(20))}
    assert len(few) == round(0.1 * n) and all(r["a"] in group and r["b"] in group for r in few)
    triangle = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    assert {tuple(r) for r in sampling.negative_candidates(triangle, 9.0).collect()} == {("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}
    with pytest.raises(RuntimeError, match="wanted"):
        sampling.negative_candidates(positives, 4.0, max_rounds=0)
    pool = sampling.negative_candidates(positives, 4.0)
    assert sampling.degree_capped(pool, positives, 6, target=n).count() == n
    with pytest.raises(ValueError, match="fit the caps"):
        sampling.degree_capped(pool.limit(5), positives, 6, target=n)


def test_negatives_broadcast_no_pairs(spark):
    """A table of pairs that a driver can't hold is never collected there."""
    positives = spark.range(60_000).selectExpr("concat('a', id % 300) AS a", "concat('b', id div 300) AS b")
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        pool = sampling.negative_candidates(positives, 0.5)
        assert pool.count() == 30_000
        assert sampling.degree_capped(pool, positives, 2).count() > 0
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def tables(spark, name):
    """Tables of that name in the shared folder."""
    return set(Path(shared_dir(spark).removeprefix("file:")).glob(f"edgewise-*/{name}"))


def test_negatives_leave_one_table(spark):
    """Positives and forbidden pairs are deleted when the pool is full, the pool when annotations have ordered it."""
    positives = spark.range(900).selectExpr("concat('a', id % 30) AS a", "concat('b', id % 37) AS b").distinct()
    notes = spark.range(30).selectExpr("concat('a', id) AS entity", "array('x') AS annots")
    names = ("positives", "forbidden", "pool", "told")
    before = {n: tables(spark, n) for n in names}
    assert sampling.negative_candidates(positives, 0.5, annotations=notes).count() == round(0.5 * positives.count())
    assert {n: len(tables(spark, n) - before[n]) for n in names} == {"positives": 0, "forbidden": 0, "pool": 0, "told": 1}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_capped_negatives_rank_a_stretch_of_the_order(spark):
    """With a target, far candidates aren't ranked; where caps bind early, later stretches are."""
    pool = [(f"x{a}", f"y{b}") for a in range(60) for b in range(60)]
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    positives = [(f"x{a}", f"y{a}") for a in range(60)]
    for cap, target, most in ((20, 300, 800), (2, 110, 10_000)):
        room, taken = {e: cap for p in positives for e in p}, []
        for a, b in sorted(pool, key=lambda r: (int(hashlib.sha256(f"cap:{r[0]}:{r[1]}".encode()).hexdigest()[:15], 16), r)):
            if room[a] and room[b]:
                room[a], room[b] = room[a] - 1, room[b] - 1
                taken.append((a, b))
        before = tables(spark, "round")
        found = sampling.degree_capped(frame(pool), frame(positives), cap, target=target)
        assert {tuple(r) for r in found.collect()} == set(taken[:target]) and len(taken) > target
        assert sum(spark.read.parquet(str(x)).count() for x in tables(spark, "round") - before) < most


@pytest.mark.parametrize("spread", [1 << 58, 1 << 20, 3])
def test_hash_cuts(spark, spread):
    """Hashes all over, within one slice, and tied."""
    rng = np.random.default_rng(5)
    hashes = sorted(rng.integers(0, spread, 300).tolist())
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    for k in (0, 1, 120, 299, 300, 400):
        wanted = max((n for n in range(min(k, 300) + 1) if n in (0, 300) or hashes[n] != hashes[n - 1]), default=0)
        assert sampling.first_by_hash(df, k).count() == wanted
