"""Operators whose plain form is a loop or a product, against that form on tables where shortcuts would show."""

import random
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewise.operators import align, pairs, similar, splits
from edgewise.plans import registry

GAP = align.GAP


def kept_in_turn(tokens, identity, coverage):
    """The plain greedy loop over rows in order."""
    kept = np.zeros((len(tokens), tokens.shape[1]), dtype=tokens.dtype)
    places = []
    for k, t in enumerate(tokens):
        have, full = kept[: len(places)], t < GAP
        both = (have < GAP) & full
        n, same = both.sum(axis=1), ((have == t) & both).sum(axis=1)
        if not ((n >= coverage * max(1, full.sum())) & (same >= identity * np.maximum(n, 1))).any():
            kept[len(places)] = t
            places.append(k)
    return places


def test_thinning_of_twenty_thousand_rows(spark):
    """One alignment, 70 columns (two words), gaps, padding and rows without letters; no cap."""
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 25, (400, 70))[rng.integers(0, 400, 20_000)]
    tokens = np.where(rng.random(tokens.shape) < 0.07, rng.integers(0, 25, tokens.shape), tokens)
    tokens = np.where(rng.random(tokens.shape) < 0.2, GAP + rng.integers(0, 2, tokens.shape), tokens)
    tokens[[5, 900]] = GAP
    order = rng.permutation(20_000)
    df = spark.createDataFrame([(1, i, int(order[i]), t) for i, t in enumerate(tokens.tolist())], "uid int, row long, order long, tokens array<int>")
    found = {r["place"]: r["row"] for r in similar.thin_redundant(df, 0.85, 0.7).collect()}
    in_order = np.argsort(order)
    wanted = [int(in_order[k]) for k in kept_in_turn(tokens[in_order], 0.85, 0.7)]
    assert [found[k] for k in range(len(found))] == wanted and 400 < len(wanted) < 15_000
    some = similar.thin_redundant(df, 0.85, 0.7, cap=300).collect()
    assert sorted((r["place"], r["row"]) for r in some) == list(enumerate(wanted[:300]))


def test_thinning_rules_and_chains(spark):
    """A chain alike in order, ties of order, alignments left out, a null alignment; no rows."""
    chain = [[*range(k), *[20] * (12 - k)] for k in range(7)]
    rows = [(1, k, k // 2, t) for k, t in enumerate(chain)] + [(2, 0, 0, [1, 2, 3]), (None, 0, 0, [1, 2, 3]), (None, 1, 1, [1, 2, 3])]
    df = spark.createDataFrame(rows, "uid int, row long, order long, tokens array<int>")
    listed = lambda **more: sorted((str(r["uid"]), r["row"]) for r in similar.thin_redundant(df, 0.9, 0.5, block=3, **more).collect())
    wanted = [("1", k) for k in kept_in_turn(np.array(chain), 0.9, 0.5)]
    assert listed() == sorted([*wanted, ("2", 0), ("None", 0)])
    assert listed(least=2) == sorted(wanted) and listed(cap=1, least=2) == [] and len(listed(most=1)) == 3
    assert similar.thin_redundant(df.limit(0), 0.9, 0.5).isEmpty() and similar.effective_depth(df.limit(0), 0.9, 0.5).isEmpty()


@pytest.mark.parametrize("block", [16, 2048])
def test_effective_depth_of_wide_rows(spark, block):
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 4, (20, 150))[rng.integers(0, 20, 120)]
    tokens = np.where(rng.random(tokens.shape) < 0.2, rng.integers(22, 27, tokens.shape), tokens)
    df = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(tokens.tolist())], "uid int, row long, tokens array<int>")
    for r in similar.effective_depth(df, 0.7, 0.6, block).collect():
        own = tokens[r["uid"] :: 2]
        both = (own < GAP).astype(int) @ (own < GAP).T.astype(int)
        same = ((own[:, None] == own[None]) & (own[:, None] < GAP)).sum(axis=2)
        comparable = both >= 0.6 * np.maximum((own < GAP).sum(axis=1), 1)[:, None]
        related = (comparable & (same >= 0.7 * np.maximum(both, 1))) | np.eye(len(own), dtype=bool)
        assert (r["rows"], r["neff"], r["comparable"]) == (60, pytest.approx((1 / related.sum(axis=1)).sum()), pytest.approx(comparable.mean()))


def test_segments_need_no_matches(spark):
    """The same segments as from all matches, over a seed value that every sequence repeats."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(0, 3, 24).tolist()) for k in range(25)] + [(100 + k, [1] * 20) for k in range(6)] + [(200, [1, 2])]
    df = spark.createDataFrame(rows, "row long, tokens array<int>")
    score = lambda x, y: F.when(x == y, 2).otherwise(-1)
    patterns = ["1101", "1011"]
    listed = lambda f: sorted(tuple(r) for r in f.select("p", "q", "diagonal", "p_start", "p_end", "best").collect())
    wanted = listed(align.scored_segments(align.seed_matches(df, patterns), df, score, 6, 9))
    assert listed(align.seeded_segments(df, patterns, score, 6, 9, block=5)) == wanted and len(wanted) > 100


def plain_quartets(rows):
    label = {(a, b): y for a, b, y in rows}
    positive = [p for p, y in label.items() if y == 1]
    return sorted((a, b, c, d) for a, b in positive for c, d in positive if a < c and b != d and label.get((a, d)) == 0 and label.get((c, b)) == 0)


def test_quartets_match_a_loop(spark):
    rng = random.Random(6)
    rows = [(f"x{a}", f"x{b}", rng.randint(0, 1)) for a in range(14) for b in range(11) if rng.random() < 0.7]
    rows += [("hub", f"x{b}", b % 2) for b in range(40)] + [(f"x{a}", "hub", a % 2) for a in range(40)]
    found = sorted(tuple(r) for r in pairs.swap_quartets(spark.createDataFrame(rows, "a string, b string, y int")).collect())
    assert found == plain_quartets(rows) and len(found) > 100


def test_a_hub_of_fifty_thousand_pairs(spark):
    """A hub's pairs aren't multiplied with one another: paths stay below the pairs."""
    hub = spark.range(50_000).select(F.lit("hub").alias("a"), F.concat(F.lit("s"), F.col("id")).alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    few = spark.createDataFrame([("c", "s0", 1), ("c", "s1", 0), ("c", "s2", 0), ("d", "s3", 1)], "a string, b string, y int")
    rows = hub.union(few)
    assert pairs.light_wedges(rows).count() < 50_004
    found = {tuple(r) for r in pairs.swap_quartets(rows).collect()}
    assert found == {("c", "s0", "hub", "s1")}


def sides_in_turn(order):
    loads, out = [0, 0], {}
    for key, size in order:
        k = int(loads[1] < loads[0])
        loads[k] += size
        out[key] = k
    return out


@pytest.mark.parametrize("kind", ["many", "large", "one", "none"])
def test_sides_of_components_in_hash_order(spark, kind):
    """A hundred thousand components; some over the table's reach; one that outweighs all others."""
    rng = random.Random(7)
    sizes = {"many": [rng.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(100_000)], "large": [rng.choice([1, 2, 5, 9, 60, 700]) for _ in range(900)], "one": [1] * 300 + [5000] + [3] * 300, "none": []}[kind]
    rows = spark.createDataFrame(list(enumerate(sizes)), "component long, size int")
    members = rows.select("component", F.explode(F.sequence(F.lit(1), "size")).alias("entity"))
    found = {r["component"]: (r["side"], r["n"]) for r in splits.hash_order_sides(members, rows=5000 if kind == "many" else 100, large=64).groupBy("component", "side").agg(F.count("*").alias("n")).collect()}
    draw = {r["component"]: r["h"] for r in rows.select("component", splits.hash_draw(F.concat_ws(":", F.lit("side"), F.col("component").cast("string"))).alias("h")).collect()}
    wanted = sides_in_turn(sorted(enumerate(sizes), key=lambda x: (draw[x[0]], x[0])))
    assert {k: s for k, (s, _) in found.items()} == wanted and Counter({k: n for k, (_, n) in found.items()}) == Counter(dict(enumerate(sizes)))


def repeated_rows(spark):
    """Random rows, rows that repeat one seed value, rows of several lengths, one too short."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(0, 4, 12 + k % 9).tolist()) for k in range(40)] + [(100 + k, [1] * 15) for k in range(8)] + [(200, [1, 2])]
    return spark.createDataFrame(rows, "row long, tokens array<int>")


def shuffled_matches(df):
    """Whether a plan shuffles or sorts pairs of sequences."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("Exchange hashpartitioning(p" in line for line in plan.splitlines())


@pytest.mark.parametrize("piece", [50, 1_000_000])
def test_segments_are_merged_where_blocks_meet(spark, monkeypatch, piece):
    """No list of matches is shuffled; the segments are those of all matches, in pieces too."""
    monkeypatch.setattr(align, "PIECE", piece)
    df, patterns = repeated_rows(spark), ["11011", "101101"]
    matches = align.seed_matches(df, patterns, block=7)
    listed = lambda f: sorted(tuple(r) for r in f.select("p", "q", "diagonal", "p_start", "p_end", "seeds").collect())
    found = align.diagonal_segments(df, patterns, 6, block=7)
    assert listed(found) == listed(align.extend_diagonals(matches, 6)) and found.count() > 100
    assert not shuffled_matches(matches) and not shuffled_matches(found)


@pytest.mark.parametrize("most", [1, 3, 40])
def test_trimmed_segments_need_few_matches(spark, most):
    df, patterns = repeated_rows(spark), ["1101", "1011"]
    listed = lambda f: sorted(tuple(r) for r in f.select("p", "q", "diagonal", "start", "end").collect())
    wanted = listed(align.trim_positions(align.extend_diagonals(align.seed_matches(df, patterns), 4), most))
    assert listed(align.trimmed_segments(df, patterns, 4, most)) == wanted and len(wanted) >= 10


def test_scores_of_many_letters(spark, monkeypatch):
    monkeypatch.setattr(align, "LETTERS", 2)
    test_segments_need_no_matches(spark)


def test_rows_of_many_lengths_and_letters(spark, monkeypatch):
    """Rows shorter than a pattern beside long ones, seeds beyond 64 bits, repeated rows; matches and segments by loops."""
    rng = np.random.default_rng(9)
    base = rng.integers(-40_000, 40_000, 60).tolist()
    tokens = [base[a : a + int(n)] for a, n in zip(rng.integers(0, 20, 40), rng.integers(3, 40, 40))] + [base[5:40], base[5:40], base[:9]]
    df = spark.createDataFrame(list(enumerate(tokens)), "row long, tokens array<int>")
    patterns, wanted = ["1111111", "110011", "1001"], set()
    for pattern in patterns:
        on = [i for i, x in enumerate(pattern) if x == "1"]
        for (p, s), (q, t) in combinations(list(enumerate(tokens)), 2):
            wanted |= {(p, q, a, b) for a in range(len(s) - len(pattern) + 1) for b in range(len(t) - len(pattern) + 1) if all(s[a + i] == t[b + i] for i in on)}
    for piece in (7, 1_000_000):
        monkeypatch.setattr(align, "PIECE", piece)
        found = [tuple(r) for r in align.seed_matches(df, patterns, block=9).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted and len(found) > 1000
    score = lambda x, y: F.when(x == y, 2).otherwise(-1)
    listed = lambda f: sorted(tuple(r) for r in f.select("p", "q", "diagonal", "p_start", "p_end", "best").collect())
    assert listed(align.seeded_segments(df, patterns, score, 5, 7, block=9)) == listed(align.scored_segments(align.seed_matches(df, patterns), df, score, 5, 7))
    assert align.seed_matches(df.limit(0), patterns).isEmpty()


def test_large_blocks_of_narrow_tokens_are_dealt(spark):
    """A row crosses the network once a block: 70,000 rows make 16 blocks, so 136 pairs of blocks, and letters are single bytes."""
    rows = spark.range(70_000).select(F.col("id").alias("row"), F.array(F.lit(1), (F.col("id") % 20).cast("int"), F.lit(-3)).alias("tokens"))
    plan = align.seed_matches(rows, ["111"])._jdf.queryExecution().toString()
    assert "array<tinyint>" in plan and "], 136" in plan


def test_verdicts_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Suppliers with the same discounts, of a mean at a limit, in several orders."""
    rng = np.random.default_rng(1)
    cents = [1, 9, 3, 7, 2, 8, 4, 6, 0, 10] * 9 + [6] * 10  # 510 over 100 rows: a mean of 0.051
    rows = [(s, c / 100) for s in range(200) for c in rng.permutation(cents).tolist()]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["e3_interval_verdict"](spark, str(tmp_path))
    assert found.count() == 200 and found.select("verdict").distinct().count() == 1


def test_verdicts_of_means_at_the_limits(spark, tmp_path):
    """Means of exactly 0.047, 0.051 and 0.052 over 10 to 900 rows; groups of nulls, NaN and infinities as in SQL."""
    rows, wanted = [], {}
    for limit, verdict in ((47, "open"), (51, "open"), (52, "not inferior")):
        for n in range(10, 901, 10):
            s = limit * 1000 + n
            wanted[s] = verdict
            low, more = divmod(limit * n // 10, n)
            rows += [(s, (low + (i < more)) / 100) for i in range(n)]
    rows += [(1, None), (1, None), (2, float("nan")), (2, 0.05), (3, float("-inf")), (3, 0.1), (4, 1e300), (5, 0.06), (5, None), (6, 0.0), (6, 0.01)]
    spark.createDataFrame(rows, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["s"]: r["verdict"] for r in registry.queries()["e3_interval_verdict"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    sql = dict(con.execute(registry.oracle_sql()["e3_interval_verdict"]).fetchall())
    assert found == wanted | {s: sql[s] for s in range(1, 7)}


@pytest.mark.parametrize(("loads", "size"), [([0, 0, 0], 1), ([5, 0, 3, 3], 2), ([100, 1, 7], 3), ([4, 4], 9), ([6], 2), ([9, 2, 0, 40, 2], 4)])
def test_turns_of_folds_match_a_loop(loads, size):
    turns, now = splits._turns(loads, size), list(loads)
    for rank in range(200):
        start, folds = [t for t in turns if t[0] <= rank][-1]
        k = now.index(min(now))
        now[k] += size
        assert folds[(rank - start) % len(folds)] == k
