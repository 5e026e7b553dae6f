"""Graph neighbours, token alignment and whitening against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgewise.llm import alignment, neighbours, queries, whitening
from edgewise.llm.tokens import tokenizer_path

DATA = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


# 11 neighbours


def plain_neighbours(rows, k):
    """{query: [(id, score)]} of all rows by brute force; rows: {id: vector}."""
    out = {}
    for q in rows:
        if q % 20 == 0:
            scored = sorted(((float(np.dot(rows[q], rows[c])), c) for c in rows if c != q), key=lambda x: (-round(x[0], 9), x[1]))
            out[q] = scored[:k]
    return out


def found_lists(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores_on_the_table(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found, wanted, hit, total = found_lists(queries.op11_graph_neighbours(spark, DATA)), plain_neighbours(rows, 20), 0, 0
    assert set(found) == set(wanted)
    for q, near in wanted.items():
        assert len(found[q]) == 20 and q not in dict(found[q])
        for c, s in found[q]:
            assert s == pytest.approx(float(np.dot(rows[q], rows[c])), abs=1e-12)
        hit += len({c for c, _ in found[q]} & {c for _, c in near})
        total += 20
    assert hit / total >= 0.95


def test_recall_of_lengths_shards_and_clusters(spark, monkeypatch):
    """Vectors of uneven length in tight clusters, dealt to several shards."""
    monkeypatch.setattr(neighbours, "SHARD_LEAST", 300)
    monkeypatch.setattr(neighbours, "SHARD_FACTOR", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 24))) * rng.uniform(0.2, 3, size=(1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, wanted = found_lists(neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0)), plain_neighbours(dict(enumerate(x)), 20)
    assert sum(len({c for c, _ in found[q]} & {c for _, c in wanted[q]}) for q in wanted) / (20 * len(wanted)) >= 0.95


def test_neighbour_edges(spark):
    """Unusable vectors, ties, repeated rows, large groups of copies, few candidates, two lengths, clashing columns."""
    nan, inf = math.nan, math.inf
    rows = [(k, [1.0, 2.0]) for k in range(100, 170)] + [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 3.0]), (1, [5.0, 0.0])]
    rows += [(2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [9.0, 9.0]), (40, [0.0, 0.0]), (60, [1.0, 1.0, 1.0]), (61, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("vector", "dim", "shard", "node", "score", "rank", "query_id")})
    found = found_lists(neighbours.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert set(found) == {0, 20, 60, 100, 120, 140, 160}
    assert found[60] == [(61, 1.0)]
    assert found[0] == [(1, 5.0), *[(k, 1.0) for k in range(100, 119)]]
    assert found[20] == [(k, 6.0) for k in range(100, 120)]
    assert found[120] == [(20, 6.0), *[(k, 5.0) for k in [1, *range(100, 118)]]]
    assert neighbours.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()
    assert found_lists(neighbours.nearest_neighbours(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0)) == {}


def test_pruning_keeps_diverse_edges():
    """Of three points in one direction the nearest is kept; one elsewhere as well."""
    points = neighbours.on_sphere(np.array([[1.0, 0, 0], [1, 0.1, 0], [1, 0.12, 0], [1, 0.14, 0], [1, -0.3, 0.1], [0.5, 0, 0]]))
    kept = neighbours.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, -1, 1]]), 4, 1.2)
    assert kept.tolist() == [[1, 4, -1, -1]]


# 12 alignment


def plain_tokens(text):
    tools = alignment.two_tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    if not text:
        return [], []
    a, b, data = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text), (" " + text).encode()
    same = all(b"".join(t[k] for k in ids) == data for t, ids in ((tools.bytes_a, a), (tools.bytes_b, b)))
    return ([(k, tools.bytes_a[k]) for k in a], [(k, tools.bytes_b[k]) for k in b]) if same else ([], [])


def plain_alignment(texts):
    """Per text groups and links, by bytes one at a time."""
    out = []
    for text in texts:
        a, b = plain_tokens(text)
        owner_a, owner_b = [i for i, (_, x) in enumerate(a) for _ in x], [j for j, (_, x) in enumerate(b) for _ in x]
        links = set(zip(owner_a, owner_b, strict=True))
        groups, now = [], ([], [])
        for at in range(len(owner_a)):
            ends_a, ends_b = (at + 1 == len(o) or o[at + 1] != o[at] for o in (owner_a, owner_b))
            if ends_a:
                now[0].append(a[owner_a[at]][0])
            if ends_b:
                now[1].append(b[owner_b[at]][0])
            if ends_a and ends_b:
                groups.append(now)
                now = ([], [])
        out.append((len(a), len(b), groups, [(a[i][0], b[j][0]) for i, j in links]))
    return out


def check_alignment(found, texts):
    plain = plain_alignment(texts)
    counts = collections.Counter(p for *_, links in plain for p in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for r, (n_a, n_b, groups, links) in zip(found, plain, strict=True):
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, len(groups), len(links))
        assert (r["n_best"], r["count_sum"]) == (sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links))
        joined = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert r["groups_sha256"] == (hashlib.sha256(joined.encode()).hexdigest() if joined else "")


ODD_PARTS = ["foo", "bar,", " ", "  ", "\n", "\t", "é", "日本", "'s", " ", "▁", "<|endoftext|>", "<0x41>", "x", " \n", "\r\n", "123", "!!", "​", " ", "é", "\x00", "\U0001f600", "ﬁ", "ing", "straße"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(9)
    return ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", " ", "word " * 3000, "a▁b", "same text here", "same text here", "x" * 5000]


def test_alignment_matches_bytes(spark, odd_texts, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 4000)
    df = spark.createDataFrame(list(enumerate(odd_texts)), DOCS).withColumns({c: F.lit("mine") for c in ("id", "block", "pair", "place", "count", "best", "texts", "n_a")})
    found = sorted(alignment.align_documents(df).collect(), key=lambda r: r["doc_id"])
    check_alignment(found, odd_texts)


def test_alignment_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = sorted(queries.op12_token_alignment(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["doc_id"])
    check_alignment(found, [docs[r["doc_id"]] for r in found])
    assert len(found) == len(docs) and sum(r["n_links"] for r in found) > 10_000


def test_token_groups_are_spans(spark, odd_texts):
    df = spark.createDataFrame(list(enumerate(odd_texts[:60] + odd_texts[500:])), DOCS)
    texts, plain = odd_texts[:60] + odd_texts[500:], plain_alignment(odd_texts[:60] + odd_texts[500:])
    for r in alignment.token_groups(df).collect():
        n_a, n_b, groups, _ = plain[r["doc_id"]]
        assert (len(r["a_ids"]), len(r["b_ids"])) == (n_a, n_b), texts[r["doc_id"]]
        assert [(r["a_ids"][g["a_from"] : g["a_to"]], r["b_ids"][g["b_from"] : g["b_to"]]) for g in r["groups"]] == groups


def test_alignment_of_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], DOCS)
    found = alignment.align_documents(df).collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["groups_sha256"] == "") for r in found) == [("1", 0, True), ("1", 0, True), ("None", 2, False)]
    assert alignment.align_documents(df.limit(0)).isEmpty() and alignment.token_groups(df.limit(0)).isEmpty()


def test_gallop_is_a_lower_bound():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 40), (3, 900), (17, 18), (500, 800), (4000, 4100), (64, 64)):
        long = np.unique(rng.integers(0, 5000, m))
        short = np.unique(np.append(rng.choice(5001, n, replace=False), long[-1]))
        short = short[short <= long[-1]]
        assert (alignment.gallop(short, long) == np.searchsorted(long, short)).all()


def test_words_beyond_the_table_are_worked_out_each_time():
    small = alignment.TwoTokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    large = alignment.two_tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    rng, old = random.Random(1), alignment.CACHE_WORDS
    alignment.CACHE_WORDS = 20
    try:
        for _ in range(6):
            texts = [" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.choice([3, 60]))) for _ in range(15)) for _ in range(4)]
            one, two = small.encode(texts), large.encode(texts)
            assert all((x == y).all() for p, q in zip(one, two, strict=True) for x, y in zip(p, q, strict=True))
            assert len(small.words) == len(small.same) <= 20
    finally:
        alignment.CACHE_WORDS = old


def test_places_and_times_round_trip():
    for places in ([], [0], [5, 65535, 65536, 70000, 1 << 20], list(range(0, 300_000, 7))):
        assert alignment.unpack_places(alignment.pack_places(np.array(places, dtype="<u4"))).tolist() == places
    for times in ([], [1, 2], [1, 300, 70000]):
        assert alignment.unpack_times(alignment.pack_times(np.array(times, dtype="<u4"))).tolist() == times


# 13 whitening


def plain_whitening(vectors):
    """n, sums, covariance of the distinct grid vectors in exact fractions."""
    grid = [[math.floor(256 * c) for c in v] for v in vectors]
    fit = [list(x) for x in {tuple(x) for x in grid}]
    n, width = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(width)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(width)] for i in range(width)])
    return grid, n, sums, cov


def test_whitening_matches_fractions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + np.array([0, 1000, -3, 0.5, 0, 40, 0])
    x[40:60] = x[0]
    x[60:80, 3] += 1e-6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = whitening.whiten(df).select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    grid, n, sums, cov = plain_whitening(x.tolist())
    values, vectors = np.linalg.eigh(cov)
    assert len(found) == 1200 and {r["n"] for r in found} == {n}
    by = {(r["vec_id"], r["component"]): r for r in found}
    for k in range(4):
        e, v = values[-1 - k], vectors[:, -1 - k]
        wanted = (np.array(grid) - np.array(sums) / n) @ v / math.sqrt(e)
        got = np.array([by[i, k + 1]["whitened"] for i in range(300)])
        assert min(np.abs(got - wanted).max(), np.abs(got + wanted).max()) < 1e-8
        assert by[0, k + 1]["explained"] == pytest.approx(e / np.trace(cov), rel=1e-9)
    assert all(by[i, 1]["deviation"] == sum((n * grid[i][d] - sums[d]) ** 2 for d in range(7)) for i in range(300))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("low, high, rows", [(-5, 6, 1), (0, 1, 70), (-300, 300, 64), (-(1 << 40), 1 << 40, 130), (7, 8, 9)])
def test_bit_planes_give_exact_products(low, high, rows):
    x = np.random.default_rng(1).integers(low, high, size=(rows, 5))
    x[:, 2] = low
    wanted = [[sum(int(p) * int(q) for p, q in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert whitening.cross_products(x) == wanted


def test_whitening_edges(spark):
    nan, inf = math.nan, math.inf
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [-0.0, 2.0]), (4, None), (5, [1.0, None]), (6, [nan, 0.0]), (7, [-inf, 0.0]), (8, []), (9, [4.0]), (10, [5.5, 0.0])]
    names = ("x", "row", "v", "n", "component", "whitened", "dim")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in names})
    found = whitening.whiten(df)
    assert {r["row"]["n"] for r in found.collect()} == {"mine"}
    flat = found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert collections.Counter((r["vec_id"], r["component"]) for r in flat) == {(1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1, (None, 1): 1, (None, 2): 1, (9, 1): 1, (10, 1): 1, (10, 2): 1}
    assert {r["n"] for r in flat if r["vec_id"] != 9} == {4}
    alone = next(r for r in flat if r["vec_id"] == 9)
    assert (alone["n"], alone["deviation"], alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, None, None, None)
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in line if r["whitened"] is None} == {2, 3} and all(r["identity_error"] < 1e-9 for r in line)
    assert whitening.whiten(df.limit(0)).isEmpty()


def test_floats_are_widened_before_the_grid(spark):
    """A float entry counts as the double that it is."""
    value = struct.unpack("f", struct.pack("f", 0.1))[0]
    df = spark.createDataFrame([(1, [value]), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(r["x"][0] for r in whitening.grid_rows(df, "embedding").collect()) == [0, math.floor(value * 256)]
