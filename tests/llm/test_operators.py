"""Each operator against a brute-force version, a round trip or held-out accuracy, and its edge cases."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgewise.llm import common, exact_dedup, language, media, mixing, near_dedup, packing, quality, queries, secrets, store, tokens, toxicity
from edgewise.llm.common import held_out
from edgewise.llm.tokens import END_ID, encoder, tokenizer_path
from tests.compare import connect, rows_of

DATA = "/root/testdata/sf0.001"
WORDS = "river stone cloud paper light green house table music water field north south winter summer garden window letter number circle".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    long = words(1, 9000)
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (5, long + " end", "en", None, 1),
        (6, "one two", "en", "s", 7), (7, "one  two", None, "s", 8), (None, "no id here", "en", "t", 1), (8, "123 456", "de", "t", 7), (9, "日本語 テキスト ümläut 'quoted'  text\r\n", "ja", "t", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("score", "keep_id", "key", "id", "norm", "host", "findings", "media", "length")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 secrets

_BASE = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")


def plain_secrets(text):
    found = []
    for k, (pattern, least) in enumerate(zip(_BASE, (8, 16, 32), strict=True)):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m[1] if k == 0 else m[0]) >= least]
    return sorted(found)


def test_secret_scan_matches_regular_expressions(spark):
    rng = random.Random(4)
    parts = ["token", "secret", "passwd", "api_key", "APIKEY", "=", ":", '"', "'", " ", "abc", "é", "deadbeef", "0123456789abcdef", "AKIA", "ABCD1234", "oken", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(3000)] + [None, "", "password=" + "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_digest(secrets.scan_secrets(df)).collect():
        wanted = plain_secrets(texts[r["doc_id"]] or "")
        kinds = [secrets.BASE_RULES[k].kind for _, k, _ in wanted]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        joined = ",".join(f"{kind}:{s}:{e}" for kind, (s, _, e) in zip(kinds, wanted, strict=True))
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")] == [x for x in joined.split(",") if x]


def test_more_rules_find_known_shapes(spark):
    text = "x eyJhbGciOi.eyJzdWIi.SflKxw y ghp_" + "aZ" * 20 + " -----BEGIN RSA PRIVATE KEY----- z"
    found = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["findings"]
    assert {f["kind"]: text[f["start"] : f["end"]] for f in found} == {"jwt": "eyJhbGciOi.eyJzdWIi.SflKxw", "github": "ghp_" + "aZ" * 20, "pem": "-----BEGIN RSA PRIVATE KEY-----"}


@pytest.mark.parametrize("pattern", [rb"a(?:b|cd)*e{2}", rb"[^a-c\\]]{1,2}x?", rb"(?i:Ab[c-e]+|f\x20g)h", rb"[]a-]+b", rb"x{2,}|y{0,2}z", rb"\.\-[_A-]"])
def test_patterns_mean_what_regular_expressions_mean(pattern):
    """Every start and end of a match, against the standard library."""
    rng = random.Random(24)
    auto, _ = secrets.compile_rules((secrets.Rule("one", pattern),))
    for _ in range(300):
        data = bytes(rng.choice(b"abcdefghABCDxyz .-]\\_") for _ in range(rng.randint(0, 9)))
        state, ends = auto.start, []
        for k, byte in enumerate(data):
            state = auto.table[state + byte]
            if state >= auto.first_accepting:
                ends.append(k + 1)
        assert ends == [e for e in range(1, len(data) + 1) if any(re.fullmatch(pattern, data[b:e]) for b in range(e))]


def test_minimised_automaton_has_no_equal_states():
    auto, _ = secrets.compile_rules(secrets.BASE_RULES)
    table = np.array(auto.table).reshape(auto.states, 256)
    rows = {(tuple(table[s]), auto.accepts.get(s * 256, 0)) for s in range(auto.states)}
    assert len(rows) == auto.states


# 2 quality


def test_quality_held_out(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        rows.append((i, words(i, rng.randint(30, 90)) if good else "$$$ ".join(WORDS[:3] * rng.randint(5, 20)), "en", f"h{i % 7}", 0))
        labels.append((i, int(good), 0))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify_quality(df, lab).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(found) == 400 and all(found[i]["held_out"] == (i in held) for i in found)
    assert sum(found[i]["kept"] == (i % 3 > 0) for i in held) / len(held) > 0.97


def test_sparse_sites_shrink_to_the_prior(spark):
    rows = [("big", "p", 1.0)] * 500 + [("big", "q", 0.0)] * 500 + [("small", "p", 1.0)] + [("mid", "p", 0.0)] * 40 + [(None, None, 1.0)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"), "host", "path")
    found = {r["host"]: r["host_mean"] for r in sites.collect()}
    assert abs(found["big"] - 0.5) < 0.05 and found["mid"] < 0.4 and mean < found["small"] < 1.0 and None in found


def test_posteriors_match_a_plain_loop(spark):
    """Host and path means, strengths and final scores from the classifier's chances, row by row."""
    rng, rows, labels = random.Random(23), [], []
    for i in range(300):
        good = rng.random() < (0.9, 0.5, 0.1)[i % 3]
        text = words(i, rng.randint(20, 60)) if good else "buy now !! " * rng.randint(5, 20)
        rows.append((i, text if i % 50 else None, rng.choice(["en", "de", None]), f"h{i % 3}" if i % 29 else None, 0))
        if i % 2:
            labels.append((i, int(good), 0))
    rows.append(rows[5])
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.classify_quality(df, lab).collect()
    label, place = {i: q for i, q, _ in labels}, {r[0]: (r[3], r[2]) for r in rows}
    evidence = [float(label[r["doc_id"]]) if r["doc_id"] in label and not r["held_out"] else r["doc_chance"] for r in found]
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for r, e in zip(found, evidence, strict=True):
        paths[place[r["doc_id"]]].append(e)
        hosts[place[r["doc_id"]][0]].append(e)
    mean = (sum(evidence) + 1) / (len(evidence) + 2)

    def strength(sites, prior):
        n = sum(len(x) for x in sites.values())
        spread = sum(len(x) * (sum(x) / len(x) - prior[k]) ** 2 for k, x in sites.items()) / n
        noise = sum(prior[k] * (1 - prior[k]) for k in sites) / n
        rate = sum(map(sum, sites.values())) / n
        return min(max(rate * (1 - rate) / max(spread - noise, 1e-9) - 1, 1.0), 1e6)

    k = strength(hosts, dict.fromkeys(hosts, mean))
    host_mean = {h: (sum(x) + k * mean) / (len(x) + k) for h, x in hosts.items()}
    inner = strength(paths, {p: host_mean[p[0]] for p in paths})
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for r, e in zip(found, evidence, strict=True):
        site, h = paths[place[r["doc_id"]]], host_mean[place[r["doc_id"]][0]]
        prior = (sum(site) - e + inner * h) / (len(site) - 1 + inner)
        assert r["host_mean"] == pytest.approx(h, abs=1e-9) and r["path_mean"] == pytest.approx(prior, abs=1e-9)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(logit(r["doc_chance"]) + logit(prior) - logit(mean)))), abs=1e-9)


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (8, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify_quality(odd, labels).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found) and sum(r["doc_id"] == 4 for r in found) == 2
    assert quality.classify_quality(empty, labels).isEmpty() and quality.classify_quality(odd, labels.limit(0)).count() == 11


def test_secret_scan_edges(spark, odd, empty):
    found = secrets.secret_digest(secrets.scan_secrets(odd)).collect()
    assert len(found) == 11 and sum(r["doc_id"] == 4 for r in found) == 2 and secrets.secret_digest(secrets.scan_secrets(empty)).isEmpty()
    assert {r["n_assign"] + r["n_access"] + r["n_hex"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}


# 3 packing


def test_packing_is_tight_and_gapless(spark):
    rng = np.random.default_rng(6)
    lengths = np.concatenate([rng.integers(1, 65, 1500), np.full(300, 64), np.full(500, 33)])
    pieces = spark.createDataFrame([(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = collections.defaultdict(list)
    for r in packing.pack_best_fit(pieces, 64).collect():
        placed[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
    assert sorted(d for rows in placed.values() for _, _, d in rows) == list(range(len(lengths)))
    for rows in placed.values():
        rows.sort()
        assert [o for o, _, _ in rows] == [sum(n for _, n, _ in rows[:k]) for k in range(len(rows))] and sum(n for _, n, _ in rows) <= 64
    short = lengths[lengths < 64]
    least = max(short.sum() / 64, (short > 32).sum()) + (lengths == 64).sum()
    assert least <= len(placed) <= 1.01 * least


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {64: 3}, {33: 10, 31: 10}, {1: 1000}, {40: 7, 20: 3}])
def test_plan_covers_the_histogram(histogram):
    runs, sequences, _, _ = packing.plan_runs(histogram, 64)
    for length, n in histogram.items():
        ranks = sorted(x for le, first, count, _, _ in runs if le == length for x in range(first, first + count))
        assert ranks == list(range(n))
    load = collections.Counter()
    for length, _, count, first, _ in runs:
        for s in range(first, first + count):
            load[s] += length
    assert len(load) == sequences and all(v <= 64 for v in load.values())
    if histogram == {33: 10, 31: 10}:
        assert sequences == 10


def fewest(lengths, capacity):
    """Fewest sequences, by trying all places of each piece."""
    best = len(lengths)

    def go(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for j in range(len(room)):
            if room[j] >= lengths[k] and room[j] not in room[:j]:
                go(k + 1, [*room[:j], room[j] - lengths[k], *room[j + 1 :]])
        go(k + 1, [*room, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_plan_against_exhaustive_packing():
    rng, extra = random.Random(21), 0
    for _ in range(60):
        lengths = [rng.randint(2, 15) for _ in range(rng.randint(1, 11))]
        plan, least = packing.plan_runs(dict(collections.Counter(lengths)), 16), fewest(lengths, 16)
        assert plan.bound - 1e-6 <= least <= plan.sequences <= least + 1
        extra += plan.sequences - least
    assert extra <= 3


def lengths_of(kind):
    rng = np.random.default_rng(6)
    if kind == "lognormal":
        return np.clip(rng.lognormal(3.8, 0.9, 20_000), 1, 255).astype(int), 256
    if kind == "few":
        return rng.choice(rng.choice(np.arange(200, 900), 30, replace=False), 10_000), 1024
    low, high, n, capacity = kind
    return rng.integers(low, high + 1, n), capacity


@pytest.mark.parametrize("kind", ["lognormal", "few", (1, 255, 20_000, 256), (75, 175, 20_000, 256), (340, 343, 3000, 1024), (341, 600, 9000, 1024)])
def test_runs_are_the_programs(kind):
    """The returned runs come from the program, near its bound, and are no more than best fit alone would make; few lengths are solved to the bound."""
    lengths, capacity = lengths_of(kind)
    left = np.bincount(lengths, minlength=capacity + 1)
    greedy = sum(times for _, times in packing._best_fit(left, capacity))
    program = packing.solve_configurations(left, capacity)
    packed, sequences = collections.Counter(), 0
    for pattern, times in packing.round_program(left, program, capacity):
        packed.update({k: n * times for k, n in pattern.items()})
        sequences += times
    assert packed == collections.Counter(lengths.tolist())
    assert lengths.sum() / capacity <= program.bound + 1e-6 and program.value <= 1.01 * program.bound + 1
    assert program.bound - 1e-6 <= sequences <= greedy
    if len(np.unique(lengths)) < 40:
        assert program.value <= program.bound * 1.001 and sequences <= program.bound + 2
        assert packing.plan_runs(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), capacity).sequences == sequences


def test_empty_table_packs_to_nothing(empty):
    assert packing.pack_documents(empty, 128).isEmpty()


def test_pieces_are_the_documents_ids(spark, odd):
    path, wanted = tokenizer_path(), collections.Counter()
    tool = encoder(path)
    for doc, text in texts_of(odd):
        ids = np.frombuffer(tool.whole(text or "") + END_ID.to_bytes(4, "little"), dtype="<u4")
        first = len(ids) if len(ids) <= 128 else (len(ids) % 128 or 128)
        cuts = [0, *range(first, len(ids) + 1, 128)]
        wanted.update((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    found = packing.pack_documents(odd, 128).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted


def test_encoder_equals_the_library():
    """A fresh tokenizer of the library, whose special tokens in a text are special."""
    rng, tool, plain = random.Random(7), encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    parts = ["a", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "²", "_", "!", "ab ", " x", "日", "\x1c", "<|endoftext|>", "<|endoftext", "ª", "ß", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(6000)] + ["a<|endoftext|>b"]
    found = [np.frombuffer(x[:-4], dtype="<u4").tolist() for x in tool.batch(texts)]
    assert found == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[-1] == [64, 50256, 65]


def test_encoder_in_small_groups_equals_the_library(monkeypatch):
    """Latin letters, signs and line ends whole; texts split together, a few characters at a time, with a table that is soon full."""
    monkeypatch.setattr(tokens, "TOGETHER", 40)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    rng, tool, plain = random.Random(11), tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    parts = ["a", "é", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'r", "'ve", "'re", "'m", "'d", "'t", "e", "l", "1", "_", "!", "\xad", "\xa1", "‐", "‧", "ª", "ɏ", "ß", "\r\n", "house"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(4000)] + ["word " * 40]
    assert all(tokens.SIMPLE.fullmatch(t) for t in texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in tool.batch(texts)] == [[*plain.encode(t, add_special_tokens=False).ids, END_ID] for t in texts]


def test_encoder_holds_words_of_few_texts_at_once(monkeypatch):
    """Besides ids and known words, a batch of many words takes memory for the texts that are split together alone."""
    monkeypatch.setattr(tokens, "TOGETHER", 20_000, raising=False)
    tool, texts = tokens.Encoder(tokenizer_path()), [words(k % 7, 400) for k in range(400)]
    tool.batch(texts)
    tracemalloc.start()
    out = tool.batch(texts)
    peak = tracemalloc.get_traced_memory()[1] - sum(map(len, out))
    tracemalloc.stop()
    assert peak < 3_000_000


# 4 exact dedup


def test_exact_dedup_matches_sql(spark):
    found = queries.op4_exact_dedup(spark, DATA).toPandas()
    assert rows_of(found) == rows_of(connect(DATA).sql(queries.oracle_sql()["op4_exact_dedup"]).df())


def test_exact_dedup_edges(spark, odd, empty):
    found = exact_dedup.exact_duplicates(odd).collect()
    assert len(found) == 11 and sum(r["kept"] for r in found) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in texts_of(odd)})
    by = {r["doc_id"]: r for r in found}
    assert by[2]["keep_id"] == 1 and by[2]["group_size"] == 2 and by[3]["keep_id"] == 3 and by[7]["keep_id"] == 6 and by[None]["kept"]
    assert exact_dedup.exact_duplicates(empty).isEmpty()
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 8


@pytest.mark.parametrize("collided", [10_000, 0])
def test_colliding_keys_chain_and_compare_bytes(spark, monkeypatch, collided):
    """Raw duplicates under three keys only, so that groups are decided by bytes alone."""
    monkeypatch.setattr(exact_dedup, "COLLIDED", collided)
    df = spark.createDataFrame([(i, f"text  {i % 5}" if i % 2 else f"text\t{i % 5}") for i in range(50)], "doc_id long, text string").repartition(4)
    key = F.length("norm") % 3 + F.when(F.col("norm").endswith("4"), 1).otherwise(0)
    index = exact_dedup.build_index(df, key=key.cast("long"))
    found = index.entries.collect()
    assert {(r["keep_id"], r["group_size"]) for r in found} == {(k, 10) for k in range(5)} and sorted(r["chain"] for r in found) == [0, 0, 1, 2, 3]
    rows = exact_dedup.exact_duplicates(df, key=key.cast("long")).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(i, i % 5, 10, i < 5) for i in range(50)} and len(rows) == 50
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(df, key=key.cast("long")).collect()) == list(range(5))


def test_index_buckets_follow_the_directory(spark, monkeypatch):
    """Small buckets and hot keys: entries lie in the bucket of their cell, none is overfull, and rows of a hot key are all found."""
    monkeypatch.setattr(exact_dedup, "HELD", 2000)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(900)], "doc_id long, text string").repartition(6)
    index = exact_dedup.build_index(df, capacity=20)
    cell = {r["cell"]: r["bucket"] for r in index.directory.collect()}
    entries = index.entries.collect()
    assert len(cell) == 1 << index.bits and all(cell[(r["key"] & (1 << 64) - 1) >> (64 - index.bits)] == r["bucket"] for r in entries)
    assert max(collections.Counter(r["bucket"] for r in entries).values()) <= 20 and len(entries) == 601
    rows = exact_dedup.exact_duplicates(df, capacity=20).collect()
    assert len(rows) == 900 and all((r["keep_id"], r["group_size"]) == ((0, 300) if r["doc_id"] % 3 == 0 else (r["doc_id"], 1)) for r in rows)


def test_dedup_keeps_clashing_columns_and_orders_ties_by_all(spark):
    rows = [(1, "a", True, 5, "own"), (1, "a ", False, 5, "own"), (1, "a", False, 5, "own"), (2, "a", True, 1, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, flag boolean, key int, row string")
    found = exact_dedup.drop_exact_duplicates(df.filter("text = 'a'")).collect()
    assert [tuple(r) for r in found] == [(1, "a", False, 5, "own")]
    clash = df.withColumns({c: F.lit("mine") for c in ("__sha", "__own", "__id", "__keep", "id", "th", "norm", "bytes", "hash")})
    assert {r["__sha"] for r in exact_dedup.drop_exact_duplicates(clash).collect()} == {"mine"}
    assert {r["__own"] for r in near_dedup.drop_near_duplicates(clash).collect()} == {"mine"}


def test_directory_doubles_until_buckets_fit():
    histogram = np.zeros(1 << 8, dtype=np.int64)
    histogram[3], histogram[4], histogram[200] = 50, 5, 7
    starts, depths = exact_dedup.grow_directory(histogram, 10)
    ends = [*starts[1:], 256]
    assert all(histogram[s:e].sum() <= 10 or e - s == 1 for s, e in zip(starts, ends, strict=True))
    assert all(e - s == 1 << (8 - d) for s, e, d in zip(starts, ends, depths, strict=True))


# 5 store


def test_store_round_trip(spark, odd):
    base = store.write_store(odd)
    tool = encoder(tokenizer_path())
    wanted = [(d, tool.whole(t or "") + END_ID.to_bytes(4, "little")) for d, t in texts_of(odd)]
    found = store.read_store(spark, base).collect()
    assert all(r["verified"] for r in found)
    assert collections.Counter((r["id"], r["n_tokens"], r["ids_crc32"]) for r in found) == collections.Counter((d, len(x) // 4, zlib.crc32(x)) for d, x in wanted)
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
    assert [r["id"] for r in ordered if r["id"] is not None] == sorted(r["id"] for r in found if r["id"] is not None)
    built = collections.Counter((r["id"], np.array(r["ids"], dtype="<u4").tobytes()) for r in store.reconstruct(spark, base).collect())
    assert built == collections.Counter(wanted)
    keys = [r["key"] for r in spark.read.parquet(f"{base}/parts").filter("chunk = 'true'").select("key").collect()]
    assert len(keys) == len({bytes(k) for k in keys})


def merkle_by_levels(leaves):
    level = list(leaves) or [store.digest(b"")]
    while len(level) > 1:
        level = [store.digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def test_streamed_merkle_root():
    leaves = [store.digest(bytes([k])) for k in range(40)]
    assert all(store.merkle_root(leaves[:n]) == merkle_by_levels(leaves[:n]) for n in range(40))


def test_documents_hashed_together_cut_alike():
    rng = np.random.default_rng(22)
    raws = [rng.integers(0, 50_000, int(n)).astype("<u4").tobytes() for n in [*rng.integers(1, 3000, 40), 1, 5, 20_000]]
    assert list(store._cuts(raws)) == [store.cut_points(np.frombuffer(r, dtype="<u4")) for r in raws]


def test_damage_is_noticed(spark, empty):
    docs = spark.createDataFrame([(i, words(i, 300)) for i in range(40)], "doc_id long, text string")
    base = store.write_store(docs)
    store.check_manifest(spark, base)

    def damaged(name, change):
        other = common.fresh_path(spark, "store")
        for table in ("parts", "recipes", "manifest"):
            df = spark.read.option("recursiveFileLookup", "false").parquet(f"{base}/{table}")
            part = {"parts": "chunk", "recipes": "total"}.get(table)
            writer = (change(df) if table == name else df).write
            (writer.partitionBy(part) if part else writer).parquet(f"{other}/{table}")
        return other

    for change in (
        lambda d: d.filter("id <> 7 or id is null"), lambda d: d.withColumn("at", F.when(F.col("id") == 3, F.lit(0)).otherwise(F.col("at"))), lambda d: d.unionByName(d.filter("id = 5")),
        lambda d: d.withColumn("digests", F.when(F.col("id") == 9, F.reverse("digests")).otherwise(F.col("digests"))),
    ):
        with pytest.raises(ValueError, match="manifest"):
            store.read_store(spark, damaged("recipes", change))
    with pytest.raises(ValueError, match="manifest"):
        store.check_manifest(spark, damaged("manifest", lambda d: d.withColumn("root", F.when(F.col("part") == -1, F.unhex(F.lit("00"))).otherwise(F.col("root")))))
    flipped = damaged("parts", lambda d: d.withColumn("payload", F.when(F.col("key") == d.filter("payload is not null").agg(F.min("key")).first()[0], F.concat("payload", F.unhex(F.lit("0000")))).otherwise(F.col("payload"))))
    assert store.read_store(spark, flipped).filter("not verified").count() >= 1
    lost = damaged("parts", lambda d: d.filter(~F.col("chunk") | (F.col("key") != d.filter("payload is not null").agg(F.max("key")).first()[0])))
    assert store.read_store(spark, lost).filter("not verified").count() >= 1
    assert store.read_store(spark, store.write_store(empty)).isEmpty()


def test_checksums_concatenate():
    rng = np.random.default_rng(8)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 5000, 12)]
    crc, whole = np.array([zlib.crc32(b"")], dtype=np.uint32), b""
    for p in parts:
        crc, whole = store.crc_concat(crc, np.array([zlib.crc32(p)], dtype=np.uint32), np.array([len(p)])), whole + p
    assert int(crc[0]) == zlib.crc32(whole)
    after = np.cumsum([len(p) for p in parts[::-1]])[::-1] - [len(p) for p in parts]
    shifted = store.crc_shift(np.array([zlib.crc32(p) for p in parts], dtype=np.uint32), after)
    assert int(np.bitwise_xor.reduce(shifted)) == zlib.crc32(whole)
    assert int(store.crc_shift(np.array([7], dtype=np.uint32), np.array([(1 << 25) + 3]))[0]) == zlib.crc32(bytes((1 << 25) + 3), 7) ^ zlib.crc32(bytes((1 << 25) + 3))


def test_cuts_resynchronise():
    rng = np.random.default_rng(9)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    shifted = np.concatenate([rng.integers(0, 50_000, 77).astype("<u4"), ids])
    chunks = lambda x: {x[a:b].tobytes() for a, b in zip([0, *store.cut_points(x)], store.cut_points(x), strict=False)}
    assert len(chunks(ids) & chunks(shifted)) > 0.8 * len(chunks(ids))


# 6 near duplicates


def plain_classes(rows, threshold=0.8):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else None for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def near_copies(seed, base, n, edits):
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("bucket, block", [(1024, 1024), (16, 24)])
def test_jaccard_classes_match_brute_force(spark, monkeypatch, bucket, block):
    """Small blocks as well, so that large buckets and groups are split."""
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    texts = near_copies(1, words(100, 120), 90, 6) + near_copies(2, words(101, 60), 40, 3) + [words(k, 50) for k in range(60)] + [words(7, 40)] * 5
    passage = words(555, 30)
    texts += [f"{words(900 + k, 25)} {passage} {words(800 + k, 25)}" for k in range(40)] + ["", "one two", "one two", "a b c d e"]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    found = near_dedup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wanted = plain_classes(sorted(rows))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found} == wanted
    assert sum(r["kept"] for r in found) == len({c for c, _ in wanted.values()})


def test_jaccard_edges(spark, odd, empty):
    found = near_dedup.jaccard_classes(odd).collect()
    assert len(found) == 11 and near_dedup.jaccard_classes(empty).isEmpty()
    assert {r["class_id"] for r in found if r["doc_id"] in (4, 5)} == {4}
    assert near_dedup.drop_near_duplicates(exact_dedup.drop_exact_duplicates(odd)).columns == odd.columns


def test_near_duplicates_keep_repeated_rows(odd):
    found = near_dedup.drop_near_duplicates(odd)
    ids = sorted(r["doc_id"] or 0 for r in found.collect())
    assert found.columns == odd.columns and ids == [0, 1, 2, 3, 4, 4, 6, 8, 9]


def test_pruning_bounds():
    for k, n in zip(near_dedup.least_matches(0.8, 1e-4), range(16, 129, 16), strict=True):
        tail = lambda m, n=n: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))
        assert tail(k) >= 1e-4 > tail(k - 1)


# 7 toxicity


def plain_segments(s):
    best = None
    for i in range(len(s)):
        for j in range(i, len(s)):
            t = sum(s[i : j + 1])
            if t > 0 and (best is None or t > best[2] + 1e-9 or (abs(t - best[2]) < 1e-9 and j + 1 - i < best[1] - best[0])):
                best = (i, j + 1, t)
    if best is None:
        return []
    left, right = plain_segments(s[: best[0]]), plain_segments(s[best[1] :])
    return [*left, best, *[(a + best[1], b + best[1], t) for a, b, t in right]]


def test_segments_match_the_recursive_definition():
    rng = random.Random(10)
    for _ in range(400):
        s = [rng.choice([-3, -2, -1, -0.5, 0.7, 1.3, 2.1]) for _ in range(rng.randint(0, 12))]
        assert [(a, b, round(t, 6)) for a, b, t in toxicity.maximal_segments(s)] == [(a, b, round(t, 6)) for a, b, t in plain_segments(s)]


def toxic_tables(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(800):
        w, bad = words(i, rng.randint(20, 200)).split(), i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), "vile" + rng.choice(["ness", "ly", "st", "r", ""]))
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_passages(spark, odd, empty):
    docs, labels = toxic_tables(spark)
    model = toxicity.learn_from_tables(docs, labels)
    found = toxicity.score_toxicity(docs, model).withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [r for r in found if r["held"]]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.98
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found:
        assert 0 <= r["score"] <= 1
        for p in r["passages"]:
            assert any(w.startswith("vile") for w in toxicity.words_of(text[r["doc_id"]])[p["start"] : p["end"]])
    assert toxicity.drop_toxic(docs, model).filter("doc_id % 5 <> 0").count() >= 630
    assert toxicity.score_toxicity(odd, model).count() == 11 and toxicity.score_toxicity(empty, model).isEmpty()
    silent = toxicity.learn_from_tables(docs, labels.filter("toxic = 0"))
    assert toxicity.score_toxicity(docs, silent).filter("predicted = 1").isEmpty()


# 8 language


def plain_distance(own, profile, size):
    place = {g: k for k, g in enumerate(profile)}
    return sum(abs(place[g] - k) if g in place else size for k, g in enumerate(own))


def test_language_distance_and_edges(spark, odd, empty):
    texts = {"aa": "abra kadabra abra", "bb": "zorro buzz zig zag"}
    df = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    profiles = language.learn_profiles(df, size=50)
    assert [list(profiles[x]) for x in ("aa", "bb")] == [list(language.ranked(texts[x], 50)) for x in ("aa", "bb")]
    probe = "abrazo zig kadabra"
    own = list(language.ranked(probe, 50))
    away = {x: plain_distance(own, list(profiles[x]), 50) for x in profiles}
    got = language.detect_language(spark.createDataFrame([(1, probe)], "doc_id long, text string"), profiles, size=50).first()
    best, other = sorted(away.values())
    assert got["lang_pred"] == min(away, key=away.get) and got["score"] == pytest.approx((other - best) / other)
    found = {r["doc_id"]: r["lang_pred"] for r in language.detect_language(odd, profiles).collect()}
    assert found[1] == found[2] == found[3] == found[8] == "und" and found[9] != "und"
    assert language.detect_language(empty, profiles).isEmpty() and language.detect_language(odd, {}).filter("lang_pred <> 'und'").isEmpty()


def test_language_held_out(spark):
    found = queries.op8_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


# 9 mixing


def test_mixing_matches_sql(spark):
    found = queries.op9_mixing(spark, DATA).toPandas()
    assert rows_of(found) == rows_of(connect(DATA).sql(queries.oracle_sql()["op9_mixing"]).df())


def test_mixing_reaches_target_weights(spark, odd, empty):
    df = spark.range(0, 6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 5800, "b").otherwise("c").alias("source"), F.lit("t").alias("text"))
    mixed = mixing.mix_sources(df, weights={"a": 0.2, "b": 0.2, "c": 0.6})
    share = {r["source"]: r["count"] / 6000 for r in mixed.groupBy("source").count().collect()}
    assert abs(share["a"] - 0.2) < 0.03 and abs(share["c"] - 0.6) < 0.05
    order = [r["__order"] for r in mixed.collect()]
    assert order == sorted(order)
    counts = np.array([r["n"] for r in mixed.filter("source = 'c'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()])
    assert abs(counts.var() - 18) < 8
    assert mixing.mix_sources(empty).isEmpty() and set(mixing.mix_sources(odd).columns) == {*odd.columns, "__copy", "__order"}


def test_high_rates_stay_poisson(spark):
    for rate in (30.0, 499.0, 750.0, 1225.0, 4000.0):
        rows = spark.range(600).select(mixing.poisson_count(F.concat(F.lit("t:"), F.col("id").cast("string")), F.lit(rate)).alias("k"))
        counts = [r["k"] for r in rows.collect()]
        mean = sum(counts) / 600
        spread = sum((k - mean) ** 2 for k in counts) / 599
        assert abs(mean - rate) < 5 * math.sqrt(rate / 600) and 0.7 < spread / rate < 1.35


@pytest.mark.parametrize("rate", [0.0, 0.1, 1.0, 37.0, 499.0, 700.0, 3000.0])
def test_counts_are_exact_quantiles(spark, rate):
    """Each draw against the distribution function itself, summed in log space."""
    def quantile(u, lam):
        k, total = 0, 0.0
        while True:
            total += math.exp(k * math.log(lam) - lam - math.lgamma(k + 1)) if lam else 1.0
            if total > u:
                return k
            k += 1

    draw = lambda key: int(hashlib.sha256(key.encode()).hexdigest()[:15], 16) / 2**60
    m = math.ceil(rate / 500)
    found = spark.range(60).select(mixing.poisson_count(F.concat(F.lit("q:"), F.col("id").cast("string")), F.lit(rate)).alias("k")).collect()
    for i, r in enumerate(found):
        wanted = quantile(draw(f"q:{i}"), rate) if rate <= 500 else sum(quantile(draw(f"part:{p}:q:{i}"), rate / m) for p in range(1, m + 1))
        assert r["k"] == wanted


def test_mixing_sql_at_high_rates(spark, tmp_path):
    """A rare source among many rows: rates over 64 and over 500."""
    n = 280_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, None).when(F.col("id") < 9, "few").otherwise("many").alias("source"), F.lit("t").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op9_mixing(spark, str(tmp_path)).toPandas()
    con = __import__("duckdb").connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found.groupby("doc_id").size().max() > 450
    assert rows_of(found) == rows_of(con.sql(queries.oracle_sql()["op9_mixing"]).df())


def test_mixing_with_clashing_names(spark, odd):
    clash = odd.withColumns({c: F.lit("mine") for c in ("__source", "__rate", "__n", "__order", "rate", "n", "row", "own", "copy", "place")})
    found = mixing.mix_sources(clash, budget=3.0, copy_col=None, order_col=None)
    assert found.columns == clash.columns and {r["__rate"] for r in found.collect()} == {"mine"}
    assert mixing.mix_sources(clash, budget=3.0).columns[-2:] == ["__copy", "__order"]


def test_small_source_meets_a_high_rate(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "few").otherwise("many").alias("source"))
    found = mixing.mix_sources(docs, weights={"few": 1.0})
    assert abs(found.count() - 5000) < 5 * math.sqrt(5000) and found.groupBy("doc_id").count().select("count").distinct().count() > 1


# 10 media


def test_media_round_trip(spark, odd, empty):
    found = media.media_digest(media.media_packets(media.text_media(odd))).collect()
    wanted = collections.Counter()
    for d, t in texts_of(odd):
        p, n = media.padded(t)
        wanted[(d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found) == wanted
    assert media.media_digest(media.media_packets(media.text_media(empty))).isEmpty()


def test_packets_cues_and_all_lacings():
    payload = bytes(range(256)) * 300
    data = media.mux(payload)
    packets, cues, tracks = media.demux(data)
    assert {p.lacing for p in packets} == {0, 1, 2, 3} and [(t.number, t.codec, t.rate, t.bits, t.channels) for t in tracks] == [(1, "A_PCM/INT/LIT", 1000.0, 8, 1)]
    at = 0
    for p in packets:
        assert data[p.offset : p.offset + p.size] == payload[at : at + p.size] and p.timestamp == at * 1_000_000
        at += p.size
    assert at == len(payload) and {o for _, _, o in cues} == {p.cluster for p in packets}


def test_unknown_sizes_and_broken_files(spark):
    frame = media.element(media.SIMPLE, media.vint(1) + b"\x00\x00\x80" + b"abcd")
    cluster = media._id(media.CLUSTER) + b"\xff" + media._uint(media.TIME, 5) + frame
    data = media.element(media.EBML, b"") + media._id(media.SEGMENT) + b"\x01" + b"\xff" * 7 + cluster + cluster
    packets, _, _ = media.demux(data)
    assert [(p.timestamp, p.size) for p in packets] == [(5_000_000, 4)] * 2
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:-3])), (3, bytearray(b"\x00junk")), (4, None)], "doc_id long, media binary")
    found = {r["doc_id"]: r for r in media.media_packets(df).collect()}
    assert len(found[1]["packets"]) == 2 and found[2]["error"] and found[3]["packets"] is None and found[4]["packets"] == []


def foreign(codec, audio=b"", duration=b"", blocks=b""):
    entry = media._uint(media.NUMBER, 3) + media._uint(media.KIND, 2) + media.element(media.CODEC, codec) + duration + (media.element(media.AUDIO, audio) if audio else b"")
    body = media.element(media.INFO, media._uint(media.SCALE, 500_000)) + media.element(media.TRACKS, media.element(media.ENTRY, entry)) + media.element(media.CLUSTER, media._uint(media.TIME, 40) + blocks)
    return media.element(media.EBML, b"") + media.element(media.SEGMENT, body)


def test_timestamps_and_key_frames_of_other_files():
    """By hand: stereo 16-bit PCM, a frame duration, a block duration, none; groups with and without a reference."""
    laced = media.vint(3) + b"\x00\x02" + bytes([2 << 1]) + media.lace([b"a" * 8] * 3, 2)
    stereo = media.element(media.RATE, b"\x40\x8f\x40" + b"\0" * 5) + media._uint(media.CHANNELS, 2) + media._uint(media.DEPTH, 16)
    start, simple = 42 * 500_000, media.element(media.SIMPLE, laced)
    times = lambda data: [p.timestamp - start for p in media.demux(data)[0]]
    assert times(foreign(b"A_PCM/INT/LIT", stereo, blocks=simple)) == [0, 2_000_000, 4_000_000]
    assert times(foreign(b"A_OPUS", stereo, media._uint(media.DURATION, 20_000_000), simple)) == [0, 20_000_000, 40_000_000]
    group = media.element(media.GROUP, media.element(media.BLOCK, laced) + media._uint(media.BLOCK_DURATION, 12))
    assert times(foreign(b"A_OPUS", blocks=group)) == [0, 2_000_000, 4_000_000] and times(foreign(b"A_OPUS", blocks=simple)) == [0, 0, 0]
    refers = media.element(media.GROUP, media.element(media.BLOCK, laced) + media.element(media.REFERENCE, b"\xff"))
    assert [p.keyframe for p in media.demux(foreign(b"V_VP8", blocks=group + refers + group))[0]] == [True] * 3 + [False] * 3 + [True] * 3


@pytest.mark.parametrize("value", [0, 1, 126, 127, 128, 16382, 16383, 2**40])
def test_variable_length_numbers(value):
    data = media.vint(value)
    assert media._vint_at(data, 0, False) == (value, len(data))
