"""Archives, digests of multisets, exposure by sequence and streamed alarms against plain versions."""

import hashlib
import io
import itertools
import json
import random
import re
import tarfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edgewise.operators import audits, pairs
from edgewise.sources import archive
from edgewise.streaming import monitor


def member(query, rows, mask=None):
    return f">mask\n{'*' * len(query) if mask is None else mask}\n>query\n{query}\n" + "".join(f">{k} {t}\n{a}\n" for k, t, a in rows)


def put(path, members):
    with tarfile.open(path, "w:gz" if str(path).endswith("gz") else "w") as tar:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    """Plain and compressed archives; other members skipped; the smallest name wins; bodies of wanted members only."""
    monkeypatch.setattr(archive, "RANGE_BYTES", 400)
    texts = [("b.a3m", member("ACD", [("k1", "t1", "A-D"), ("k2", "t2", "ACD")])), ("note.txt", "x"), ("z.a3m", member("ACD", [("k9", "t", "AAA")])), ("long.a3m", member("Q" * 90_000, [("k3", "t3", "Q" * 90_000)]))]
    put(tmp_path / "one.tar", texts)
    put(tmp_path / "two.tar.gz", [("c.a3m", member("WWW", [("k4", "t4", "W-W")])), ("a.a3m", member("ACD", [("k5", "t5", "--D")])), ("none.a3m", member("YY", []))])
    index = archive.read_archive(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["query_sha256"]) for r in index) == sorted([("b.a3m", sha("ACD")), ("z.a3m", sha("ACD")), ("long.a3m", sha("Q" * 90_000)), ("c.a3m", sha("WWW")), ("a.a3m", sha("ACD")), ("none.a3m", sha("YY"))])
    assert all((r["body"] is None) == r["archive"].endswith(".tar") for r in index)
    wanted = spark.createDataFrame([(sha(q),) for q in ("ACD", "WWW", "YY", "Q" * 90_000, "never")] + [(None,)], "sha string")
    found = sorted(tuple(r) for r in archive.read_members(spark, str(tmp_path), wanted).select("name", "key", "tax", "aligned").collect())
    assert found == [("a.a3m", "k5", "t5", "--D"), ("c.a3m", "k4", "t4", "W-W"), ("long.a3m", "k3", "t3", "Q" * 90_000)]


@pytest.mark.parametrize("compressed", [False, True])
def test_written_archives_are_read(spark, tmp_path, compressed):
    rows = [(f"m{k}.a3m", member("A" * (k + 1), [("r", "t", "-" * (k + 1))])) for k in range(40)]
    path = f"file:{tmp_path}/out"
    archive.write_archives(spark.createDataFrame(rows, "name string, text string").repartition(3), path, compressed)
    found = {r["name"]: r["query"] for r in archive.read_archive(spark, path).collect()}
    assert found == {f"m{k}.a3m": "A" * (k + 1) for k in range(40)}


@pytest.mark.parametrize("text, says", [(">query\nAC\n>mask\n**\n", "come first"), (">mask\n*\n>query\nAC\n", "length"), (None, "compressed member")])
def test_archives_with_odd_members_are_errors(spark, tmp_path, text, says):
    put(tmp_path / "bad.tar", [("m.a3m" if text else "m.a3m.gz", text or "x")])
    with pytest.raises(Exception, match=says):
        archive.read_archive(spark, str(tmp_path)).collect()


def test_additive_digest(spark):
    """The same under any partitions; sees a doubled row, a null and a moved border; adds and takes out."""
    rows = [(random.Random(3).choice("ab") * k, k % 5 or None) for k in range(60)]
    df = spark.createDataFrame(rows, "a string, y int")
    digest = lambda df: tuple(audits.additive_digest(df, ["a", "y"]).first())
    assert digest(df) == digest(df.repartition(7)) == digest(df.orderBy(F.desc("a")).coalesce(1))
    assert len({digest(df), digest(df.union(df.limit(1))), digest(df.union(df.limit(2))), digest(df.union(df.limit(1)).union(df.limit(1)))}) >= 3
    one, two, other = (spark.createDataFrame(r, "a string, y string") for r in ([("1", "23")], [("12", "3")], [("1", None)]))
    assert len({digest(x) for x in (one, two, other, one.limit(0))}) == 4
    parts = audits.additive_digest(df.filter("y > 2"), ["a", "y"]).union(audits.additive_digest(df.filter("y <= 2 OR y IS NULL"), ["a", "y"]))
    assert tuple(audits.join_digests(parts).first()) == digest(df)
    less = audits.additive_digest(df, ["a", "y"]).withColumn("sign", F.lit(1)).union(audits.additive_digest(df.filter("y > 2"), ["a", "y"]).withColumn("sign", F.lit(-1)))
    assert tuple(audits.join_digests(less, "sign").first()) == digest(df.filter("y <= 2 OR y IS NULL"))


@pytest.mark.parametrize("bounds", [None, (3, 5)])
def test_exposure_by_sequence_matches_a_loop(spark, bounds):
    """Many ids of one sequence on both sides, pairs inside one sequence, missing ids, lengths out of bounds."""
    rng = random.Random(5)
    norm = lambda s: re.sub("[UZOBJ]", "X", s.upper())
    sequences = ["AC", "ACD", "acd", "UUU", "XXX", "ACDE", "ACDEFG", "ZZZZ", "WWW"]
    entities = [(f"e{k}", rng.choice(sequences)) for k in range(24)]
    known = [(s, f"i{k}", rng.choice(sequences)) for s in ("one", "two") for k in range(12)]
    source = [(s, bit, f"i{rng.randrange(14)}", f"i{rng.randrange(14)}", rng.randint(0, 1)) for s, bit in (("one", 1), ("two", 2)) for _ in range(25)]
    tests = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(70)})
    tests = [(f"e{a}", f"e{b}") for a, b in tests]
    of = {}
    for e, s in entities:
        of.setdefault(norm(s), []).append(e)
    index = {frozenset(p): k for k, p in enumerate(tests)}
    hit, seen, audit = [0] * len(tests), Counter(), {}
    own = {(s, i): q for s, i, q in known}
    for s, bit, a, b, y in source:
        told = audit.setdefault(s, {"rows": 0, "positive": 0, "missing": set(), "filtered": 0, "matched": 0})
        told["rows"], told["positive"] = told["rows"] + 1, told["positive"] + y
        told["missing"] |= {x for x in (a, b) if (s, x) not in own}
        if bounds and not all((s, x) in own and bounds[0] <= len(own[s, x]) <= bounds[1] for x in (a, b)):
            told["filtered"] += 1
            continue
        left, right = (of.get(norm(own[s, x]), []) if (s, x) in own else [] for x in (a, b))
        for e in (*left, *right):
            seen[e] |= bit
        for p, q in itertools.product(left, right):
            if (k := index.get(frozenset((p, q)))) is not None:
                hit[k] |= bit
                told["matched"] += 1
    flags, found = pairs.sequence_exposure(
        spark.createDataFrame(tests, "a string, b string"), spark.createDataFrame(entities, "entity string, seq string"), spark.createDataFrame(source, "split string, bit int, a string, b string, y int"),
        spark.createDataFrame(known, "split string, id string, seq string"), bounds, pairs.normal_sequence,
    )
    assert {(r["a"], r["b"]): (r["pair_bits"], r["a_bits"], r["b_bits"]) for r in flags.collect()} == {p: (hit[k], seen[p[0]], seen[p[1]]) for k, p in enumerate(tests)}
    assert {r["split"]: (r["source_rows"], r["positive_rows"], r["missing_ids"], r["filtered_rows"], r["matched"]) for r in found.collect()} == {s: (t["rows"], t["positive"], len(t["missing"]), t["filtered"], t["matched"]) for s, t in audit.items()}
    assert any(hit) and not all(hit)


def test_alarms_of_a_growing_log(spark, tmp_path):
    """A stream restarted between files raises each alarm once and the batch's alarms in all; late rows are told."""
    rng, folder, rows = random.Random(2), tmp_path / "log", []
    folder.mkdir()
    for upd in range(120):
        rows += [(run, upd, 1.0 + rng.random() + (2.0 if run == 1 and upd > 70 else 0.0)) for run in range(3)]
    rows[30 * 3 + 2] = (2, 30, None)
    rows[90 * 3 + 2] = (2, 90, None)
    schema = "run long, upd long, value double"
    for k in range(3):
        part = rows[k * 120 : (k + 1) * 120]
        rng.shuffle(part)
        late = [(0, 3, 9.0)] if k == 2 else []
        (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(("run", "upd", "value"), r, strict=True))) + "\n" for r in part + late))
        monitor.watch(spark.readStream.schema(schema).json(str(folder)), 5, 2.6, str(tmp_path / "out")).awaitTermination()
    found = sorted((r["run"], r["upd"], r["alarm"]) for r in spark.read.parquet(str(tmp_path / "out" / "alarms")).collect())
    batch = sorted((r["run"], r["upd"], r["alarm"]) for r in monitor.first_alarms(spark.createDataFrame(rows, schema), 5, 2.6).collect())
    assert found == sorted([*batch, (0, 3, "late")]) and {a for _, _, a in batch} == {"mean", "non-finite"}
