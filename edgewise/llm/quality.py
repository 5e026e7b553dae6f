"""Quality classification by hierarchical empirical Bayes.

A logistic document classifier over learned log-odds of hashed character
n-grams and the text's shape gives each document a chance of being good. The
chances are summed over hosts and over paths of a host; each level's posterior
shrinks towards the level above (path to host, host to corpus) with a strength
that the spread between the sites tells. A document's final odds are its own
evidence times its site's prior odds, its own contribution taken out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, materialise, sample_by_hash

#: Labelled documents of each class that the classifier is fitted on; half of them teach the n-grams' odds, half the weights.
SAMPLE = 10_000
#: Lengths of the character n-grams, and the buckets that each length is hashed to.
GRAMS, BUCKETS = (3, 5), 1 << 17
_WORD = re.compile(r"\S+")


def shape(text: str | None) -> list[float]:
    """Lengths, repetition, case, digits, other marks and lines. A null text is empty."""
    text = text or ""
    n = len(text)
    words = _WORD.findall(text)
    if not words:
        return [0.0] * 11 + [1.0]
    low = [w.lower().strip(".,;:!?") for w in words]
    counts = Counter(low)
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    letters, digits, spaces = sum(map(str.isalpha, text)), sum(map(str.isdigit, text)), sum(map(str.isspace, text))
    lines = text.split("\n")
    return [
        math.log1p(len(words)), len(counts) / len(words), math.log1p(repeats), repeats / len(words), sum(map(str.isupper, text)) / (letters or 1), digits / n,
        (n - letters - digits - spaces) / n, n / len(words) / 10, max(counts.values()) / len(words), len(set(lines)) / len(lines), (text.count(".") + text.count(",")) / len(words), 0.0,
    ]


def grams(text: str | None) -> list[np.ndarray]:
    """Buckets of the text's distinct character n-grams, of each length."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for size in GRAMS:
        n = max(0, len(points) - size + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            mixed = (mixed ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        seen = np.zeros(BUCKETS, dtype=bool)
        seen[(mixed >> np.uint64(20)) % np.uint64(BUCKETS)] = True
        out.append(np.flatnonzero(seen))
    return out


def features(text: str | None, odds: np.ndarray) -> list[float]:
    """Shape, and the mean log-odds of the text's n-grams of each length (0 where it has none)."""
    return shape(text) + [float(own[k].mean()) if len(k) else 0.0 for own, k in zip(odds, grams(text), strict=True)]


class Classifier:
    """Weights over standardised features, and the n-grams' log-odds (a row a length)."""

    def __init__(self, centre: np.ndarray, width: np.ndarray, weights: np.ndarray, odds: np.ndarray | None = None):
        self.centre, self.width, self.weights = centre, width, weights
        self.odds = np.zeros((len(GRAMS), BUCKETS), dtype=np.float32) if odds is None else odds

    def chance(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.width, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Ridge logistic regression by Newton steps. One class alone gives its share everywhere."""
    centre, width = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([np.ones(len(x)), np.clip((x - centre) / width, -8, 8)])
    w = np.zeros(z.shape[1])
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    w[0] = math.log(share / (1 - share))
    if 0 < y.mean() < 1:
        keep = np.full(len(w), ridge)
        keep[0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(keep)
            step = np.linalg.solve(h, z.T @ (p - y) + keep * np.concatenate([[0], w[1:]]))
            w -= step
            if np.abs(step).max() < 1e-8:
                break
    return Classifier(centre, width, w)


def learn_classifier(labelled: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on ``text`` and ``label`` of about ``sample`` documents of each class; null labels are left out."""
    return _fit_rows(sample_by_hash(labelled.filter(F.col("label").isin(0, 1)), "id", "label", sample).select("text", "label"))


def _gram_odds(rows: DataFrame) -> np.ndarray:
    """Log-odds of each bucket from the documents of each class that have it; add-one smoothed."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((2, len(GRAMS), BUCKETS), dtype=np.int64)
        sizes = [0, 0]
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                sizes[int(label)] += 1
                for k, buckets in enumerate(grams(text)):
                    table[int(label), k, buckets] += 1
        row, at = table.sum(axis=0).nonzero()
        yield pd.DataFrame({"row": [*row.tolist(), -1], "at": [*at.tolist(), 0], "bad": [*table[0, row, at].tolist(), sizes[0]], "good": [*table[1, row, at].tolist(), sizes[1]]})

    found = rows.mapInPandas(count, "row int, at int, bad long, good long").groupBy("row", "at").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # BUCKETS a length at most
    row, at, bad, good = (found.column(c).to_numpy() for c in ("row", "at", "bad", "good"))
    sums = np.zeros((2, len(GRAMS), BUCKETS))
    own = row >= 0
    sums[0, row[own], at[own]], sums[1, row[own], at[own]] = bad[own], good[own]
    sizes = (int(bad[~own].sum()), int(good[~own].sum()))
    return (np.log((sums[1] + 1) / (sizes[1] + 2)) - np.log((sums[0] + 1) / (sizes[0] + 2))).astype(np.float32)


def _fit_rows(rows: DataFrame) -> Classifier:
    """N-gram odds from one half of the rows, weights from the other, so that no document's own words speak for it."""
    rows = materialise(rows.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "text"), F.lit(2))), "labelled")
    odds = _gram_odds(rows.filter("half = 0"))
    shared = rows.sparkSession.sparkContext.broadcast(odds)  # 1 MB

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [features(t, shared.value) for t in frame["text"]], "y": frame["label"].astype(float)})

    found = rows.filter("half = 1").mapInPandas(measure, "x array<double>, y double").toPandas()  # bounded by the sample
    if found.empty:
        k = len(features("", odds))
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k + 1), odds)
    model = fit(np.array(found["x"].tolist()), found["y"].to_numpy())
    return Classifier(model.centre, model.width, model.weights, odds)


def document_chances(df: DataFrame, model: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the classifier's ``chance`` of every whole text. No shuffle."""
    bounded_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([features(t, shared.value.odds) for t in frame["__text"]])
            yield frame.drop(columns="__text").assign(chance=shared.value.chance(x) if len(x) else [])

    rows = df.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInPandas(score, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", chance double")


def _strength(sites: DataFrame, prior: str) -> float:
    """Beta prior strength from the spread of site means around ``prior``, noise taken out (one row to the driver)."""
    own = F.col("s") / F.col("n")
    spread = F.sum(F.col("n") * F.pow(own - F.col(prior), 2)) / F.sum("n")
    noise = F.sum(F.col(prior) * (1 - F.col(prior))) / F.sum("n")
    mean = F.sum(F.col("s")) / F.sum("n")
    row = sites.agg(spread.alias("spread"), noise.alias("noise"), mean.alias("mean")).first()
    if row["mean"] is None:
        return 1.0
    between = max((row["spread"] or 0.0) - (row["noise"] or 0.0), 1e-9)
    return min(max(row["mean"] * (1 - row["mean"]) / between - 1, 1.0), 1e6)


def site_posteriors(rows: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """Per host and path: ``n``, sum ``s`` of evidence, posterior ``host_mean``, ``path_strength``; and the corpus mean."""
    paths = rows.groupBy(host, path).agg(F.count("*").alias("n"), F.sum("evidence").alias("s"))
    paths = materialise(paths, "paths")
    whole = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (whole["s"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    hosts = paths.groupBy(F.col(host).alias("__host")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("corpus", F.lit(mean))
    k = _strength(hosts, "corpus")
    hosts = hosts.select("__host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_mean"))
    both = paths.join(hosts, F.col(host).eqNullSafe(F.col("__host"))).drop("__host")
    inner = _strength(both, "host_mean")
    return both.withColumn("path_strength", F.lit(inner)), mean


def classify_quality(df: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Per row: id, held_out, doc_chance, host_mean, path_mean, score, kept.

    ``labels`` has the id and ``quality`` (0/1). Labels of held-out rows are
    never used; other labelled rows give their label as evidence of their site.
    Documents have no address: ``host_col`` and ``path_col`` name the columns
    that stand for its two levels. Null hosts and paths are sites of their own;
    null and empty texts have the evidence of a text without words; repeated
    rows count as rows; an empty table gives an empty result.
    """
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max("quality").cast("int").alias("__label"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path")).withColumn("held_out", held_out(F.col("id")))
    # The labels are sampled first: a table of about two times ``sample`` rows goes to the texts.
    chosen = sample_by_hash(known.filter(~held_out(F.col("__id"))), "__id", "__label", sample)
    model = _fit_rows(rows.join(F.broadcast(chosen), F.col("id") == F.col("__id")).select("text", F.col("__label").alias("label")))
    scored = document_chances(rows, model, ["id", "host", "path", "held_out"])
    with_label = scored.join(known, F.col("id") == F.col("__id"), "left")
    evidence = F.when(~F.col("held_out") & F.col("__label").isNotNull(), F.col("__label").cast("double")).otherwise(F.col("chance"))
    scored = materialise(with_label.select("id", "host", "path", "held_out", "chance", evidence.alias("evidence")), "chances")
    sites, mean = site_posteriors(scored, "host", "path")
    sites = sites.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "n", "s", "host_mean", "path_strength")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path")))
    prior = (F.col("s") - F.col("evidence") + F.col("path_strength") * F.col("host_mean")) / (F.col("n") - 1 + F.col("path_strength"))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    final = 1 / (1 + F.exp(-(odds(F.col("chance")) + odds(prior) - odds(F.lit(mean)))))
    return joined.select(F.col("id").alias(id_col), "held_out", F.col("chance").alias("doc_chance"), "host_mean", prior.alias("path_mean"), final.alias("score")).withColumn("kept", F.col("score") >= threshold)
