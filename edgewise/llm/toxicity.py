"""Toxicity by maximum-scoring segment search.

Word log-odds come from labelled documents under Dirichlet priors that nest:
a word shrinks to its five-letter start, that to its four-letter start, that to
the corpus. A linear scan over a text's word scores finds every maximal
segment; their scores are calibrated by an extreme-value distribution fitted to
clean labelled documents, and a document's segments are put together by the
distribution of the sum of the best of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, materialise, sample_by_hash

#: Labelled documents of each class that are learned from, and prior strengths of a level over the next.
SAMPLE, STRENGTH = 20_000, 20.0
#: Cost of each word: words that a chance passage of toxic documents shares stay below it and add up to nothing.
#: The least significance of a reported passage.
DRIFT, PASSAGE_P = 1.5, 1e-3
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def maximal_segments(scores: np.ndarray | list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    A stack of candidates with their sums before and after; a new candidate
    swallows earlier ones as long as that raises the total (Ruzzo and Tompa).
    Only words with a positive score open candidates; running sums cover the rest.
    """
    scores = np.asarray(scores, dtype=np.float64)
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []
    for at, total, score in zip(positive.tolist(), sums[positive].tolist(), scores[positive].tolist(), strict=True):
        start, left = at, total - score
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                stack.append((start, at + 1, left, total))
                break
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
    return [(s, e, right - left) for s, e, left, right in stack]


#: Words whose scores a worker keeps; the table is emptied when full.
CACHE = 60_000


def _code(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token)


def _starts(word: str) -> tuple[str, str, str]:
    return word, word[:5], word[:4]


class Model:
    """Log-odds of words and starts, the extreme-value fit and the final logistic map.

    A level holds the sorted 64-bit codes of its tokens and their log-odds: 12
    bytes for each token of the labelled sample, none left out.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.levels = levels
        self.location, self.scale = 0.0, 1.0
        self.slope, self.offset = 1.0, 0.0
        self.cache: dict[str, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def words(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words: of the word, else of its five letters, else of its four; unknown ones have no odds."""
        out, open_ = np.zeros(len(words)), np.ones(len(words), dtype=bool)
        for (codes, odds), tokens in zip(self.levels, zip(*map(_starts, words), strict=True), strict=True):
            own = np.fromiter(map(_code, tokens), dtype=np.uint64, count=len(tokens))
            at = np.minimum(np.searchsorted(codes, own), max(len(codes) - 1, 0))
            hit = open_ & (codes[at] == own) if len(codes) else np.zeros(len(words), dtype=bool)
            out[hit] = odds[at[hit]]
            open_ &= ~hit
        return out - DRIFT

    def scores(self, text: str | None) -> np.ndarray:
        """Score of each word of a text."""
        words = words_of(text)
        cache = self.cache
        try:
            return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
        except KeyError:
            if len(cache) > CACHE:
                cache.clear()
            new = list(set(words).difference(cache))
            cache.update(zip(new, self.words(new).tolist(), strict=True))
            return np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))

    def standard(self, scores: list[float], length: int) -> list[float]:
        """Segments' scores in units of the clean model: the greatest of n words' segments grows as the logarithm of n."""
        return [(s - self.location) / self.scale - math.log1p(length) for s in scores]

    def evidence(self, scores: list[float], length: int) -> float:
        """Minus the logarithm of the chance of so high a sum of the best segments, for the best number of them, in a clean text."""
        x = sorted(self.standard(scores, length), reverse=True)
        best, total, factorials = 0.0, 0.0, 0.0
        for r, one in enumerate(x, 1):
            if r == 1:
                best = -math.log(max(self._tail(one), 1e-300)) if one < 600 else one
                total = one
                continue
            total += one
            factorials += math.log(r) + math.log(r - 1)
            if one <= 0 or total <= r:
                break
            # Chance of a sum of r over the total, times 2 ** r for the choice of r.
            best = max(best, total - (r - 1) * math.log(total) + factorials - r * math.log(2))
        return best

    @staticmethod
    def _tail(x: float) -> float:
        """Gumbel: chance of a greatest segment over x."""
        return -math.expm1(-math.exp(min(-x, 700.0)))

    def raw(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """A text's evidence, and its segments (start and end in words, score, chance in a clean text of that length)."""
        scores = self.scores(text)
        found = maximal_segments(scores)
        each = [s for _, _, s in found]
        return self.evidence(each, len(scores)), [(*f, self._tail(x)) for f, x in zip(found, self.standard(each, len(scores)), strict=True)]

    def score(self, raw: float) -> float:
        x = self.slope * math.asinh(raw) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _counts(labelled: DataFrame) -> DataFrame:
    """Of each word and start, by code: the code of the start it shrinks to, and in how many clean and toxic documents it is."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tables = [(Counter(), Counter()) for _ in range(3)]
            for text, label in zip(frame["text"], frame["label"], strict=True):
                words = set(words_of(text))
                for level, keys in enumerate((words, {w[:5] for w in words}, {w[:4] for w in words})):
                    tables[level][int(label)].update(keys)
            for level, (clean, toxic) in enumerate(tables):
                tokens = list(clean.keys() | toxic.keys())
                codes = lambda x: np.fromiter(map(_code, x), dtype=np.uint64, count=len(tokens)).view(np.int64)
                parents = codes([t[: 5 - level] for t in tokens]) if level < 2 else 0
                yield pd.DataFrame({"level": level, "code": codes(tokens), "parent": parents, "clean": [clean[t] for t in tokens], "toxic": [toxic[t] for t in tokens]})

    sums = labelled.mapInPandas(count, "level int, code long, parent long, clean long, toxic long")
    return sums.groupBy("level", "code", "parent").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``text`` and ``label`` (0/1) of at most about ``sample`` documents of each class.

    Null labels are left out; null texts are empty. Without both classes every
    score is 0. The counts are summed by Spark; the sample's tokens, 36 bytes
    each, come to the driver.
    """
    return _fit(sample_by_hash(labelled.filter(F.col("label").isin(0, 1)), "id", "label", sample))


def _fit(sampled: DataFrame) -> Model:
    rows = materialise(sampled.select("text", "label"), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.float32))
        model = Model([none, none, none])
        model.slope, model.offset = 0.0, -1e3
        return model
    base = toxic / (clean + toxic)
    table = _counts(rows).toArrow()  # bounded by the sample
    column = {c: table.column(c).to_numpy() for c in table.column_names}
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    above: tuple[np.ndarray, np.ndarray] | None = None
    for level in (2, 1, 0):
        own = np.flatnonzero(column["level"] == level)
        codes = column["code"][own].view(np.uint64)
        order = np.argsort(codes)
        own, codes = own[order], codes[order]
        prior = base if above is None else above[1][np.searchsorted(above[0], column["parent"][own].view(np.uint64))]
        n0, n1 = column["clean"][own], column["toxic"][own]
        rates = (n1 + STRENGTH * prior) / (n0 + n1 + STRENGTH)
        above = (codes, rates)
        sure = np.clip(rates, 1e-6, 1 - 1e-6)
        levels.insert(0, (codes, (np.log(sure / (1 - sure)) - math.log(base / (1 - base))).astype(np.float32)))
    model = Model(levels)
    _calibrate(model, rows)
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Gumbel location and scale from clean documents; then a logistic map of the evidence."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sample; loaded once a worker

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            each, length = [], []
            for text in frame["text"]:
                scores = shared.value.scores(text)
                each.append([s for _, _, s in maximal_segments(scores)])
                length.append(len(scores))
            yield pd.DataFrame({"label": frame["label"], "each": each, "length": length})

    found = rows.mapInPandas(segments, "label int, each array<double>, length long").toArrow().to_pydict()  # bounded by the sample
    shared.destroy()  # the workers need not hold it beside the finished model
    y, length = np.array(found["label"], dtype=float), np.log1p(np.array(found["length"], dtype=float))
    best = np.array([max(x, default=0.0) for x in found["each"]])
    # Quantiles of the Gumbel distribution, which a few mislabelled documents don't move;
    # the location moves with the logarithm of the length.
    middle, high = -math.log(-math.log(0.5)), -math.log(-math.log(0.9))
    spread = lambda x: max(float(np.quantile(x, 0.9) - np.quantile(x, 0.5)) / (high - middle), 0.05)
    clean, size = best[y == 0], length[y == 0]
    model.scale = spread(clean - spread(clean) * size)
    model.location = float(np.quantile(clean - model.scale * size, 0.5)) - middle * model.scale
    x = np.arcsinh(np.array([model.evidence(e, n) for e, n in zip(found["each"], found["length"], strict=True)]))  # one sure word tells nearly as much as many
    centre, width = x.mean(), max(x.std(), 1e-9)
    z, a, b = (x - centre) / width, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * z).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        d = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    a = max(a, 0.0)
    model.slope, model.offset = a / width, b - a * centre / width


def score_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Id, ``score`` in 0..1, ``predicted`` and ``passages`` (words start and end, score, p_value) of every whole text.

    Empty and null texts have no words: they get the score of no evidence.
    ``passages`` holds every significant maximal segment. Repeated rows are
    scored alike, each as a row; extra columns are ignored; an empty table
    gives an empty result. No shuffle.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            model, scores, passages = shared.value, [], []
            for text in frame["text"]:
                raw, found = model.raw(text)
                scores.append(model.score(raw))
                passages.append([{"start": s, "end": e, "score": x, "p_value": p} for s, e, x, p in found if p <= PASSAGE_P])
            yield pd.DataFrame({"id": frame["id"], "score": scores, "passages": passages})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(scan, f"id {kind}, score double, passages array<struct<start:int,end:int,score:double,p_value:double>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def learn_from_tables(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows of ``docs`` that are not held out.

    The labels are sampled before they meet the texts, so that the small sample
    goes to the documents and no text is shuffled.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = sample_by_hash(known, "id", "label", sample)  # about two times ``sample`` rows at most
    return _fit(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")))


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows whose score is below ``threshold``, all columns, repeated rows included. One narrow pass, no shuffle.

    Null and empty texts have no evidence and stay; an empty table stays empty.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(model.raw(t)[0]) for t in texts], dtype="float64")

    return df.filter(score(F.col(text_col)) < threshold)
