"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of the most frequent n-grams (one to three
letters, words padded by a blank). A text's own profile is compared with each
language's by out-of-place distance: the sum of rank differences, with the
greatest one for n-grams that the language's profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, sample_by_hash

#: N-grams in a profile, and labelled documents sampled for each language's profile.
PROFILE, SAMPLE = 400, 2000
_BITS = 21


def ngram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of one to three characters; anything but letters counts as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kinds, at = np.unique(points, return_inverse=True)
    letter = np.fromiter((chr(k).isalpha() for k in kinds.tolist()), dtype=bool, count=len(kinds))[at]
    points = np.where(letter, points, 32)
    points = np.concatenate([[32], points, [32]])
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    ones = points[points != 32]
    twos = points[:-1] << _BITS | points[1:]
    threes = points[:-2] << (2 * _BITS) | points[1:-1] << _BITS | points[2:] if len(points) > 2 else points[:0]
    return np.concatenate([ones, twos, threes]) if len(ones) else ones


def ranked(text: str, size: int) -> np.ndarray:
    """A text's ``size`` most frequent n-grams, most frequent first; ties go by code."""
    codes, counts = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:size]]


def learn_profiles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Each language's ranked n-grams, from about ``sample`` labelled documents of it.

    N-grams are counted in the tasks and summed by Spark; ``size`` of them a
    language come to the driver. Ties go by code.
    """
    labelled = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    bounded = sample_by_hash(labelled, "id", "lang", sample)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                found = [ngram_codes(t) for t in texts]
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": codes, "n": counts})

    sums = bounded.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = sums.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, size).alias("top"))
    return {r["lang"]: np.array([x["code"] for x in r["top"]], dtype=np.int64) for r in top.collect()}


def detect_language(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """Id, ``lang_pred`` and ``score`` in 0..1 of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or no profile
    is known. The score grows with the gap between the two nearest languages;
    ties go to the first name. Repeated rows are rows of their own and get the
    same answer; extra columns are ignored; an empty table gives an empty
    result.
    """
    bounded_batches(df.sparkSession)
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, dtype=np.int64)
    places = np.full((len(names), len(known) + 1), -1, dtype=np.int64)
    for k, name in enumerate(names):
        places[k, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(text, size) if text and names else known[:0]
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(known, own)
        at = np.where(known[np.minimum(at, len(known) - 1)] == own, at, len(known))
        place = places[:, at]
        away = np.where(place < 0, size, np.abs(place - np.arange(len(own)))).sum(axis=1)
        order = np.argsort(away, kind="stable")
        if len(names) == 1:
            return names[0], 1.0
        first, second = int(away[order[0]]), int(away[order[1]])
        return names[order[0]], float((second - first) / second) if second else 0.0

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [one(t) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(detect, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_documents(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    profiles = learn_profiles(df.filter(~held_out(F.col("doc_id"))))
    found = detect_language(df, profiles)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
