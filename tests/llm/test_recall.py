"""Pairs at the very threshold of the n-gram Jaccard join are found."""

import random

from edgewise.llm import near_dedup


def test_recall_of_pairs_at_the_threshold(spark):
    """184 words have 180 shingles; four changed words, far from one another, leave 160 of 200: 0.8 exactly."""
    rng, rows = random.Random(17), []
    for k in range(400):
        one = [f"w{rng.randrange(10**9)}" for _ in range(184)]
        two = list(one)
        for at in (20, 60, 100, 150):
            two[at] = f"v{rng.randrange(10**9)}"
        a, b = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (one, two))
        assert len(a & b) / len(a | b) == 0.8
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = sum(found[2 * k + 1] == found[2 * k] == 2 * k for k in range(400))
    assert joined >= 398 and all(c // 2 == d // 2 for d, c in found.items())
