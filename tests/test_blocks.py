"""Pairs by blocks against all pairs, and what they leave on the disk."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import blocks
from plumbline.plans import catalogue


@pytest.mark.parametrize("tau", [0.4, 0.6, 1.0])
def test_pairs_equal_brute_force(spark, tau, monkeypatch):
    monkeypatch.setattr(blocks, "WEIGHT", 700)
    draw = random.Random(5)
    sets = {}
    for i in range(120):
        base = sets[draw.randrange(i)] if i and draw.random() < 0.6 else set()
        sets[i] = {t for t in base if draw.random() < 0.9} | {draw.randrange(-(1 << 62), 1 << 62) for _ in range(draw.choice([0, 1, 3, 40]))}
    sets[200], sets[201] = set(sets[40]), set()
    d = spark.createDataFrame([(i, list(x)) for i, x in sets.items()], "id long, s array<long>")
    want = {(a, b, len(x & y), len(x) + len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and len(x & y) >= tau * len(x | y) - 1e-9}
    got = [tuple(r) for r in blocks.jaccard_pairs(d, tau).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_no_pairs_of_no_sets(spark):
    assert blocks.jaccard_pairs(spark.createDataFrame([(1, [])], "id long, s array<long>"), 0.5).count() == 0


def test_body_pairs_shuffle_no_candidates(spark):
    """Bodies share their words with most others; what is joined is files alone."""
    plan = catalogue.queries()["body_jaccard_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan and "explode" not in plan and "MapInArrow" in plan
