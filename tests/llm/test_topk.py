import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metertide.llm.topk import best_of, choose_pivots, top_k


def brute_force(rows, k=5):
    """(query, rank, id, score) for rows (id, vector), of queries divisible by 50."""
    numbers = {}
    for key, vector in rows:
        if key is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = [math.floor(256 * float(np.float32(x))) for x in vector]
        numbers[key] = min(numbers.get(key, own), own)
    result = []
    for q, a in numbers.items():
        if q % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in numbers.items() if i != q]
        result += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(result)


def found(spark, rows, **options):
    schema = "vec_id long, embedding array<float>, label int, score string, block string"
    df = spark.createDataFrame([(k, v, 0, "x", "y") for k, v in rows], schema)
    result = top_k(df, F.col("vec_id") % 50 == 0, **options)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in result.collect())


@pytest.mark.parametrize("block_rows", [4096, 70])
def test_clustered_and_repeated_vectors(spark, block_rows):
    rng = random.Random(block_rows)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, centres[0]) for i in range(300, 400)]  # ties
    assert found(spark, rows, block_rows=block_rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = [
        (0, [0.1, -0.2]), (50, [1.0, 1.0]), (100, None), (150, [1.0, None]), (200, [float("nan"), 1.0]),
        (250, [float("inf"), 0.0]), (None, [1.0, 1.0]), (1, [0.5]), (2, [0.5, 0.5, 9.0]), (3, []),
        (0, [0.1, -0.2]), (4, [-1e4, 1e4]), (5, [0.0, 0.0]), (5, [0.2, 0.0]), (300, []),
    ]
    assert found(spark, rows) == brute_force(rows)


def test_fewer_rows_than_asked_for(spark):
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_far_candidates_are_never_evaluated():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (20, 16))
    rows = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 16)))
    pivots = choose_pivots(rows[:500], 32)
    far = np.stack([np.linalg.norm(rows - p, axis=1) for p in pivots], axis=1)
    ids = np.arange(len(rows))
    side = ids[:30], rows[:30], far[:30]
    evaluated = 0
    for q, chosen, scores, count in best_of(side, (ids, rows, far), 5):
        exact = (rows @ rows[q]).astype(np.int64)
        exact[q] = -(2**62)
        order = np.lexsort((ids, -exact))[:5]
        assert chosen.tolist() == order.tolist()
        assert scores.tolist() == exact[order].tolist()
        evaluated = count
    assert evaluated < 0.5 * 30 * len(rows)


def test_large_numbers_stay_exact():
    rows = np.array([[2.0**30, 2.0**30 - 1], [2.0**30, 2.0**30], [1.0, 1.0], [2.0**30 - 1, 2.0**30]])
    far = np.zeros((4, 1))
    (_, chosen, scores, _), *_ = best_of((np.array([0]), rows[:1], far[:1]), (np.arange(4), rows, far), 3)
    whole = [[int(x) for x in r] for r in rows]
    exact = sorted(((-sum(a * b for a, b in zip(whole[0], r, strict=True)), i) for i, r in enumerate(whole) if i), key=tuple)
    assert list(zip(chosen.tolist(), scores.tolist(), strict=True)) == [(i, -s) for s, i in exact]


def test_scores_beyond_64_bits_raise_and_large_ones_are_exact(spark):
    with pytest.raises(Exception, match="does not fit 64 bits"):
        found(spark, [(50, [3e8, 2.0]), (1, [3e8, 1.0])])
    rows = [(50, [1e7, 2.0]), (1, [1e7, 1.0]), (2, [-1e7, 3.0]), (3, [1e7 + 1, 1.0])]
    assert found(spark, rows) == brute_force(rows)
