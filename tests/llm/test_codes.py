import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from metertide.llm.codes import as_tree, assign, codebooks_sha256, compress_vectors, tree_order, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, ids string"


def brute_force(rows, rounds=6):
    """Codes, errors, label sums and the checksum by plain loops."""
    kept = [
        (key, [math.floor(4096 * float(np.float32(x))) for x in vector], label)
        for key, vector, label in rows
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    longest = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-longest // 8))
    parts = [[(v + [0] * (8 * width - len(v)))[p * width : (p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[list(own[p]) for own in parts[:16]] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            chosen = [nearest(own[p], books[p])[1] for own in parts]
            moved = []
            for e, entry in enumerate(books[p]):
                own = [parts[i][p] for i, c in enumerate(chosen) if c == e]
                moved.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else entry)
            books[p] = moved
    numbers = [x for p in range(8) for entry in books[p] for x in entry]
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    result, sums = [], {}
    for (key, _, label), own in zip(kept, parts, strict=True):
        best = [nearest(own[p], books[p]) for p in range(8)]
        error = sum(d for d, _ in best)
        sums[label] = sums.get(label, 0) + error
        result.append((key, label, "".join(f"{e:02x}" for _, e in best), error))
    return sorted(((k, c, e, sums[x]) for k, x, c, e in result), key=str), digest


def found(spark, rows, partitions=3, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(partitions)
    coded, books = compress_vectors(df, **options)
    result = with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()
    return sorted((tuple(r) for r in result), key=str), codebooks_sha256(books)


@pytest.mark.parametrize("block_rows", [4096, 90])
def test_clustered_and_repeated_vectors(spark, block_rows):
    rng = random.Random(block_rows)
    centres = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], i % 4) for i in range(500)]
    rows += [(i, centres[0], None) for i in range(500, 700)]  # a third are one vector
    rng.shuffle(rows)
    assert found(spark, rows, block_rows=block_rows) == brute_force(rows)


def test_odd_rows(spark):
    rows = [
        (3, [0.1, -0.2], 1), (1, None, 1), (2, [1.0, None], 1), (4, [float("nan"), 1.0], None),
        (5, [float("-inf"), 0.0], None), (None, [1.0, 1.0], None), (6, [0.5], 2), (7, [0.5] * 9, 2),
        (8, [], None), (3, [0.1, -0.2], 1), (3, [0.1, -0.3], 1), (9, [-0.00001] * 16, 1),
    ]
    assert found(spark, rows) == brute_force(rows)
    assert found(spark, [(i, [i / 7, -i / 3] * 8, None) for i in range(40)]) == brute_force(
        [(i, [i / 7, -i / 3] * 8, None) for i in range(40)]
    )


def test_no_rows(spark):
    assert found(spark, []) == brute_force([])
    assert found(spark, [(1, None, 1)]) == ([], hashlib.sha256(b"").hexdigest())


def test_numbers_too_large_raise(spark):
    with pytest.raises(PySparkException, match="too large"):
        found(spark, [(1, [4e4], 1)])


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_that_of_all_distances(seed):
    rng = np.random.default_rng(seed)
    count, width, entries = (int(rng.integers(1, n)) for n in (400, 9, 17))
    high = int(rng.choice([2, 50, 4000]))
    points = rng.integers(-high, high, (count, width))
    if seed % 3 == 0:
        points = points[rng.integers(0, 5 if count > 5 else 1, count)] + rng.integers(-1, 2, (count, width))
    book = points[rng.integers(0, count, entries)] if seed % 2 else rng.integers(-high, high, (entries, width))
    order = tree_order(points)
    assert sorted(order.tolist()) == list(range(count))
    found = assign(as_tree(points[order]), book, each=True)
    far = ((points[order][:, None] - book[None]) ** 2).sum(axis=2)
    assert found.entry.tolist() == far.argmin(axis=1).tolist()
    assert found.error.tolist() == far.min(axis=1).tolist()
    sums = np.zeros_like(book)
    np.add.at(sums, far.argmin(axis=1), points[order])
    assert np.array_equal(sums, found.sums)
    assert np.array_equal(np.bincount(far.argmin(axis=1), minlength=entries), found.counts)


def test_whole_nodes_are_assigned_by_their_sums():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (10, 8))
    points = centres[rng.integers(0, 10, 4096)] + rng.integers(-60, 60, (4096, 8))
    found = assign(as_tree(points[tree_order(points)]), centres)
    assert found.points_decided < 0.2 * len(points)
    assert found.whole_nodes < 200
