"""Exact top-k search by integer inner product, with pivot-table elimination.

Distances of every vector to many pivots are computed once. For a query ``q`` and a candidate ``x``
the triangle inequality bounds their distance from below by the largest ``|d(q, p) - d(x, p)|``,
and with it the inner product ``(|q|² + |x|² - d(q, x)²) / 2`` from above. Candidates are evaluated
in the order of that bound until it falls below the k-th best score found: no later one can enter.

Queries and candidates meet in blocks, each pair of blocks in a task of its own, so a task holds two
blocks whatever the table's size. Pivots are chosen farthest first from a bounded sample; they affect
the work, not the result.

Edges: vectors that are null or hold null or non-finite components take no part, nor do rows with a
null ``vec_id``. Rows that share a ``vec_id`` are one vector, the smallest in array order. Shorter
vectors count as padded with zeros. A score that does not fit 64 bits raises where it is evaluated, which
those of a query's best always are. Ties go to the smaller ``vec_id``. Other columns of the input are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from metertide.workspace import materialize

BLOCK_ROWS, SAMPLE_ROWS, PIVOTS, STEP = 4096, 1024, 32, 256
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: Scores from here on, of either sign, do not fit 64 bits, or may not by the error of doubles.
TOO_LARGE = float(1 << 63) * (1 - 1e-9)


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``numbers``: floor(scale * component), one row per id."""
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform(
                "embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")
            ).alias("numbers"),
        )
        .groupBy("vec_id")
        .agg(F.min("numbers").alias("numbers"))
    )


def matrix(numbers, width: int = 0) -> np.ndarray:
    """Rows of an Arrow list column, padded with zeros to the longest or to ``width``."""
    numbers = numbers.combine_chunks() if isinstance(numbers, pa.ChunkedArray) else numbers
    lengths = np.diff(numbers.offsets.to_numpy())
    width = max(width, int(lengths.max(initial=0)))
    flat = numbers.flatten().to_numpy()
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    rows = np.zeros((len(lengths), width), dtype=np.int64)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample.astype(float)
    rows = sample.astype(float)
    chosen, nearest = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        nearest = np.minimum(nearest, np.linalg.norm(rows - rows[chosen[-1]], axis=1))
        chosen.append(int(nearest.argmax()))
    return rows[chosen]


def with_pivot_table(numbers: DataFrame, pivots: np.ndarray) -> DataFrame:
    def measure(batches):
        for batch in batches:
            rows = matrix(batch.column("numbers"), pivots.shape[1] if pivots.ndim > 1 else 0)
            rows = rows.astype(float)
            wide = np.zeros((len(pivots), rows.shape[1]))
            wide[:, : pivots.shape[1]] = pivots
            far = np.stack([np.linalg.norm(rows - p, axis=1) for p in wide], axis=1)
            lists = pa.ListArray.from_arrays(
                np.arange(0, far.size + 1, far.shape[1], dtype=np.int32), far.ravel()
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("numbers"), lists],
                ["vec_id", "numbers", "distances"],
            )

    return numbers.mapInArrow(measure, "vec_id long, numbers array<long>, distances array<double>")


def best_of(queries, candidates, k: int):
    """Per query the ids and scores of its k best candidates, and how many were evaluated."""
    query_ids, asked, query_far = queries
    ids, rows, far = candidates
    norms, query_norms = (rows * rows).sum(axis=1), (asked * asked).sum(axis=1)
    exact = float(norms.max(initial=0.0)) * float(query_norms.max(initial=0.0)) < EXACT**2
    numbers = rows if exact else rows.astype(np.int64)
    evaluated = 0
    for q, query_id in enumerate(query_ids.tolist()):
        gap = np.abs(far - query_far[q]).max(axis=1)
        total = norms + query_norms[q]
        bound = (total - gap * gap) / 2 + 1e-9 * total + 1e-3
        bound[ids == query_id] = -np.inf
        order = np.argsort(-bound, kind="stable")
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        query = asked[q] if exact else asked[q].astype(np.int64)
        for begin in range(0, len(order), STEP):
            part = order[begin : begin + STEP]
            part = part[np.isfinite(bound[part])]
            full = len(scores) >= k
            if not len(part) or full and bound[part[0]] < scores[-1]:
                break
            if not exact and (np.abs(rows[part] @ asked[q]) >= TOO_LARGE).any():
                raise OverflowError("an inner product does not fit 64 bits")
            evaluated += len(part)
            found = np.concatenate([found, ids[part]])
            scores = np.concatenate([scores, (numbers[part] @ query).astype(np.int64)])
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
        yield query_id, found, scores, evaluated


def _table(part: pa.Table, width: int = 0):
    rows = matrix(part["numbers"], width).astype(float)
    far = part["distances"].combine_chunks()
    return part["vec_id"].to_numpy(), rows, far.flatten().to_numpy().reshape(len(rows), -1)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best other rows of every query row."""
    numbers = materialize(whole_numbers(vectors), "whole-numbers")
    sample = numbers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    pivots = choose_pivots(matrix(pa.table(sample.select("numbers").toArrow())["numbers"]))
    measured = materialize(with_pivot_table(numbers, pivots), "pivot-table")
    queries = measured.filter(is_query)
    blocks = max(1, -(-measured.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // block_rows))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("query_block", block(query_blocks)).withColumn("block", every(blocks))
    right = measured.withColumn("block", block(blocks)).withColumn(
        "query_block", every(query_blocks)
    )

    def search(asked: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if len(asked) and len(candidates):
            own, other = _table(asked), _table(candidates)
            width = max(own[1].shape[1], other[1].shape[1])
            own, other = (
                (x[0], np.pad(x[1], ((0, 0), (0, width - x[1].shape[1]))), x[2])
                for x in (own, other)
            )
            found = list(best_of(own, other, k))
        return pa.table(
            {
                "query_id": pa.array([q for q, ids, _, _ in found for _ in ids], pa.int64()),
                "vec_id": pa.array([i for _, ids, _, _ in found for i in ids.tolist()], pa.int64()),
                "score": pa.array([s for *_, x, _ in found for s in x.tolist()], pa.int64()),
            }
        )

    found = (
        left.groupBy("query_block", "block")
        .cogroup(right.groupBy("query_block", "block"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
