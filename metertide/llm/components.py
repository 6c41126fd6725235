"""Connected components of links between whole numbers, spread over tasks and rounds."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metertide.workspace import materialize

LINK = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as connect the same numbers: each number with the smallest of its component."""
    names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = index[: len(a)], index[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root[a], root[b]):
            break
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def forest_of_batches(links: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 20):
    """Links of one task, thinned to a forest whenever ``most`` have gathered, as Arrow batches."""
    held, count = [], 0

    def thinned():
        return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    for a, b in links:
        if len(a):
            held.append((a, b))
            count += len(a)
        if count > most:
            held = [thinned()]
            count = len(held[0][0])
            if count > most // 2:  # all of them are needed
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["a", "b"])
                held, count = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in thinned()], ["a", "b"])


def _smallest(links: DataFrame, whole: bool) -> DataFrame:
    """Each number's neighbours linked to the smallest neighbour instead: of all larger ones, or
    (``whole``) of the smaller ones and the number itself."""
    if whole:
        around = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    # Written, so that the join shuffles by itself and can split a number with very many links.
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least.select("u", F.least("u", "m").alias("m")), "smallest")
    moved = around.join(least, "u")
    if whole:
        links = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        links = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return links.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest number) of all numbers in ``links`` (a, b).

    Two steps in turn, until nothing changes: link all larger neighbours of a number to its smallest
    one, then all smaller neighbours. Every round is written, so lineage stays short.
    """
    links = materialize(links.filter("a <> b").distinct(), "links")
    seen = None
    while True:
        links = materialize(_smallest(_smallest(links, whole=False), whole=True), "links")
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
