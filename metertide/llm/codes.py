"""Vector code compression: product codebooks by dual-tree Lloyd rounds, in whole numbers.

Components become ``floor(4096 * x)``, vectors are cut into equal consecutive parts, and each part
position gets a codebook. A round assigns every part to the nearest entry and moves each entry to the
floor of its parts' mean.

*Trees.* Rows are taken in blocks as they lie, without a shuffle. In each block and position the parts
are put in the order of a balanced tree, which halves them at the median of their widest component, and
are written so once. A node of the tree is a range of that order, with a box around its parts; sums
of the parts of a node come from one running sum. The entries of a codebook are the leaves of a tree
of their own, made anew each round.

*Round.* Pairs of nodes are walked from the roots down. The nearest that a part's box can come to an
entry node's box is compared with the farthest that some entry can lie from the part's box; a
combination beyond it is dropped. A part node with one entry left goes there whole, with its cached sum.
Leaves with several entries left are decided part by part. All bounds and distances are whole numbers,
so none is rounded and ties go to the lower index. Tasks return sums per entry, and only those (entries
times components, whatever the input) come to the driver.

Edges: rows whose vector is null or holds null or non-finite components are left out. Every other row
has a result, also with a null or repeated ``vec_id``; among those that start a codebook, null ids
come last and rows of one id go by their vector. With fewer rows than entries there are fewer entries.
Vectors are padded with zeros to the longest one's length, rounded up to whole parts. Components of
2**27 and more in whole numbers raise, as squares would overflow. Equal labels are summed with nulls as
one label. Other columns of the input are ignored. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metertide.workspace import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block, and parts of a tree's leaf at most.
BLOCK_ROWS, LEAF = 4096, 32
#: Whole numbers stay below this.
LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``numbers`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x):
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < LARGEST, value).otherwise(
            F.raise_error(F.lit("a component is too large for whole numbers")).cast("long")
        )

    return vectors.filter(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        F.transform("embedding", whole).cast("array<int>").alias("numbers"),
    )


def matrix(numbers: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    lengths = np.diff(numbers.offsets.to_numpy())
    flat = numbers.flatten().to_numpy().astype(np.int64)
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    rows = np.zeros((len(lengths), width), dtype=np.int64)
    rows[np.arange(width) < lengths[:, None]] = flat
    return rows


@dataclass
class Tree:
    """Nodes over ``points`` in tree order; node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    points: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def inner(self) -> int:
        """Nodes from here on are leaves."""
        return len(self.begins) // 2


def levels(count: int, leaf: int) -> int:
    """Levels below the root, so that no leaf has more than ``leaf`` points."""
    return max(0, (-(-count // leaf) - 1).bit_length())


def node_ranges(count: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the nodes of all levels begin and end: each level cuts the order into equal parts."""
    cuts = [np.arange((1 << d) + 1) * count >> d for d in range(depth + 1)]
    return np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])


def tree_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of the points in a tree that halves them at the median of their widest component."""
    depth, count = levels(len(points), leaf), len(points)
    order = np.arange(count)
    for d in range(depth):
        cuts = np.arange((1 << (d + 1)) + 1) * count >> (d + 1)
        for node in range(1 << d):
            begin, middle, end = cuts[2 * node : 2 * node + 3].tolist()
            own = points[order[begin:end]]
            if begin < middle < end:
                widest = int(np.ptp(own, axis=0).argmax())
                order[begin:end] = order[begin:end][
                    np.argpartition(own[:, widest], middle - begin, kind="introselect")
                ]
    return order


def as_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of points that are in tree order already. A node without points has the box of zeros."""
    begins, ends = node_ranges(len(points), levels(len(points), leaf))
    low = np.zeros((len(begins), points.shape[1]), dtype=np.int64)
    high = low.copy()
    inner = len(begins) // 2
    for i in range(inner, len(begins)):
        own = points[begins[i] : ends[i]]
        if len(own):
            low[i], high[i] = own.min(axis=0), own.max(axis=0)
    for i in range(inner - 1, -1, -1):
        with_points = [c for c in (2 * i + 1, 2 * i + 2) if ends[c] > begins[c]]
        if with_points:
            low[i], high[i] = low[with_points].min(axis=0), high[with_points].max(axis=0)
    return Tree(points, begins, ends, low, high)


def box_distances(low, high, other_low, other_high) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance between points of two boxes each."""
    gap = np.maximum(0, np.maximum(other_low - high, low - other_high))
    span = np.maximum(np.abs(other_high - low), np.abs(high - other_low))
    return (gap * gap).sum(axis=-1), (span * span).sum(axis=-1)


def entry_tree(entries: np.ndarray) -> tuple[Tree, np.ndarray]:
    order = tree_order(entries, 1)
    return as_tree(entries[order], 1), order


@dataclass
class Assigned:
    """Sums and counts per entry; entries and squared distances per point are filled if asked for."""

    sums: np.ndarray
    counts: np.ndarray
    whole_nodes: int
    points_decided: int
    entry: np.ndarray | None = None
    error: np.ndarray | None = None


def assign(tree: Tree, entries: np.ndarray, each: bool = False) -> Assigned:
    """Assign all points of the tree to their nearest entry, ties to the lower index."""
    count = len(tree.points)
    result = Assigned(np.zeros_like(entries), np.zeros(len(entries), dtype=np.int64), 0, 0)
    if each:
        result.entry, result.error = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    running = np.concatenate(
        [np.zeros((1, entries.shape[1]), dtype=np.int64), np.cumsum(tree.points, axis=0)]
    )
    book, index = entry_tree(entries)
    # Pairs of part node and entry node, level by level of the parts' tree.
    nodes, others = np.array([0]), np.array([0])
    while len(nodes):
        # Entry nodes are opened until only entries are left, pruned at each level.
        while True:
            near, far = box_distances(
                tree.low[nodes], tree.high[nodes], book.low[others], book.high[others]
            )
            limit = np.full(len(tree.begins), np.iinfo(np.int64).max)
            np.minimum.at(limit, nodes, far)
            kept = near <= limit[nodes]
            nodes, others = nodes[kept], others[kept]
            inner = others < book.inner
            if not inner.any():
                break
            below = np.concatenate([2 * others[inner] + 1, 2 * others[inner] + 2])
            above = np.concatenate([nodes[inner]] * 2)
            held = book.ends[below] > book.begins[below]
            nodes = np.concatenate([nodes[~inner], above[held]])
            others = np.concatenate([others[~inner], below[held]])
        left = np.bincount(nodes, minlength=len(tree.begins))
        alone = left[nodes] == 1
        for node, other in zip(nodes[alone].tolist(), others[alone].tolist(), strict=True):
            begin, end, entry = tree.begins[node], tree.ends[node], index[book.begins[other]]
            result.sums[entry] += running[end] - running[begin]
            result.counts[entry] += end - begin
            result.whole_nodes += 1
            if each:
                own = tree.points[begin:end] - entries[entry]
                result.entry[begin:end], result.error[begin:end] = entry, (own * own).sum(axis=1)
        nodes, others = nodes[~alone], others[~alone]
        leaf = nodes >= tree.inner
        _decide(tree, entries, nodes[leaf], index[book.begins[others[leaf]]], result)
        nodes, others = nodes[~leaf], others[~leaf]
        nodes = np.concatenate([2 * nodes + 1, 2 * nodes + 2])
        others = np.concatenate([others, others])
        held = tree.ends[nodes] > tree.begins[nodes]
        nodes, others = nodes[held], others[held]
    return result


def _decide(tree: Tree, entries: np.ndarray, nodes, choices, result: Assigned) -> None:
    """Parts of leaves with several entries left, each by its distances to those."""
    if not len(nodes):
        return
    order = np.lexsort((choices, nodes))
    nodes, choices = nodes[order], choices[order]
    for i, j in pairwise([0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]):
        begin, end = tree.begins[nodes[i]], tree.ends[nodes[i]]
        own, left = tree.points[begin:end], choices[i:j]
        away = own[:, None, :] - entries[left][None, :, :]
        distances = (away * away).sum(axis=2)
        best = distances.argmin(axis=1)
        chosen = left[best]
        np.add.at(result.sums, chosen, own)
        result.counts += np.bincount(chosen, minlength=len(entries))
        result.points_decided += len(own)
        if result.entry is not None:
            result.entry[begin:end] = chosen
            result.error[begin:end] = distances[np.arange(len(own)), best]


def tree_table(numbers: DataFrame, width: int, parts: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: ids and labels, and per position the tree order and the parts in it."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), block_rows):
                block = batch.slice(begin, block_rows)
                rows = matrix(block.column("numbers"), width)
                orders, points = [], []
                for own in np.split(rows, parts, axis=1):
                    order = tree_order(own)
                    orders.append(order.astype(np.int32).tobytes())
                    points.append(own[order].astype(np.int32).tobytes())
                offsets = pa.array([0, len(block)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(offsets, block.column("vec_id")),
                        pa.ListArray.from_arrays(offsets, block.column("label")),
                        pa.array([orders], pa.list_(pa.binary())),
                        pa.array([points], pa.list_(pa.binary())),
                    ],
                    ["ids", "labels", "orders", "points"],
                )

    label = numbers.schema["label"].dataType.simpleString()
    return numbers.mapInArrow(
        plant, f"ids array<long>, labels array<{label}>, orders array<binary>, points array<binary>"
    )


def _trees(row: list[bytes], width: int) -> Iterator[Tree]:
    for points in row:
        yield as_tree(np.frombuffer(points, dtype=np.int32).reshape(-1, width).astype(np.int64))


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (position, entry, component) after one round. Brings ``books.size`` sums and the
    counts to the driver."""
    parts, entries, width = books.shape

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(books), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for row in batch.column("points").to_pylist():
                for position, tree in enumerate(_trees(row, width)):
                    own = assign(tree, books[position])
                    sums[position] += own.sums
                    counts[position] += own.counts
        places = np.arange(books.size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), width))],
            ["place", "total", "n"],
        )

    # Decimals, as a sum over very many rows may pass 64 bits.
    found = (
        trees.select("points")
        .mapInArrow(sum_up, "place long, total long, n long")
        .groupBy("place")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        .filter("n > 0")
        .collect()
    )
    moved = books.ravel().copy()
    for row in found:
        moved[row["place"]] = int(row["total"]) // row["n"]
    return moved.reshape(books.shape)


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(trees: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` of every row."""
    width = books.shape[2]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                orders = batch.column("orders")[i].as_py()
                codes = np.zeros((len(ids), len(books)), dtype=np.uint8)
                errors = np.zeros(len(ids), dtype=np.int64)
                for position, tree in enumerate(_trees(batch.column("points")[i].as_py(), width)):
                    order = np.frombuffer(orders[position], dtype=np.int32)
                    own = assign(tree, books[position], each=True)
                    codes[order, position] = own.entry
                    errors[order] += own.error
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)],
                    ["vec_id", "label", "code", "error"],
                )

    return trees.mapInArrow(encode, f"vec_id long, label {label}, code string, error long")


def compress_vectors(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id``, ``label``, ``code`` (two hex digits per part) and ``error`` (the squared distances)
    of every vector, and the codebooks: position, entry, component."""
    numbers = materialize(whole_numbers(vectors, scale), "whole-numbers")
    first = (
        numbers.select("vec_id", "numbers")
        .orderBy(F.asc_nulls_last("vec_id"), "numbers")
        .limit(entries)
        .toArrow()["numbers"]
        .combine_chunks()
    )
    longest = numbers.agg(F.max(F.size("numbers"))).first()[0] or 0
    width = parts * max(1, -(-longest // parts))
    seeds = matrix(first, width) if len(first) else np.zeros((0, width), dtype=np.int64)
    books = np.stack(np.split(seeds, parts, axis=1))
    trees = materialize(tree_table(numbers, width, parts, block_rows), "vector-trees")
    if len(first):
        for _ in range(rounds):
            moved = lloyd_round(trees, books)
            if np.array_equal(moved, books):
                break  # all further rounds give the same
            books = moved
    return coded(trees, books, numbers.schema["label"].dataType.simpleString()), books


def with_label_error(coded_rows: DataFrame) -> DataFrame:
    """``error`` summed over equal labels as ``label_error``; null labels are one label."""
    sums = coded_rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded_rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
