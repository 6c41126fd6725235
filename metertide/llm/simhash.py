"""SimHash near-dedup with a generalised pigeonhole.

A text's fingerprint has bit ``i`` set if more than half of its shingles' hashes have. Fingerprints
that differ in at most ``limit`` bits are linked, and documents in a component are near-duplicates.

The bits are cut into partitions, correlated bits together, as those tell less apart. A partition
``p`` gets its own threshold ``t[p] >= -1``. If ``sum(t[p] + 1) > limit`` then two fingerprints within
the limit agree up to ``t[p]`` bits in some ``p``, or they would differ in ``sum(t[p] + 1)``. Dynamic
programming picks the thresholds with least estimated cost: rows to probe, and candidates to verify.
Two values within ``t`` bits share a value within ``ceil(t / 2)`` of either, so every fingerprint goes
to the keys of that radius around its own, and fingerprints that meet at a key are verified.

Exact copies are one fingerprint and are linked once. At a key, a dense group is explored from one
member to the next, each time against those not yet reached, so near copies of one text cost about
one comparison each, and only a spanning forest of the links leaves a task. A key with more than
``KEY_ROWS`` fingerprints is dealt out in pairs of blocks of that size. No link is lost.

Edges: a null text counts as empty. An empty text has fingerprint zero, linked like any other. A
text with fewer words than a shingle is one shingle. Rows that share a ``doc_id`` are one document
when linking. A null ``doc_id`` gets a fingerprint but no component, and is always kept.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from metertide.llm.batches import runs, slices
from metertide.llm.components import LINK, components, forest_of_batches
from metertide.workspace import materialize

SEED = 42
#: Counters of shingles (by their hash's highest bits), and texts they are counted in, about.
COUNTERS, COUNTED_TEXTS = 1 << 18, 1 << 16
#: Texts that share a shingle and that a task holds at most.
SHARED_ROWS = 1 << 14
#: Fingerprints of one key that a task holds at most.
KEY_ROWS = 1 << 18
#: Texts of one component whose shingles a task holds at most, twice.
BLOCK_ROWS = 1024
#: Groups of at most this many fingerprints are compared pair by pair.
SMALL_GROUP = 64
#: Rows read before the groups among them are worked on.
STREAM_ROWS = 1 << 18
#: Estimated cost of a row probed and of a candidate verified, in microseconds.
ROW_COST, CANDIDATE_COST = 2.0, 0.01


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``words`` words, A-Z in lower case, joined by single spaces."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[i:j], seed) for i, j in zip(begins, ends[words - 1 :].tolist(), strict=True)]
    return np.array(found, dtype=np.uint64)


def remixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Further 64 bits from each hash, for fingerprints of more than 64; ``n`` = 0 leaves it as is."""
    if not n:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((n * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, bits: int = 64, distinct: bool = False) -> list[int]:
    """The fingerprint as unsigned 64-bit words, the first with the hashes' own bits."""
    if distinct:
        hashes = np.unique(hashes)
    result = []
    for word in range(bits // 64):
        own, ones = remixed(hashes, word), np.zeros(64, dtype=np.int64)
        for begin in range(0, len(own), 1 << 16):
            part = own[begin : begin + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        result.append(int.from_bytes(np.packbits(2 * ones > len(own)).tobytes(), "big"))
    return result


def fingerprints(
    documents: DataFrame,
    words: int = 3,
    bits: int = 64,
    distinct: bool = False,
    digest: bool = False,
) -> DataFrame:
    """``doc_id`` and the words ``w0``, ``w1``... of its fingerprint, as signed numbers.

    ``distinct`` counts each shingle once, so the fingerprint stands for the set of shingles.
    ``digest`` adds a column of that name, a hash of that set.
    """
    names = [f"w{i}" for i in range(bits // 64)] + ["digest"] * digest

    def of_text(text: str | None) -> list[int]:
        hashes = shingle_hashes(text, words)
        if distinct or digest:
            own = np.unique(hashes)
        found = fingerprint(own if distinct else hashes, bits)
        return [*found, xxhash.xxh64_intdigest(own.tobytes(), SEED)] if digest else found

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [of_text(t) for t in part.column("text").to_pylist()]
            table = np.array(found, dtype=np.uint64).reshape(len(found), len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in table.T.copy())],
                ["doc_id", *names],
            )

    return documents.select("doc_id", "text").mapInArrow(
        compute, "doc_id long, " + ", ".join(f"{n} long" for n in names)
    )


@dataclass(frozen=True)
class Pigeonhole:
    """Bits of each partition, and its threshold (-1: not used)."""

    partitions: list[list[int]]
    thresholds: list[int]

    def rows(self) -> int:
        """Keys per fingerprint."""
        return sum(
            ball(len(p), (t + 1) // 2)
            for p, t in zip(self.partitions, self.thresholds, strict=True)
            if t >= 0
        )


def ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1))


def group_correlated(correlation: np.ndarray, count: int) -> list[list[int]]:
    """Partitions of near equal size; each grows by the bit most correlated with those it has."""
    strength = np.abs(correlation) - np.eye(len(correlation))
    left, result = list(range(len(correlation))), []
    for part in range(count):
        size = -(-len(left) // (count - part))
        own = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (strength[b, own].sum(), -b)))
            left.remove(own[-1])
        result.append(sorted(own))
    return result


def allocate(costs: list[list[float]], limit: int) -> tuple[float, list[int]]:
    """Thresholds with ``sum(t + 1) > limit`` and least cost; ``costs[p][t + 1]`` is that of ``t``."""
    best = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for given, more in enumerate(own):
                key = min(limit + 1, spent + given)
                if key not in after or cost + more < after[key][0]:
                    after[key] = (cost + more, [*chosen, given - 1])
        best = after
    return best[limit + 1]


def bit_statistics(distinct: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both of two bits set."""
    names = [f"w{i}" for i in range(bits // 64)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((bits, bits)), 0
        for batch in batches:
            ones = unpacked(batch, names).astype(np.float32)
            total += (ones.T @ ones).astype(float)
            rows += len(ones)
        place = np.append(np.arange(bits * bits), -1)
        values = np.append(total.ravel(), rows).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(values)], ["place", "n"])

    sums = (
        distinct.select(*names)
        .mapInArrow(count, "place long, n long")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.zeros(bits * bits + 1)
    table[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return int(table[-1]), table[:-1].reshape(bits, bits)


def unpacked(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Bits of the fingerprints; bit 0 is the highest of the first word."""
    words = np.column_stack([batch.column(n).to_numpy() for n in names]).astype(">i8")
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1)


def plan_pigeonhole(count: int, both: np.ndarray, limit: int) -> Pigeonhole:
    """The cheapest number of partitions and their thresholds for ``count`` fingerprints."""
    bits = len(both)
    share = np.diag(both) / max(1, count)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    correlation = (both / max(1, count) - np.outer(share, share)) / np.outer(spread, spread)
    best = None
    for parts in range(max(1, bits // 32), min(bits, max(bits // 8, 1)) + 1):
        partitions = group_correlated(correlation, parts)
        costs = []
        for own in partitions:
            # Chance that two fingerprints agree here. Of each two bits the joint chance counts.
            agree = 1.0
            for i, j in zip(own[::2], own[1::2] + [None] * (len(own) % 2), strict=True):
                if j is None:
                    agree *= share[i] ** 2 + (1 - share[i]) ** 2
                    continue
                p11 = both[i, j] / max(1, count)
                p10, p01 = share[i] - p11, share[j] - p11
                agree *= p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
            row = [0.0]
            for t in range(min(limit, 6) + 1):
                keys = ball(len(own), (t + 1) // 2)
                pairs = count * count / 2 * min(1.0, agree * keys * keys)
                row.append(ROW_COST * count * keys + CANDIDATE_COST * pairs)
            costs.append(row)
        if sum(len(row) - 1 for row in costs) <= limit:
            continue
        cost, thresholds = allocate(costs, limit)
        if best is None or cost < best[0]:
            best = (cost, Pigeonhole(partitions, thresholds))
    return best[1]


def keys_of(ones: np.ndarray, plan: Pigeonhole) -> np.ndarray:
    """All keys of each fingerprint, one column each; a key names its partition too."""
    columns = []
    for part, (own, threshold) in enumerate(zip(plan.partitions, plan.thresholds, strict=True)):
        if threshold < 0:
            continue
        weights = 1 << np.arange(len(own), dtype=np.int64)
        value = ones[:, own].astype(np.int64) @ weights + (part << 40)
        for radius in range((threshold + 1) // 2 + 1):
            for flipped in combinations(range(len(own)), radius):
                mask = int(sum(1 << b for b in flipped))
                columns.append(value ^ mask)
    return np.column_stack(columns)


def _explore(begin: int, size: int, near):
    """Links that connect one group, ``size`` places from ``begin`` on."""
    unseen = np.arange(begin, begin + size)
    while len(unseen) > 1:
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            member = queue.pop()
            close = near(member, unseen)
            reached = unseen[close]
            if len(reached):
                yield np.full(len(reached), member), reached
                queue.extend(reached.tolist())
                unseen = unseen[~close]


def links_of_groups(keys: np.ndarray, near):
    """Links that connect, among places of equal (adjacent) keys, those that are ``near(a, b)``."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(begins, len(keys)))
    after = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(begins, sizes)) - 1
    after[np.repeat(sizes > SMALL_GROUP, sizes)] = 0
    open_ = np.flatnonzero(after)
    step = 1
    while len(open_):
        close = near(open_, open_ + step)
        yield open_[close], open_[close] + step
        step += 1
        open_ = open_[after[open_] >= step]
    for begin, size in zip(begins[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        yield from _explore(begin, size, near)


def links_within(keys: np.ndarray, words: np.ndarray, limit: int):
    """Links that connect the fingerprints of equal (adjacent) keys, as places."""
    return links_of_groups(
        keys, lambda a, b: np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= limit
    )


def whole_groups(
    batches: Iterator[pa.RecordBatch], key: str, pair: str, rows: int
) -> Iterator[pa.Table]:
    """Sorted batches as tables of about ``rows`` rows that hold every group (key, pair) whole."""
    held, count = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += len(batch)
        if count < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        keys, pairs = (table[c].to_numpy() for c in (key, pair))
        # The last group may go on in the next batch.
        ends = np.flatnonzero((keys != keys[-1]) | (pairs != pairs[-1]))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield table.slice(0, cut)
        held, count = [table.slice(cut)], len(table) - cut
    if count:
        yield pa.concat_tables(held).combine_chunks()


def in_pairs_of_blocks(rows: DataFrame, key: str, large: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` of the keys in ``large`` (key, count), each in every pair of blocks with its own:
    ``pair`` names it. Any two rows of a key meet in some pair, and no pair has many rows."""
    blocks = F.ceil(F.col("count") / block_rows).cast("int")
    return (
        rows.join(large, key)
        .withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("pair", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
        .select(*rows.columns, "pair")
    )


def link_fingerprints(
    distinct: DataFrame, bits: int, limit: int, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Pairs ``a``, ``b`` of ``rep`` numbers that connect what all pairs within ``limit`` bits connect:
    each task gives its fingerprints with the smallest number of their component."""
    names = [f"w{i}" for i in range(bits // 64)]
    count, both = bit_statistics(distinct, bits)
    plan = plan_pigeonhole(count, both, limit)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = plan.rows()
        for batch in batches:
            step = max(1, STREAM_ROWS // per)
            for begin in range(0, len(batch), step):
                part = batch.slice(begin, step)
                keys = keys_of(unpacked(part, names), plan)
                again = pa.array(np.repeat(np.arange(len(part)), per))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), *(part.column(c).take(again) for c in ("rep", *names))],
                    ["key", "rep", *names],
                )

    row = "rep long, " + ", ".join(f"{n} long" for n in names)
    probes = distinct.select("rep", *names).mapInArrow(probe, f"key long, {row}")
    if count > key_rows:
        large = materialize(
            probes.groupBy("key").count().filter(F.col("count") > key_rows), "large-keys"
        )
        small = probes.join(large, "key", "left_anti").withColumn("pair", F.lit(0))
        probes = small.unionByName(in_pairs_of_blocks(probes, "key", large, key_rows))
    else:
        probes = probes.withColumn("pair", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for table in whole_groups(batches, "key", "pair", STREAM_ROWS):
                keys = table["key"].to_numpy() + (table["pair"].to_numpy().astype(np.int64) << 46)
                words = np.column_stack([table[n].to_numpy() for n in names]).view(np.uint64)
                reps = table["rep"].to_numpy()
                for a, b in links_within(keys, words, limit):
                    yield reps[a], reps[b]

        yield from forest_of_batches(links())

    return (
        probes.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare, LINK)
    )


def _classes(documents: DataFrame, words: int, bits: int, distinct: bool, digest: bool):
    """Fingerprints of all rows; every distinct one (with its ``digest``) and its ``rep``, the smallest
    ``doc_id``; and links between those of one ``doc_id``, or None."""
    names = [f"w{i}" for i in range(bits // 64)] + ["digest"] * digest
    found = materialize(fingerprints(documents, words, bits, distinct, digest), "fingerprints")
    unique = materialize(
        found.filter("doc_id IS NOT NULL").groupBy(*names).agg(F.min("doc_id").alias("rep")),
        "distinct-fingerprints",
    )
    repeated = found.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    repeated = materialize(repeated.select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return found, unique, None
    of_id = materialize(
        found.join(repeated, "doc_id").join(unique, names).select("doc_id", "rep"), "same-id"
    )
    first = of_id.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return found, unique, of_id.join(first, "doc_id").select(F.col("rep").alias("a"), "b")


def with_components(unique: DataFrame, joined: DataFrame) -> DataFrame:
    """``unique`` with the ``component`` of its ``rep``, which is the ``rep`` itself if it has no link."""
    component = F.coalesce("component", "rep").alias("component")
    classes = unique.join(joined, F.col("rep") == F.col("node"), "left")
    return materialize(classes.select(*unique.columns, component), "components")


def near_duplicates(
    documents: DataFrame, words: int = 3, bits: int = 64, limit: int = 3, distinct: bool = False
) -> DataFrame:
    """``doc_id``, its fingerprint's words ``w0``..., and ``component``, the smallest ``doc_id`` that
    can be reached over links, itself included."""
    names = [f"w{i}" for i in range(bits // 64)]
    found, unique, same = _classes(documents, words, bits, distinct, digest=False)
    links = link_fingerprints(unique, bits, limit)
    classes = with_components(unique, components(links if same is None else links.unionByName(same)))
    known = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")
    return found.join(classes.drop("rep"), names, "left").select("doc_id", *names, known)


def similarity_limit(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Differing bits to allow so that sets of that Jaccard similarity are linked.

    Sets of equal size have cosine ``2 s / (1 + s)``; the angle's share of a half turn is the mean share
    of differing bits, and ``slack`` standard deviations are added, as single pairs scatter around it.
    """
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)


def similar_within(sets: list[np.ndarray], similarity: float):
    """Links that connect the sets (of distinct values) with at least that Jaccard similarity, as
    places. From each set on the queue the values' postings count what it shares with all others."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    postings = np.repeat(np.arange(len(sets)), sizes)[np.argsort(values, kind="stable")]
    times = np.bincount(values, minlength=1)
    first = np.cumsum(times) - times
    unseen = np.ones(len(sets), dtype=bool)
    for start in range(len(sets)):
        if not unseen[start]:
            continue
        unseen[start], queue = False, [start]
        while queue and unseen.any():
            member = queue.pop()
            own = values[starts[member] : starts[member + 1]]
            places = np.repeat(first[own], times[own]) + runs(times[own])
            shared = np.bincount(postings[places], minlength=len(sets))
            union = sizes + sizes[member] - shared
            reached = np.flatnonzero(unseen & (shared >= similarity * union - 1e-9))
            if len(reached):
                yield np.full(len(reached), member), reached
                queue.extend(reached.tolist())
                unseen[reached] = False


def rare_first(hashes: np.ndarray, times: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set in the order of ``times`` (by counter, ties by the hash) that holds the first
    common value of any two sets with at least that Jaccard similarity: they share at least that
    share of either, so it has only the others before it."""
    order = np.lexsort((hashes, times[counter_of(hashes)]))
    least = int(np.ceil(similarity * len(hashes) - 1e-9))
    return hashes[order[: len(hashes) - least + 1]]


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def shingle_times(texts: DataFrame, words: int, count: int, most: int = COUNTED_TEXTS) -> np.ndarray:
    """How often shingles of each counter occur, among about ``most`` of the ``count`` texts. It only
    gives an order: any order finds the same pairs, but one with rare shingles first meets fewer others."""
    of = max(1, count // most)
    texts = texts.filter(F.pmod(F.xxhash64("rep"), F.lit(of)) == 0).select("text").repartition(16)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(COUNTERS, dtype=np.int64)
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                times += np.bincount(
                    counter_of(np.unique(shingle_hashes(text, words))), minlength=COUNTERS
                )
        place = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(times[place])], ["place", "n"])

    sums = texts.mapInArrow(add_up, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    sums = sums.toArrow()
    times = np.zeros(COUNTERS, dtype=np.int64)
    times[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return times


def maybe_similar(sizes, places, counts, a, b, similarity: float) -> np.ndarray:
    """Which sets ``a`` and ``b`` may have that similarity if their first common value is at ``places``.
    No pair that has it is left out: sets differ in at least as many values as their ``counts`` by the
    hashes' lowest six bits do."""
    both = sizes[a] + sizes[b]
    shared = similarity / (1 + similarity) * both - 1e-6
    rest = np.minimum(sizes[a] - places[a], sizes[b] - places[b])
    differ = np.abs(counts[a] - counts[b]).sum(axis=1, dtype=np.int64)
    return (rest >= shared) & (both - differ >= 2 * shared)


def link_by_rare_shingles(
    texts: DataFrame, words: int, similarity: float, key_rows: int = SHARED_ROWS
) -> DataFrame:
    """Pairs ``a``, ``b`` of ``rep`` numbers that connect all ``texts`` whose sets of shingles have that
    Jaccard similarity, and some that have not.

    Texts go to the shingles of their prefix (``rare_first``), and those alone at each drop out. The
    others meet at the shingle with the sizes and counts of their sets.
    """
    texts = materialize(texts.select("rep", "text"), "distinct-texts")
    times = shingle_times(texts, words, texts.count())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            reps, keys = part.column("rep").to_numpy(), []
            for text in part.column("text").to_pylist():
                keys.append(rare_first(np.unique(shingle_hashes(text, words)), times, similarity))
            counts = [len(x) for x in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(keys).view(np.int64)),
                    pa.array(np.repeat(reps, counts)),
                    pa.array(runs(np.array(counts)).astype(np.int32)),
                ],
                ["key", "rep", "place"],
            )

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row is held back for the next batch; ``met``: it has the key of the row before it.
        held, met = [], False
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = table["key"].to_numpy()
            same = keys[1:] == keys[:-1]
            shared = np.append(same, False) | np.append(met, same)
            yield from table.slice(0, len(keys) - 1).filter(pa.array(shared[:-1])).to_batches()
            held, met = table.slice(len(keys) - 1).to_batches(), bool(shared[-1])
        if met:
            yield from held

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, counts = [], []
            for text in part.column("text").to_pylist():
                own = np.unique(shingle_hashes(text, words))
                sizes.append(len(own))
                low = np.bincount((own & np.uint64(63)).astype(np.int64), minlength=64)
                counts.append(np.minimum(low, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary())],
                ["rep", "size", "counts"],
            )

    probes = texts.mapInArrow(prefixes, "key long, rep long, place int")
    shared = materialize(
        probes.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(meeting, "key long, rep long, place int"),
        "shared-shingles",
    )
    sets = texts.join(shared.select("rep").distinct(), "rep", "left_semi").mapInArrow(
        describe, "rep long, size int, counts binary"
    )
    rows = shared.join(materialize(sets, "sizes-of-sets"), "rep")
    large = materialize(
        shared.groupBy("key").count().filter(F.col("count") > key_rows), "large-shingles"
    )
    if large.isEmpty():
        dealt = rows.withColumn("pair", F.lit(0))
    else:
        small = rows.join(large, "key", "left_anti").withColumn("pair", F.lit(0))
        dealt = small.unionByName(in_pairs_of_blocks(rows, "key", large, key_rows))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for table in whole_groups(batches, "key", "pair", STREAM_ROWS // 8):
                keys, pair, reps, sizes, places = (
                    table[c].to_numpy() for c in ("key", "pair", "rep", "size", "place")
                )
                fresh = np.append(True, (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1]))
                blobs = b"".join(table["counts"].to_pylist())
                counts = np.frombuffer(blobs, dtype=np.uint8).reshape(-1, 64).astype(np.int16)

                def near(a, b, sizes=sizes, places=places, counts=counts):
                    return maybe_similar(sizes, places, counts, a, b, similarity)

                for a, b in links_of_groups(np.cumsum(fresh), near):
                    yield reps[a], reps[b]

        yield from forest_of_batches(links())

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare, LINK)


def verify_similarity(
    documents: DataFrame,
    classes: DataFrame,
    words: int,
    similarity: float,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pairs ``a``, ``b`` of ``rep`` numbers that connect all texts of a component whose sets of
    shingles have that Jaccard similarity; exact, from whole texts.

    Only components of several fingerprints take part. One with more than ``block_rows`` of them is
    dealt out in pairs of blocks.
    """
    sizes = classes.groupBy("component").count().filter("count > 1")
    sizes = materialize(sizes, "component-sizes")
    members = classes.join(sizes.drop("count"), "component").select("rep", "component")
    texts = documents.select("doc_id", "text").join(
        materialize(members, "members"), F.col("doc_id") == F.col("rep")
    )

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [
                np.unique(shingle_hashes(t, words)).tobytes() for t in part.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("component"), part.column("rep"), pa.array(sets, pa.binary())],
                ["component", "rep", "shingles"],
            )

    rows = texts.select("component", "rep", "text").mapInArrow(
        shingle, "component long, rep long, shingles binary"
    )
    large = sizes.filter(F.col("count") > block_rows)
    if large.isEmpty():
        dealt = rows.withColumn("pair", F.lit(0))
    else:
        rows = materialize(rows, "shingles")
        small = rows.join(large, "component", "left_anti").withColumn("pair", F.lit(0))
        dealt = small.unionByName(in_pairs_of_blocks(rows, "component", large, block_rows))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for table in whole_groups(batches, "component", "pair", block_rows):
                groups, pairs = (table[c].to_numpy() for c in ("component", "pair"))
                fresh = (groups[1:] != groups[:-1]) | (pairs[1:] != pairs[:-1])
                cuts = [0, *(np.flatnonzero(fresh) + 1).tolist(), len(table)]
                reps = table["rep"].to_numpy()
                for begin, end in pairwise(cuts):
                    if end - begin > 1:
                        blobs = table["shingles"].slice(begin, end - begin).to_pylist()
                        sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
                        for a, b in similar_within(sets, similarity):
                            yield reps[a + begin], reps[b + begin]

        yield from forest_of_batches(links())

    return (
        dealt.repartition("component", "pair")
        .sortWithinPartitions("component", "pair", "rep")
        .mapInArrow(verify, LINK)
    )


def without_near_duplicates(
    documents: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 128
) -> DataFrame:
    """``documents`` with one row of each group of near-duplicates, that of the smallest ``doc_id``.

    Texts whose fingerprints differ in the bits that the similarity stands for (and one standard
    deviation more) are candidates, and so are all that may be so similar by their shingles, as
    fingerprints scatter (``link_by_rare_shingles``); those whose sets of shingles have at least that
    Jaccard similarity are linked. Texts with equal sets count as one text. Rows with a null ``doc_id``
    stay. Of rows that share a kept ``doc_id``, one stays.
    """
    names = [f"w{i}" for i in range(bits // 64)]
    found, unique, same = _classes(documents, words, bits, distinct=True, digest=True)
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text").join(
        unique.select("rep").distinct(), "rep", "left_semi"
    )
    links = link_fingerprints(unique, bits, similarity_limit(similarity, bits))
    links = links.unionByName(link_by_rare_shingles(texts, words, similarity))
    links = links if same is None else links.unionByName(same)
    classes = with_components(unique, components(links))
    joined = components(verify_similarity(documents, classes, words, similarity))
    verified = with_components(classes.drop("component"), joined)
    kept = materialize(
        found.join(verified, [*names, "digest"])
        .filter("doc_id = component")
        .select(F.col("doc_id").alias("_kept"))
        .distinct(),
        "kept",
    )
    named = documents.filter("doc_id IS NOT NULL")
    return (
        named.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
        .dropDuplicates(["doc_id"])
        .unionByName(documents.filter("doc_id IS NULL"))
    )


def one_of_each_group(
    documents: DataFrame, words: int = 3, bits: int = 64, limit: int = 3
) -> DataFrame:
    """``documents`` with one row of each group that ``near_duplicates`` links by its bits: that with the
    smallest ``doc_id`` (null last; of several with it, that with the least hash of all its columns).

    Rows stand for themselves: a repeated ``doc_id`` does not link texts, and a row goes only if another
    one of its group stays. Rows that are equal in all columns are one. Columns may have any names.
    """
    row = "_row"
    while row in {c.lower() for c in documents.columns}:
        row = "_" + row
    columns = [F.col(f"`{c}`") for c in documents.columns]
    keyed = documents.withColumn(row, F.xxhash64(*columns))
    places = materialize(
        keyed.groupBy(row).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("times")),
        "rows",
    )
    groups = materialize(
        near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), words, bits, limit)
        .select(F.col("doc_id").alias(row), "component")
        .distinct()
        .join(places, row),
        "groups-of-rows",
    )
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = groups.groupBy("component").agg(F.min(order).alias("first"))
    gone = groups.join(first, "component").filter(F.col(row) != F.col(f"first.{row}")).select(row)
    kept = keyed.join(materialize(gone, "later-rows"), row, "left_anti")
    several = materialize(places.filter("times > 1").select(row), "equal-rows")
    if not several.isEmpty():
        kept = kept.join(several, row, "left_anti").unionByName(
            kept.join(several, row, "left_semi").dropDuplicates([row])
        )
    return kept.select(*columns)
