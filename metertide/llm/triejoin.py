"""N-gram Jaccard join by a prefix tree of globally ordered shingle sets.

A text's set holds the distinct runs of ``words`` words, A-Z in lower case; a text with fewer words
is one shingle, one without words has the empty set, linked with nothing. Two sets are linked if
``100 * |intersection| >= percent * |union|``.

*Candidates.* Equal sets are one class. In one order of all shingles (those that stand out as frequent
last, the others by their hash) two linked sets have their first common shingle in the leading
``|set| - ceil(percent / 100 * |set|) + 1`` of either. Classes go to these shingles. A shingle that
only one class has drops out, and of those with the same classes one is left. There they meet with the
sizes of their sets and a sketch, a bit for every other shingle or so: it tells whether the number of
hashes that fall to a bit is odd, so two sets differ in at least as many shingles as their sketches in bits.
The pairs that this leaves form candidate groups.

*Join.* The sets of a group are put in order by how many of its sets hold a shingle and stored in a
trie, in which sets share the path of their common beginning. A set walks the trie once: the overlap with a
path is counted for all sets below it together, and a subtree is left as soon as the shingles that
remain on its paths, or in the set itself, are too few for the overlap that its shortest set needs,
or if all its sets are in the same component already. What is left at the end of a path is exact.

Frequent shingles, and a group of any size, have an exact way: both are dealt out in pairs of blocks,
so that any two rows meet in some task and none holds more than two blocks. Only a link from each
set to its component's first one leaves a task; for a group of near copies of one text these are as many
as its sets. The number of links of a document is not given, as that alone would take all pairs of
such a group. The counts behind the order cover all texts; they change the work, not the result.

Edges: one row per input row, also for repeated rows and repeated ids, which are rows of their own. A
null ``doc_id`` gets the smallest id of its component, or null if no row of it has an id. A null text is
empty. Other columns of the input are ignored. An empty table gives no rows.
"""

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from metertide.llm.batches import slices, words_of
from metertide.llm.components import LINK, components, forest_of_batches
from metertide.llm.simhash import in_pairs_of_blocks, links_of_groups, whole_groups
from metertide.workspace import materialize

WORDS, PERCENT = 4, 85
#: Counters of shingles, by the highest bits of their hash.
COUNTER_BITS = 20
#: Classes that meet at a shingle, and sets and shingles of a group, that a task holds at most, twice.
SHARED_ROWS, GROUP_SETS, GROUP_SHINGLES = 1 << 13, 1 << 11, 1 << 21
#: Rows read before the groups among them are worked on.
STREAM_ROWS = 1 << 14
#: Bits of the filter of members' keys, in words of 64.
FILTER_BITS = 1 << 24


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles, made from the hashes of its words."""
    found = words_of(pc.ascii_lower(texts.fill_null("")))
    digest = xxhash.xxh64_intdigest
    of_word = np.array([digest(w) for w in found.distinct.to_pylist()], dtype=np.uint64)
    codes, counts = of_word[found.index], found.counts

    def joined(first: np.ndarray, length: int) -> np.ndarray:
        value = np.full(len(first), length, dtype=np.uint64)
        for place in range(length):
            value = (value ^ codes[first + place]) * np.uint64(0x9E3779B97F4A7C15)
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
        return value

    whole = joined(np.arange(max(0, len(codes) - words + 1)), words)
    sets = []
    for begin, count in zip(found.starts.tolist(), counts.tolist(), strict=False):
        if count >= words:
            sets.append(np.unique(whole[begin : begin + count - words + 1]))
        else:
            sets.append(joined(np.array([begin] if count else [], dtype=np.int64), count))
    return sets


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size) // 100 + 1


def sketch_bits(size: int) -> int:
    """A power of two, at least half the size."""
    return 1 << max(6, (size - 1).bit_length() - 1)


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Bit ``i`` tells whether an odd number of hashes has ``i`` as its lowest bits."""
    bits = sketch_bits(len(hashes))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of several sets. Those of sets that may be linked differ at most twofold in length, so each
    is held at its own length and folded to half of it."""

    def __init__(self, blobs: list[bytes]):
        self.width = np.array([len(x) // 8 for x in blobs], dtype=np.int64)
        self.place = np.zeros((2, len(blobs)), dtype=np.int64)
        self.words = {}
        for width in np.unique(np.concatenate([self.width, self.width // 2])).tolist():
            own, twice = np.flatnonzero(self.width == width), np.flatnonzero(self.width == 2 * width)
            parts = []
            for held, rows in enumerate((own, twice)):
                self.place[held, rows] = sum(map(len, parts)) + np.arange(len(rows))
                if width and len(rows):
                    words = np.frombuffer(b"".join(blobs[i] for i in rows), dtype=np.uint64)
                    words = words.reshape(len(rows), held + 1, width)
                    parts.append(np.bitwise_xor.reduce(words, axis=1))
            if parts:
                self.words[width] = np.concatenate(parts)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the sketches at ``a`` and ``b`` differ; 0 if one is over twice the other."""
        result = np.zeros(len(a), dtype=np.int64)
        width = np.minimum(self.width[a], self.width[b])
        near = np.maximum(self.width[a], self.width[b]) <= 2 * width
        for w in np.unique(width[near]).tolist():
            at = np.flatnonzero(near & (width == w))
            words = self.words[w]
            x, y = (words[self.place[(self.width[i] > w).astype(np.int64), i]] for i in (a[at], b[at]))
            result[at] = np.bitwise_count(x ^ y).sum(axis=1)
        return result


def standing_out(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters of shingles, and their counts, that lie far above the mean in some task. At most
    ``2**COUNTER_BITS`` of them, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for part in slices(batches):
            hashes = np.concatenate(shingle_sets(part.column("text"), words))
            places = (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
            times += np.bincount(places, minlength=len(times))
        place = np.flatnonzero(times >= max(8.0, 4 * times.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(times[place])], ["place", "n"])

    sums = documents.select("text").mapInArrow(count, "place long, n long")
    sums = sums.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    return sums["place"].to_numpy(), sums["n"].to_numpy()


def described(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row its ``doc_id``, ``key`` (that, or a hash of the text), ``n_shingles``, ``digest`` of the
    set, its ``prefix`` in the common order and its ``sketch``."""
    places, times = standing_out(documents, words)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        weight[places] = times
        for part in slices(batches):
            sizes, digests, prefixes, sketches = [], [], [], []
            for own in shingle_sets(part.column("text"), words):
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                own_weight = weight[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                ordered = own[np.argsort(own_weight, kind="stable")] if own_weight.any() else own
                prefixes.append(ordered[: prefix_length(len(own), percent)].tobytes())
                sketches.append(odd_sketch(own))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("key"),
                    pa.array(sizes, pa.int64()),
                    *(pa.array(x, pa.binary()) for x in (digests, prefixes, sketches)),
                ],
                ["doc_id", "key", "n_shingles", "digest", "prefix", "sketch"],
            )

    return _keyed(documents).mapInArrow(
        describe, "doc_id long, key long, n_shingles long, digest binary, prefix binary, sketch binary"
    )


def _keyed(documents: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), key, "text")


def classes_at_shingles(classes: DataFrame, shared_rows: int) -> DataFrame:
    """``members`` of each shingle of a prefix that several classes have, and their ``digest``. More than
    ``shared_rows`` members come in several rows, without a digest but with the shingle as ``key``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "prefix"):
            prefixes = part.column("prefix").to_pylist()
            counts = np.array([len(x) // 8 for x in prefixes], dtype=np.int64)
            again = pa.array(np.repeat(np.arange(len(part)), counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.frombuffer(b"".join(prefixes), dtype=np.int64)),
                    part.column("rep").take(again),
                ],
                ["key", "rep"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(groups: list[tuple[int, np.ndarray, bool]]) -> pa.RecordBatch:
            keys = [key if large else None for key, _, large in groups]
            digests = [None if large else xxhash.xxh3_128_digest(x.tobytes()) for _, x, large in groups]
            ends = np.cumsum([0, *(len(x) for _, x, _ in groups)]).astype(np.int32)
            members = pa.array(np.concatenate([x for _, x, _ in groups]))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(ends, members),
                ],
                ["key", "digest", "members"],
            )

        # What was read of the last key, and whether some of its rows have been passed on.
        last, held, large = None, np.zeros(0, dtype=np.int64), False
        for batch in batches:
            keys, reps = (batch.column(c).to_numpy() for c in ("key", "rep"))
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            done = []
            for begin, end in pairwise(cuts):
                key, own = int(keys[begin]), reps[begin:end]
                if key != last:
                    if large or len(held) > 1:
                        done.append((last, held, large))
                    last, held, large = key, own, False
                else:
                    held = np.concatenate([held, own])
                if len(held) > shared_rows:
                    done.append((last, held, True))
                    held, large = held[:0], True
            if done:
                yield rows_of(done)
        if large or len(held) > 1:
            yield rows_of([(last, held, large)])

    probes = classes.select("rep", "prefix").mapInArrow(spread, "key long, rep long")
    return (
        probes.repartition("key")
        .sortWithinPartitions("key", "rep")
        .mapInArrow(meet, "key long, digest binary, members array<long>")
    )


def candidate_links(classes: DataFrame, percent: int, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """Pairs ``a``, ``b`` of ``rep`` numbers that connect all linked classes, and some that are not."""
    shared = materialize(classes_at_shingles(classes, shared_rows), "shared-shingles")
    # Equal groups, as near copies have at most of their shingles, are compared once.
    small = materialize(
        shared.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.any_value("members").alias("members"))
        .select(F.monotonically_increasing_id().alias("key"), "members"),
        "classes-that-meet",
    )
    known = classes.select("rep", "n_shingles", "sketch")
    dealt = (
        small.select("key", F.explode("members").alias("rep"))
        .join(known, "rep")
        .withColumn("pair", F.lit(0))
    )
    large = shared.filter("digest IS NULL").select("key", F.explode("members").alias("rep"))
    counts = materialize(large.groupBy("key").count(), "large-shingles")
    if not counts.isEmpty():
        pairs = in_pairs_of_blocks(large, "key", counts, shared_rows).withColumn(
            "pair", F.col("pair") + 1
        )
        dealt = dealt.unionByName(pairs.join(known, "rep"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            for table in whole_groups(batches, "key", "pair", STREAM_ROWS):
                keys, pair, reps, sizes = (
                    table[c].to_numpy() for c in ("key", "pair", "rep", "n_shingles")
                )
                fresh = np.append(True, (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1]))
                sketches = Sketches(table["sketch"].to_pylist())

                def near(a, b, sizes=sizes, sketches=sketches):
                    return maybe_linked(sizes, sketches, a, b, percent)

                for a, b in links_of_groups(np.cumsum(fresh), near):
                    yield reps[a], reps[b]

        yield from forest_of_batches(links())

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(compare, LINK)


def maybe_linked(sizes, sketches: Sketches, a, b, percent: int) -> np.ndarray:
    """Which sets ``a`` and ``b`` may be linked: none that are is left out. Linked ones share
    ``percent / (100 + percent)`` of their sizes together, so they differ in what is left of twice that."""
    a, b = np.broadcast_arrays(a, b)
    result = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    at = np.flatnonzero(result)
    both = sizes[a[at]] + sizes[b[at]]
    result[at] = (100 + percent) * (both - sketches.differ(a[at], b[at])) >= 2 * percent * both
    return result


class Trie:
    """A prefix tree of sets of numbers, each in the order of how many sets hold a number.

    A node covers the sets ``begin`` to ``end`` of the sorted ones and the numbers ``edge`` that all of
    them have next; ``depth`` counts the numbers from the root to its end. Sets that end there come
    first among those covered.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        values, index, times = np.unique(
            np.concatenate(sets), return_inverse=True, return_counts=True
        )
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, -times))] = np.arange(len(values))
        cuts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        paths = [np.sort(rank[index[i:j]]) for i, j in pairwise(cuts)]
        #: Place of each sorted set among the given ones.
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.vocabulary = len(values)
        common = [0] + [_common(a, b) for a, b in pairwise(self.paths)]
        self._grow(np.array(common, dtype=np.int64))

    def _grow(self, common: np.ndarray) -> None:
        self.nodes = []
        open_ = [(0, len(self.paths), 0, -1)]
        while open_:
            begin, end, above, parent = open_.pop()
            sizes = self.sizes[begin:end]
            shared = common[begin + 1 : end]
            first = self.paths[begin]
            depth = int(shared.min()) if len(shared) else len(first)
            if parent < 0:
                depth = 0
            ended = begin + int(np.searchsorted(np.cumsum(sizes != depth), 1)) if end - begin else begin
            children = []
            self.nodes.append(
                (
                    begin,
                    end,
                    ended,
                    first[above:depth],
                    depth,
                    int(sizes.min()),
                    int(sizes.max()),
                    children,
                )
            )
            me = len(self.nodes) - 1
            if parent >= 0:
                self.nodes[parent][-1].append(me)
            if ended < end:
                starts = ended + 1 + np.flatnonzero(common[ended + 1 : end] == depth)
                for i, j in pairwise([ended, *starts.tolist(), end]):
                    open_.append((i, j, depth, me))

    def partners(self, member: int, wanted: np.ndarray, percent: int) -> list[int]:
        """Sorted sets, among those ``wanted``, that are linked to the sorted set ``member``."""
        own = self.paths[member]
        size, total = len(own), 100 + percent
        held = np.zeros(self.vocabulary, dtype=bool)
        held[own] = True
        open_before = np.concatenate(([0], np.cumsum(wanted))).tolist()
        found, walk = [], [(0, 0)]
        while walk:
            node, overlap = walk.pop()
            begin, end, ended, edge, depth, shortest, longest, children = self.nodes[node]
            if open_before[begin] == open_before[end]:
                continue
            if len(edge):
                overlap += int(np.count_nonzero(held[edge]))
                # What still can be shared, by what remains on the paths and in the set itself.
                if 100 * longest < percent * size + total * (depth - overlap):
                    continue
                rest = size - int(np.searchsorted(own, edge[-1], side="right"))
                if total * (overlap + rest) < percent * (size + shortest):
                    continue
            if ended > begin and total * overlap >= percent * (size + depth):
                found.extend(i for i in range(begin, ended) if wanted[i])
            walk.extend((child, overlap) for child in children)
        return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    return int(differ[0]) if len(differ) else size


def linked_groups(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """For each of the sets the place of its component's first one among those the walk reached."""
    trie = Trie(sets)
    first = np.arange(len(sets))
    unseen = np.ones(len(sets), dtype=bool)
    for start in range(len(sets)):
        if not unseen[start]:
            continue
        unseen[start], queue = False, [start]
        while queue and unseen.any():
            for other in trie.partners(queue.pop(), unseen, percent):
                unseen[other] = False
                first[trie.order[other]] = trie.order[start]
                queue.append(other)
    return first


def texts_of(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (rep, component, key, digest) with the texts of its keys.

    A filter of at most ``FILTER_BITS / 64`` words goes to all tasks, so that few texts of other keys are
    shuffled. If very many are known it lets all pass; the join itself is exact.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bit = F.col("bit").cast("int")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("bit", place % 64).withColumn("word", F.floor(place / 64))

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = placed(known).groupBy("word").agg(F.bit_or(mask).alias("mask"))
    maybe = placed(_keyed(documents)).join(F.broadcast(words), "word").filter(F.getbit("mask", bit) == 1)
    return maybe.select("key", "text").join(known, "key")


def join_groups(
    documents: DataFrame, classes: DataFrame, members: DataFrame, words: int, percent: int,
    group_sets: int = GROUP_SETS,
) -> DataFrame:
    """``rep`` and ``root`` of all classes in candidate groups (``members``: rep, component): equal
    roots are one component."""
    known = materialize(
        members.join(classes.select("rep", "key", "digest", "n_shingles"), "rep"), "group-members"
    )
    # Pairs of blocks are cut by count: a unit is a block full of sets or of shingles.
    sizes = known.groupBy("component").agg(
        F.greatest(F.count(F.lit(1)) / group_sets, F.sum("n_shingles") / GROUP_SHINGLES).alias("count")
    )
    large = materialize(sizes.filter("count > 1"), "large-groups")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [x.tobytes() for x in shingle_sets(part.column("text"), words)]
            same = [
                xxhash.xxh3_128_digest(x) == digest
                for x, digest in zip(sets, part.column("digest").to_pylist(), strict=True)
            ]
            rows = pa.RecordBatch.from_arrays(
                [part.column("component"), part.column("rep"), pa.array(sets, pa.binary())],
                ["component", "rep", "shingles"],
            )
            yield rows.filter(pa.array(same, pa.bool_()))

    texts = texts_of(documents, known.select("component", "rep", "key", "digest"))
    rows = texts.select("component", "rep", "digest", "text").mapInArrow(
        gather, "component long, rep long, shingles binary"
    )
    split = not large.isEmpty()
    if split:
        rows = materialize(rows, "group-sets")
        small = rows.join(large, "component", "left_anti").withColumn("pair", F.lit(0))
        dealt = small.unionByName(in_pairs_of_blocks(rows, "component", large, 1))
    else:
        dealt = rows.withColumn("pair", F.lit(0))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "component", "pair", group_sets):
            groups, pairs = (table[c].to_numpy() for c in ("component", "pair"))
            fresh = (groups[1:] != groups[:-1]) | (pairs[1:] != pairs[:-1])
            reps = table["rep"].to_numpy()
            roots = reps.copy()
            for begin, end in pairwise([0, *(np.flatnonzero(fresh) + 1).tolist(), len(table)]):
                if end - begin > 1:
                    blobs = table["shingles"].slice(begin, end - begin).to_pylist()
                    sets = [np.frombuffer(x, dtype=np.uint64) for x in blobs]
                    roots[begin:end] = reps[begin + linked_groups(sets, percent)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups), pa.array(reps), pa.array(roots)], ["component", "rep", "root"]
            )

    joined = (
        dealt.repartition("component", "pair")
        .sortWithinPartitions("component", "pair", "rep")
        .mapInArrow(join, "component long, rep long, root long")
    )
    if not split:
        return joined.select("rep", "root").distinct()
    joined = materialize(joined, "links-of-groups")
    done = joined.join(large, "component", "left_anti").select("rep", "root").distinct()
    links = joined.join(large, "component", "left_semi").select(
        F.col("rep").alias("a"), F.col("root").alias("b")
    )
    whole = components(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    return done.unionByName(whole)


def jaccard_join(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT, group_sets: int = GROUP_SETS
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that can be reached over
    links, itself included."""
    found = materialize(described(documents, words, percent), "described")
    classes = materialize(
        found.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.min("key").alias("key"),
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("prefix").alias("prefix"),
            F.any_value("sketch").alias("sketch"),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    members = materialize(components(candidate_links(classes, percent)), "candidate-groups")
    members = members.select(F.col("node").alias("rep"), "component")
    roots = materialize(join_groups(documents, classes, members, words, percent, group_sets), "roots")
    placed = materialize(
        classes.select("digest", "rep", "first_id")
        .join(roots, "rep", "left")
        .withColumn("root", F.coalesce("root", "rep")),
        "placed-classes",
    )
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = placed.join(smallest, "root").select("digest", "component_id")
    # Texts without words share a digest, but no component.
    return (
        found.select("doc_id", "n_shingles", "digest")
        .join(known, "digest", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") == 0, F.col("doc_id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
        )
    )
