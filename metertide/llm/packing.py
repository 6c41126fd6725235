"""Order-preserving packing by dynamic programming.

The documents of a partition, in their order, are one stream of token ids. Windows of at most
``size`` ids are cut from it so that padding plus penalties for cuts is least. Cuts fall at ends of
documents (free), at ends of sentences, or inside very long sentences (dearer). With ``cost[j]`` of
the best cutting up to place ``j``, ``cost[j] = penalty[j] + size + min(cost[i] + i) - j`` over the
cuts ``i`` at most ``size`` before ``j``: a minimum over a sliding window, held in a monotone queue.
Windows whose length is a power of two need no padding; they are transitions of their own.

The stream is cut off after ``stream_tokens`` ids, at the end of a document, which bounds memory
(one longer document is held whole). Near a stream's end every place may be cut, so its rest goes
into powers of two. Nothing is shuffled: a partition's rows depend on that partition alone.

Edges: a null or empty text is just the id ``last``. Repeated rows are documents of their own. A
null ``doc_id`` is allowed. Empty partitions give nothing. Other columns are ignored.
"""

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from metertide.llm.batches import release_memory, slices
from metertide.llm.tokens import default_vocabulary, forget, token_ids

SIZE = 4096
LAST = 2
#: In padded ids: a cut after a sentence, a cut inside one, and every window.
SENTENCE_PENALTY, INSIDE_PENALTY, WINDOW_PENALTY = 2, 16, 4
#: Sentences longer than this many ids may be cut inside, at multiples of the step.
LONG_SENTENCE, STEP = 512, 64
STREAM_TOKENS = 1 << 22
#: Shorter windows of a power of two would only be looked for within ``size`` of a stream's end.
LEAST_POWER = 1


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def _distinct(*parts: np.ndarray) -> np.ndarray:
    """All values, ascending, each once."""
    values = np.sort(np.concatenate(parts))
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def possible_cuts(ends: np.ndarray, sentences: np.ndarray, size: int = SIZE):
    """Places that may be cut, ascending from 0, and the penalty of each."""
    total = int(ends[-1])
    whole = _distinct(ends, sentences)
    gaps = np.diff(np.concatenate(([0], whole)))
    long = np.flatnonzero(gaps > min(LONG_SENTENCE, size // 2))
    step = min(STEP, max(1, size // 8))
    inside = [np.arange(whole[i] - gaps[i] + step, whole[i], step) for i in long]
    tail = np.arange(max(1, total - size), total)
    places = _distinct(np.array([0]), whole, tail, *inside)
    penalty = np.full(len(places), INSIDE_PENALTY, dtype=np.int64)
    penalty[np.searchsorted(places, sentences)] = SENTENCE_PENALTY
    penalty[np.searchsorted(places, ends)] = 0
    return places, penalty + WINDOW_PENALTY


def best_cuts(
    places: np.ndarray, penalty: np.ndarray, size: int = SIZE, least_power: int = LEAST_POWER
) -> np.ndarray:
    """The ends of the windows of the cheapest cutting."""
    to, from_power = [], []
    power = 1
    while power <= size:
        late = 0 if power >= least_power else int(np.searchsorted(places, places[-1] - size))
        ends = places[late:]
        before = np.searchsorted(places, ends - power)
        hit = np.flatnonzero(places[before] == ends - power)
        to.append((hit + late).astype(np.int32))
        from_power.append(before[hit].astype(np.int32))
        power *= 2
    # Numbers lie in arrays, as a list takes some 40 bytes for each. Jumps to a place are
    # ``jumps[begins[j]:begins[j + 1]]``, the shortest first.
    joined = np.concatenate(to)
    jumps = memoryview(np.concatenate(from_power)[np.argsort(joined, kind="stable")])
    count = np.bincount(joined, minlength=len(places))
    begins = memoryview(np.concatenate(([0], np.cumsum(count))))
    at, fee = memoryview(np.ascontiguousarray(places)), memoryview(np.ascontiguousarray(penalty))
    cost, back = array("q", [0]) * len(at), array("q", [0]) * len(at)
    queue, values, head = [0], [0], 0  # cuts with rising cost + place
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[head]] < here - size:
            head += 1
        best, from_ = values[head] + size - here, queue[head]
        for i in jumps[begins[j] : begins[j + 1]]:
            if cost[i] < best:
                best, from_ = cost[i], i
        best += fee[j]
        cost[j], back[j] = best, from_
        value = best + here
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(j)
        values.append(value)
        if head > 10_000:
            del queue[:head], values[:head]
            head = 0
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return np.array(cuts[::-1], dtype=np.int64)


def _pieces(keys, ids, ends, sentences, first: int, size: int):
    """One stream's pieces as columns, and its windows' ends."""
    cuts = best_cuts(*possible_cuts(ends, sentences, size), size)
    stops = _distinct(ends, cuts)
    starts = np.concatenate(([0], stops[:-1]))
    doc, window = np.searchsorted(ends, starts, "right"), np.searchsorted(cuts, starts, "right")
    doc_starts, cut_starts = np.concatenate(([0], ends[:-1])), np.concatenate(([0], cuts[:-1]))
    data = ids.astype("<u4", copy=False)
    checks = [zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    columns = {
        "doc_id": keys.take(pa.array(doc)),
        "start": starts - doc_starts[doc],
        "length": stops - starts,
        "ids_crc32": np.array(checks, dtype=np.int64),
        "doc_tokens": (ends - doc_starts)[doc],
        "sequence_id": first + window,
        "offset": starts - cut_starts[window],
    }
    return columns, cuts


def _streams(batches, vocabulary: str, last: int, stream_tokens: int):
    """Streams of a partition: keys, ids, ends of documents, ends of sentences."""
    held, tokens = [], 0

    def joined():
        """What is held, which is held no longer."""
        keys, ids, ends, sentences = ([*column] for column in zip(*held, strict=True))
        held.clear()
        shift = np.cumsum([0, *map(len, ids[:-1])])
        ends, sentences = (
            np.concatenate([x + s for x, s in zip(column, shift, strict=True)])
            for column in (ends, sentences)
        )
        return pa.concat_arrays(keys), np.concatenate(ids), ends, sentences

    for part in slices(batches):
        # A slice of the keys would keep its whole batch, with the texts.
        keys = part.column("doc_id").take(pa.array(np.arange(len(part))))
        held.append((keys, *token_ids(vocabulary, part.column("text"), last)))
        tokens += len(held[-1][1])
        if tokens >= stream_tokens:
            yield joined()
            tokens = 0
    part = None
    if held:
        yield joined()
    forget(vocabulary)
    release_memory()


def pack(
    documents: DataFrame,
    vocabulary: str | None = None,
    size: int = SIZE,
    last: int = LAST,
    stream_tokens: int = STREAM_TOKENS,
) -> DataFrame:
    """One row per piece: which ids of a document lie where in which sequence.

    ``sequence_id`` is unique; its order is that of the partition. ``padding`` is that of the
    sequence, given with its first piece.
    """
    vocabulary = vocabulary or default_vocabulary()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for keys, ids, ends, sentences in _streams(batches, vocabulary, last, stream_tokens):
            columns, cuts = _pieces(keys, ids, ends, sentences, first, size)
            del keys, ids, ends, sentences  # or they would stay while the next stream is read
            lengths = np.diff(np.concatenate(([0], cuts)))
            pads = np.array([padding(x, size) for x in lengths.tolist()], dtype=np.int64)
            window = columns["sequence_id"] - first
            columns["padding"] = np.where(columns["offset"] == 0, pads[window], 0)
            first += len(cuts)
            yield pa.RecordBatch.from_pydict(columns)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        pieces,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, padding long",
    )


def packed_sequences(
    documents: DataFrame,
    vocabulary: str | None = None,
    size: int = SIZE,
    last: int = LAST,
    pad: int = 0,
    stream_tokens: int = STREAM_TOKENS,
) -> DataFrame:
    """The sequences themselves, as training reads them: ``sequence_id``, ``input_ids`` with their
    padding, ``length`` without it, and ``doc_starts``, the places where another document begins."""
    vocabulary = vocabulary or default_vocabulary()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for _, ids, ends, sentences in _streams(batches, vocabulary, last, stream_tokens):
            cuts = best_cuts(*possible_cuts(ends, sentences, size), size).tolist()
            rows, begin = [], 0
            for k, stop in enumerate(cuts):
                own = ids[begin:stop]
                inner = ends[bisect_left(ends, begin + 1) : bisect_left(ends, stop)] - begin
                rows.append(
                    {
                        "sequence_id": first + k,
                        "input_ids": np.pad(
                            own.astype(np.int32), (0, padding(len(own), size)), constant_values=pad
                        ),
                        "length": stop - begin,
                        "doc_starts": inner.astype(np.int32),
                    }
                )
                begin = stop
            del ids, ends, own, inner  # or they would stay while the next stream is read
            first += len(cuts)
            names = ("sequence_id", "input_ids", "length", "doc_starts")
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names
            )

    return documents.select("doc_id", "text").mapInArrow(
        sequences, "sequence_id long, input_ids array<int>, length int, doc_starts array<int>"
    )
