"""Arrow batches inside tasks: bounded slices, and words as numbers."""

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a slice holds at most, unless one text alone is longer.
SLICE_BYTES = 4 << 20


def release_memory() -> None:
    """Give memory that is free back to the machine, as workers live on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ``limit`` bytes of ``column``; a row is never cut."""
    for batch in batches:
        release_memory()
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if total + size > limit and row > begin:
                yield batch.slice(begin, row - begin)
                begin, total = row, 0
            total += size
        if len(sizes) > begin:
            yield batch.slice(begin)
    release_memory()


@dataclass
class Words:
    """Runs of non-blank characters of several texts: ``distinct[index[starts[i]:starts[i + 1]]]``."""

    distinct: pa.Array
    index: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def words_of(texts: pa.Array) -> Words:
    """Words between ASCII white space, empty ones left out; a null text has none."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    encoded = lists.flatten().dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    distinct = encoded.dictionary
    empty = pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        kept = ~empty[index]
        index = index[kept]
        starts = np.concatenate(([0], np.cumsum(kept)))[starts]
    return Words(distinct, index, starts)


def concatenated(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings in a row, and where each begins and ends."""
    values = values.cast(pa.large_string()) if not pa.types.is_large_string(values.type) else values
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[
        values.offset : values.offset + len(values) + 1
    ]
    data = values.buffers()[2]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(counts: np.ndarray) -> np.ndarray:
    """``0..counts[0]-1, 0..counts[1]-1, ...``"""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
