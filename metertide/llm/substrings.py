"""Suffix-array dedup of byte passages, by sorting suffixes in range partitions.

A byte goes if it is covered by a string of ``MATCH`` bytes that also starts in a document with a
smaller id. Documents lie in chunks. Every place from which ``MATCH`` bytes follow is a suffix, and
is put into the order of its leading token: the gram of ``GRAM`` bytes with the least hash among those
in its ``MATCH`` bytes. Equal strings have equal leading tokens, and neighbouring suffixes mostly
share theirs, so they travel together, as one run of bytes. Splitters sampled from the tokens cut
their order into ranges of near equal size.

1. Every chunk sends its distinct tokens to their ranges and learns which of them other documents
   hold as well. Most suffixes end here.
2. For the rest it sends each distinct run once, with the smallest id that holds it. A range sorts
   the suffixes of its runs by multikey sorting, eight bytes at a time, leaving out those that
   stand alone at some depth, and finds the smallest id of every string of ``MATCH`` bytes.
3. Every chunk learns which of its strings start in a document with a smaller id.

Ranges are cut between tokens, so no two equal strings lie in different ranges and there is nothing
left to compare across a boundary. Tokens that are frequent in a sample (a bounded one, of
``SAMPLE_BYTES``) are never chosen as leading ones, unless a string has no other: then the whole
string's hash takes their place. So neither a passage that many documents share nor a gram that many
different passages share makes a range large. Sample and splitters affect the work, not the result.

The chunks' texts are shuffled once; all three steps read that one exchange. Ranges and
chunks are both bounded in size, whatever the table's, and the number of messages between
them is their product; ``chunk_bytes`` should rise with the memory of executors.

Edges: a null or empty text has no bytes. Texts below ``MATCH`` bytes lose nothing. Rows that share
a ``doc_id`` don't count as smaller than each other. Rows with a null ``doc_id`` lose nothing, take
nothing from others, and are rows of the result. Exact copies lose all but the one with the smallest id (if long enough).
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from metertide.llm.batches import concatenated, release_memory, runs, slices

MATCH, GRAM = 50, 24
CHUNK_BYTES, RANGE_TOKENS = 8 << 20, 1 << 18
#: Bytes that are hashed at a time, unless one document is longer.
STRIP_BYTES = 1 << 20
SAMPLE_BYTES, SPLITTER_SAMPLE = 64 << 20, 1 << 16
#: Tokens above this share of the sampled ones (and this often) are frequent.
FREQUENT_SHARE, FREQUENT_TIMES = 1 / 65536, 16
#: A run holds at most so many suffixes, one bit each.
RUN = 32
_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from every place, by doubling."""
    with np.errstate(over="ignore"):
        power, size = np.uint64(_BASE), 1
        block = data.astype(np.uint64) + np.uint64(1)
        whole, covered = None, 0
        while True:
            if length & size:
                if whole is None:
                    whole, covered = block, size
                else:
                    n = len(data) - covered - size + 1
                    whole = whole[:n] * power + block[covered : covered + n]
                    covered += size
            if 2 * size > length:
                break
            block = block[:-size] * power + block[size:]
            power, size = power * power, 2 * size
        whole = whole ^ (whole >> np.uint64(31))
        whole = whole * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


class Frequent:
    """Whether hashes are among the frequent ones: a small table sorts out most others."""

    BITS = 18

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.table = np.zeros(1 << self.BITS, dtype=bool)
        self.table[self._slot(self.values)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.table[self._slot(hashes)])
        near = np.searchsorted(self.values, hashes[maybe]).clip(max=len(self.values) - 1)
        return maybe[self.values[near] == hashes[maybe]]


@dataclass
class Runs:
    """Suffixes that follow each other and share a leading token."""

    begin: np.ndarray
    count: np.ndarray
    token: np.ndarray
    doc: np.ndarray


def runs_of(data: np.ndarray, starts: np.ndarray, frequent: Frequent) -> Runs:
    """The runs of all documents ``data[starts[i]:starts[i + 1]]``, in order."""
    found = []
    ends = starts[1:]
    cut = 0
    while cut < len(ends):
        last = max(cut + 1, int(np.searchsorted(ends, starts[cut] + STRIP_BYTES, "right")))
        found.append(_runs_of_strip(data, starts, cut, last, frequent))
        cut = last
    return Runs(
        *(np.concatenate([getattr(x, k) for x in found] or [np.zeros(0, np.int64)])
          for k in ("begin", "count", "token", "doc"))
    )


def _runs_of_strip(data, starts, first: int, last: int, frequent: Frequent) -> Runs:
    base, own = int(starts[first]), starts[first : last + 1] - starts[first]
    strip = data[base : base + int(own[-1])]
    n = len(strip) - MATCH + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return Runs(empty, empty, empty.astype(np.uint64), empty)
    grams = rolling(strip, GRAM)
    grams[frequent.places(grams)] = _NONE
    token = sliding_minimum(grams, MATCH - GRAM + 1)
    valid = np.ones(n + 1, dtype=bool)
    for back in range(1, MATCH):  # a string may not run over the end of its document
        at = own[1:] - back
        at = at[(at >= own[:-1]) & (at < n)]
        valid[at] = False
    valid[n] = False
    # Ends of the strip's last documents lie beyond n, where no string starts anyway.
    bare = np.flatnonzero((token == _NONE) & valid[:n])
    if len(bare):
        token[bare] = rolling(strip, MATCH)[bare] | np.uint64(1 << 63)
    goes_on = np.zeros(n + 1, dtype=bool)  # the run of the place before goes on here
    goes_on[1:n] = (token[1:] == token[:-1]) & valid[: n - 1] & valid[1:n]
    begin = np.flatnonzero(valid[:n] & ~goes_on[:n])
    count = np.flatnonzero(valid[:n] & ~goes_on[1:]) - begin + 1
    parts = -(-count // RUN)
    nth = runs(parts)
    begin = np.repeat(begin, parts) + nth * RUN
    count = np.minimum(np.repeat(count, parts) - nth * RUN, RUN)
    doc = np.searchsorted(own[1:], begin, "right") + first
    return Runs(begin + base, count, token[begin], doc)


@dataclass
class Chunk:
    """Documents in order of their ids, their bytes in a row, and their runs."""

    table: pa.Table
    ids: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    runs: Runs

    @staticmethod
    def of(table: pa.Table, frequent: Frequent) -> "Chunk":
        release_memory()  # what the chunk or range before has left
        # A shuffle's rows come in any order; every step must see the same.
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
        table = table.combine_chunks()
        texts = table["text"].fill_null("").cast(pa.large_string()).combine_chunks()
        data, starts = concatenated(texts)
        return Chunk(
            table, table["doc_id"].to_numpy(), data, starts, runs_of(data, starts, frequent)
        )

    def tokens(self):
        """Distinct tokens, the place of each run's among them, and which several documents hold."""
        distinct, place = np.unique(self.runs.token, return_inverse=True)
        ids = self.ids[self.runs.doc]
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        high = np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, place, ids)
        np.maximum.at(high, place, ids)
        return distinct, place, low != high

    def strings(self, shared: np.ndarray, place: np.ndarray):
        """Runs with a shared token: their places, which distinct bytes each holds, the distinct
        ones, and the first run that holds each (which has the smallest id)."""
        wanted = np.flatnonzero(shared[place])
        bytes_ = segments(self.data, self.runs.begin[wanted], self.runs.count[wanted] + MATCH - 1)
        encoded = bytes_.dictionary_encode()
        code = encoded.indices.to_numpy()
        first = np.full(len(encoded.dictionary), len(code), dtype=np.int64)
        np.minimum.at(first, code, np.arange(len(code)))
        return wanted, code, encoded.dictionary, wanted[first] if len(first) else first


def segments(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Cuts of ``data`` as an Arrow column; gathered bit by bit, as a place takes eight bytes."""
    offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    picked = np.empty(int(offsets[-1]), dtype=np.uint8)
    step = 1 << 14
    for i in range(0, len(begin), step):
        part = slice(i, i + step)
        low, high = int(offsets[i]), int(offsets[min(i + step, len(begin))])
        places = np.repeat(begin[part] - offsets[:-1][part], length[part])
        places += np.arange(low, high)
        picked[low:high] = data[places]
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(picked)]
    return pa.Array.from_buffers(pa.large_binary(), len(begin), buffers)


def by_range(tokens: np.ndarray, splitters: np.ndarray):
    """Order of the tokens by range, and (range, begin, end) of each in that order."""
    range_ = np.searchsorted(splitters, tokens, "right")
    order = np.argsort(range_, kind="stable")
    names, begins = np.unique(range_[order], return_index=True)
    stops = np.append(begins[1:], len(order))[: len(names)]
    return order, list(zip(names.tolist(), begins.tolist(), stops.tolist(), strict=True))


def smallest_ids(data: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For the string of ``MATCH`` bytes at each place the smallest id among its equals.

    Multikey sorting: by the first eight bytes, then every group of equals by the next eight, and so
    on. A string that has no equal drops out where that shows.
    """
    word = data.astype(np.uint64)
    for size in (1, 2, 4):
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
    result = ids.copy()
    live, group = np.arange(len(places)), np.zeros(len(places), dtype=np.int64)
    for depth in [*range(0, MATCH - 7, 8), MATCH - 8]:
        key = word[places[live] + depth]
        order = np.lexsort((key, group)) if depth else np.argsort(key, kind="stable")
        live, key, group = live[order], key[order], group[order]
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(fresh) - 1
        kept = np.bincount(group)[group] > 1 if len(group) else fresh
        live, group = live[kept], group[kept]
    if len(live):
        begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least = np.minimum.reduceat(ids[live], begins)
        result[live] = np.repeat(least, np.diff(np.append(begins, len(live))))
    return result


def _shared_tokens(table: pa.Table) -> pa.Table:
    """Step 1 in a range: per chunk one bit for each token, set if another chunk or several
    documents hold it."""
    release_memory()
    blobs = [np.frombuffer(x, dtype=np.uint32) for x in table["tokens"].to_pylist()]
    again = [np.frombuffer(x, dtype=np.uint32) for x in table["again"].to_pylist()]
    values, times = np.unique(np.concatenate([*blobs, *again]), return_counts=True)
    values = values[times > 1]
    masks = []
    for blob in blobs:
        near = np.searchsorted(values, blob).clip(max=max(0, len(values) - 1))
        hit = values[near] == blob if len(values) else np.zeros(len(blob), dtype=bool)
        masks.append(np.packbits(hit).tobytes())
    return pa.table({"chunk": table["chunk"], "range": table["range"], "mask": masks})


def _repeated_strings(table: pa.Table) -> pa.Table:
    """Step 2 in a range: per chunk and run one bit for each suffix, set if a document with a smaller
    id than the run's smallest holds its string."""
    release_memory()
    counts = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in table["counts"].to_pylist()]
    lowest = [np.frombuffer(x, dtype=np.int64) for x in table["ids"].to_pylist()]
    count, low = np.concatenate(counts), np.concatenate(lowest)
    joined = np.frombuffer(b"".join(table["bytes"].to_pylist()), dtype=np.uint8)
    lengths = count + MATCH - 1
    encoded = segments(joined, np.cumsum(lengths) - lengths, lengths).dictionary_encode()
    code = encoded.indices.to_numpy()
    data, starts = concatenated_bytes(encoded.dictionary)
    least = np.full(len(encoded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, code, low)
    per = np.diff(starts) - (MATCH - 1)
    first = np.cumsum(per) - per
    smallest = smallest_ids(data, np.repeat(starts[:-1], per) + runs(per), np.repeat(least, per))
    places = np.repeat(first[code], count) + runs(count)
    bits = (smallest[places] < np.repeat(low, count)).astype(np.uint32) << runs(count).astype(np.uint32)
    begins = np.cumsum(count) - count
    masks = np.add.reduceat(bits, begins).astype(np.uint32)
    cuts = np.cumsum([len(x) for x in counts])[:-1]
    blobs = [x.tobytes() for x in np.split(masks, cuts)]
    return pa.table({"chunk": table["chunk"], "range": table["range"], "mask": blobs})


def concatenated_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[
        values.offset : values.offset + len(values) + 1
    ]
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _masks(table: pa.Table) -> list[bytes]:
    if not len(table):
        return []
    return table.take(pc.sort_indices(table, [("range", "ascending")]))["mask"].to_pylist()


def _frequent_and_splitters(documents: DataFrame, total: int, ranges: int):
    """Frequent tokens and splitters, from a sample of about ``SAMPLE_BYTES`` of the documents.

    A first look at the tokens of the sample finds the frequent ones; with those left out, the tokens
    that lead instead are sampled again for the splitters.
    """
    one_of = max(1, total // SAMPLE_BYTES)
    sample = documents.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_of)) == 0).select("text")

    def leading(frequent: Frequent):
        def tokens(batches):
            for part in slices(batches, limit=STRIP_BYTES):
                data, starts = concatenated(part.column("text").fill_null("").cast(pa.large_string()))
                found = runs_of(data, starts, frequent).token
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["token"])

        return sample.mapInArrow(tokens, "token long")

    counted = leading(Frequent(np.zeros(0, np.uint64))).groupBy("token").count()
    least = max(FREQUENT_TIMES, int(total / one_of / 14 * FREQUENT_SHARE))
    often = counted.filter(F.col("count") >= least).select("token").toPandas()["token"]
    values = often.to_numpy(dtype=np.int64).view(np.uint64)
    every = max(1, int(total / one_of / 14) // SPLITTER_SAMPLE)
    picked = leading(Frequent(values)).filter(F.pmod(F.xxhash64("token"), F.lit(every)) == 0)
    tokens = np.sort(picked.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))
    cuts = np.linspace(0, len(tokens), ranges + 1)[1:-1].astype(np.int64)
    return values, np.unique(tokens[cuts]) if len(tokens) else tokens


def repeated_passages(
    documents: DataFrame,
    carried: tuple[str, ...] = (),
    chunk_bytes: int = CHUNK_BYTES,
    range_tokens: int = RANGE_TOKENS,
) -> DataFrame:
    """Per document ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of the bytes that stay,
    ``spans`` (begin and end of what goes) and ``kept``, the bytes that stay as text.

    Spans are bytes and may cut characters; ``kept`` leaves the cut ones out. Columns named in
    ``carried`` are passed through, in ``carried``. One row for every row, also with a null ``doc_id``.
    """
    all_rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.struct(*(F.col(c) for c in carried) or [F.lit(0).alias("none")]).alias("carried"),
    )
    rows = all_rows.filter("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(16, -(-total // chunk_bytes))
    ranges = max(1, -(-total // (14 * range_tokens)))
    often, splitters = _frequent_and_splitters(rows, total, ranges)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int"))
    by_chunk = chunked.groupBy("chunk")
    carried_type = next(f for f in rows.schema.fields if f.name == "carried").dataType

    def send_tokens(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = Chunk.of(table, Frequent(often))
        distinct, _, several = chunk.tokens()
        order, parts = by_range(distinct, splitters)
        low, several = distinct[order].astype(np.uint32), several[order]
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                "range": pa.array([r for r, _, _ in parts], pa.int32()),
                "tokens": pa.array([low[i:j].tobytes() for _, i, j in parts], pa.binary()),
                "again": pa.array(
                    [low[i:j][several[i:j]].tobytes() for _, i, j in parts], pa.binary()
                ),
            }
        )

    def strings_of(table: pa.Table, masks: pa.Table):
        chunk = Chunk.of(table, Frequent(often))
        distinct, place, _ = chunk.tokens()
        order, parts = by_range(distinct, splitters)
        shared = np.zeros(len(distinct), dtype=bool)
        for (_, i, j), mask in zip(parts, _masks(masks), strict=True):
            shared[order[i:j]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=j - i)
        wanted, code, bytes_, first = chunk.strings(shared, place)
        return chunk, wanted, code, bytes_, first, by_range(chunk.runs.token[first], splitters)

    def send_strings(key: tuple[pa.Scalar, ...], table: pa.Table, masks: pa.Table) -> pa.Table:
        chunk, _, _, bytes_, first, (order, parts) = strings_of(table, masks)
        data, starts = concatenated_bytes(bytes_.take(pa.array(order)))
        count = chunk.runs.count[first][order].astype(np.uint8)
        ids = chunk.ids[chunk.runs.doc[first]][order]
        return pa.table(
            {
                "chunk": pa.array([key[0].as_py()] * len(parts), pa.int32()),
                "range": pa.array([r for r, _, _ in parts], pa.int32()),
                "counts": pa.array([count[i:j].tobytes() for _, i, j in parts], pa.binary()),
                "ids": pa.array([ids[i:j].tobytes() for _, i, j in parts], pa.binary()),
                "bytes": pa.array(
                    [data[starts[i] : starts[j]].tobytes() for _, i, j in parts], pa.binary()
                ),
            }
        )

    def cut(table: pa.Table, masks: pa.Table) -> pa.Table:
        shared, found = (
            masks.filter(pc.equal(masks["step"], step)) if len(masks) else masks for step in (1, 2)
        )
        chunk, wanted, code, _, first, (order, _) = strings_of(table, shared)
        removed = np.zeros(len(chunk.data), dtype=bool)
        if len(wanted):
            bits = np.zeros(len(first), dtype=np.uint32)
            bits[order] = np.frombuffer(b"".join(_masks(found)), dtype=np.uint32)
            ids = chunk.ids[chunk.runs.doc]
            count = chunk.runs.count[wanted]
            later = ids[wanted] > ids[first][code]  # a smaller id in this very chunk
            mask = np.where(later, np.uint32(2**32 - 1), bits[code])
            nth = runs(count)
            hit = (np.repeat(mask, count) >> nth.astype(np.uint32)) & np.uint32(1) == 1
            places = (np.repeat(chunk.runs.begin[wanted], count) + nth)[hit]
            removed[places] = True
            begun = np.cumsum(removed, dtype=np.int32)  # strings that start up to here
            begun[MATCH:] -= begun[:-MATCH].copy()
            removed = begun > 0
        return _result(chunk, removed)

    masks = (
        by_chunk.applyInArrow(send_tokens, "chunk int, range int, tokens binary, again binary")
        .groupBy("range")
        .applyInArrow(_shared_tokens, "chunk int, range int, mask binary")
    )
    strings = (
        by_chunk.cogroup(masks.groupBy("chunk"))
        .applyInArrow(
            send_strings, "chunk int, range int, counts binary, ids binary, bytes binary"
        )
        .groupBy("range")
        .applyInArrow(_repeated_strings, "chunk int, range int, mask binary")
    )
    both = masks.withColumn("step", F.lit(1)).unionByName(strings.withColumn("step", F.lit(2)))
    found = by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin:long,end:long>>, kept string, "
        f"carried {carried_type.simpleString()}",
    )
    text, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    whole = all_rows.filter("doc_id IS NULL").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        none.alias("n_removed"),
        none.alias("n_spans"),
        F.sha2(text, 256).alias("kept_sha256"),
        F.array().cast("array<struct<begin:long,end:long>>").alias("spans"),
        text.alias("kept"),
        "carried",
    )
    return found.unionByName(whole)


def _result(chunk: Chunk, removed: np.ndarray) -> pa.Table:
    starts, span = chunk.starts, pa.struct([("begin", pa.int64()), ("end", pa.int64())])
    columns: dict[str, list] = {k: [] for k in ("removed", "spans", "sha256", "ranges", "kept")}
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        gone = removed[begin:end]
        text = chunk.data[begin:end]
        stays = text[~gone].tobytes()
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        columns["removed"].append(int(gone.sum()))
        columns["spans"].append(len(turns) // 2)
        columns["sha256"].append(hashlib.sha256(stays).hexdigest())
        columns["ranges"].append(
            [{"begin": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()]
        )
        columns["kept"].append(stays.decode("utf-8", "ignore"))
    return pa.table(
        {
            "doc_id": chunk.table["doc_id"],
            "n_bytes": pa.array(np.diff(starts), pa.int64()),
            "n_removed": pa.array(columns["removed"], pa.int64()),
            "n_spans": pa.array(columns["spans"], pa.int64()),
            "kept_sha256": pa.array(columns["sha256"], pa.string()),
            "spans": pa.array(columns["ranges"], pa.list_(span)),
            "kept": pa.array(columns["kept"], pa.string()),
            "carried": chunk.table["carried"],
        }
    )
