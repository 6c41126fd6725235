import zlib
from itertools import pairwise

import numpy as np
import pytest

from metertide.llm.packing import best_cuts, pack, packed_sequences, padding, possible_cuts
from metertide.llm.tokens import default_vocabulary
from tests.llm import samples


def brute_force(places, penalty, size):
    cost = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        cost[j] = min(
            cost[i] + padding(places[j] - places[i], size) + penalty[j]
            for i in range(j)
            if places[j] - places[i] <= size
        )
    return cost[-1]


@pytest.mark.parametrize("seed", range(8))
def test_cuts_cost_as_little_as_any(seed):
    rng = np.random.default_rng(seed)
    size = 64
    ends = np.unique(rng.integers(1, 900, 12))
    sentences = np.unique(rng.integers(1, ends[-1] + 1, 40))
    places, penalty = possible_cuts(ends, sentences, size)
    assert places[0] == 0 and places[-1] == ends[-1]
    cuts = best_cuts(places, penalty, size, least_power=1)
    fee = dict(zip(places.tolist(), penalty.tolist(), strict=True))
    paid = sum(padding(b - a, size) + fee[b] for a, b in pairwise([0, *cuts.tolist()]))
    assert paid == brute_force(places.tolist(), penalty.tolist(), size)


def test_powers_of_two_need_no_padding():
    assert [padding(x) for x in (1, 2, 1024, 4096, 3, 4095)] == [0, 0, 0, 0, 4093, 1]


def expected_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_every_id_lies_in_one_piece(spark):
    docs = samples.documents(spark)
    pieces = pack(docs).toPandas()
    rows = {}
    for row in samples.rows():
        rows.setdefault(row[0], []).append(expected_ids(row[1]))
    for key, lists in rows.items():
        own = pieces[pieces["doc_id"].isna() if key is None else pieces["doc_id"] == key]
        assert own["length"].sum() == sum(map(len, lists))
        if len(lists) > 1:
            continue
        ids, place = np.array(lists[0], dtype="<u4"), 0
        assert set(own["doc_tokens"]) == {len(ids)}
        for piece in own.sort_values("start").itertuples():
            assert piece.start == place
            assert zlib.crc32(ids[place : place + piece.length].tobytes()) == piece.ids_crc32
            place += piece.length
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["length"].sum() <= 4096
        assert own["padding"].sum() == padding(int(own["length"].sum()))
    assert pieces["padding"].sum() < 0.02 * pieces["length"].sum()


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = samples.documents(spark).repartition(2, "doc_id").cache()
    pieces, sequences = pack(docs).toPandas(), packed_sequences(docs).toPandas()
    assert set(pieces["sequence_id"]) == set(sequences["sequence_id"])
    by_id = {s.sequence_id: s for s in sequences.itertuples()}
    for piece in pieces.itertuples():
        own = by_id[piece.sequence_id].input_ids[piece.offset : piece.offset + piece.length]
        assert zlib.crc32(np.asarray(own, dtype="<u4").tobytes()) == piece.ids_crc32
    for s in sequences.itertuples():
        assert len(s.input_ids) == s.length + padding(s.length)
    docs.unpersist()


def test_small_streams_and_empty_tables(spark):
    docs = samples.documents(spark, partitions=1)
    whole = pack(docs, stream_tokens=500).toPandas()
    assert whole["length"].sum() == pack(docs).toPandas()["length"].sum()
    assert whole["sequence_id"].nunique() == whole["sequence_id"].max() + 1
    assert pack(samples.empty(spark)).count() == 0


def test_documents_keep_their_order(spark):
    docs = samples.documents(spark).coalesce(1).sortWithinPartitions("doc_id")
    pieces = pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    known = pieces["doc_id"].dropna().tolist()
    assert known == sorted(known)


def test_plain_words_get_the_ids_of_the_whole_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from metertide.llm.tokens import _plain_ids, ids_of_words, splits_plainly

    path = default_vocabulary()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    words = [
        "The", "THE!!", "don't", "'s", "Überß,", "naïve.", "x'", "it's.", "e\u0301te", "ΑΣ", "İx", "a|b",
        "3rd", "<|endoftext|>", "word<|endoftext|>", "|", "日本語", "ﬁx", "µm", "ªº", "a\u00ad", "Ÿ", "a\u0301.",
        *samples.prose(__import__("random").Random(1), "es", 300).split(),
    ]
    assert 49407 not in tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids
    assert splits_plainly(path)
    assert _plain_ids(path, "don't") is None
    found = ids_of_words(path, pa.array(words))
    assert [np.frombuffer(x, np.uint32).tolist() for x in found] == [
        tokenizer.encode(w, add_special_tokens=False).ids for w in words
    ]


def test_short_windows_are_tried_everywhere():
    size = 64
    for seed in range(8):
        rng = np.random.default_rng(seed)
        ends = np.unique(rng.integers(1, 900, 40))
        places, penalty = possible_cuts(ends, np.unique(rng.integers(1, ends[-1] + 1, 40)), size)
        fee = dict(zip(places.tolist(), penalty.tolist(), strict=True))
        cuts = best_cuts(places, penalty, size).tolist()
        paid = sum(padding(b - a, size) + fee[b] for a, b in pairwise([0, *cuts]))
        assert paid == brute_force(places.tolist(), penalty.tolist(), size)


def test_memory_is_given_back_at_a_tasks_end():
    import pyarrow as pa

    from metertide.llm.packing import _streams
    from metertide.llm.tokens import _known

    path = default_vocabulary()
    texts = [samples.prose(__import__("random").Random(i), "es", 200) for i in range(12)]
    batch = pa.record_batch({"doc_id": pa.array(range(12)), "text": pa.array(texts)})
    streams, found = _streams(iter([batch, batch]), path, 2, 1500), []
    for _, ids, ends, _ in streams:
        found += [ids[a:b].tolist() for a, b in pairwise([0, *ends.tolist()])]
        assert _known(path)  # words are looked up from stream to stream
    assert found == 2 * [expected_ids(t) for t in texts]
    assert not _known(path)


def test_cutting_holds_little_for_each_place():
    import tracemalloc

    rng = np.random.default_rng(0)
    ends = np.unique(rng.integers(1, 400_000, 400))
    places, penalty = possible_cuts(ends, np.unique(rng.integers(1, ends[-1] + 1, 40_000)))
    best_cuts(places[:9], penalty[:9])
    tracemalloc.start()
    best_cuts(places, penalty)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130 * len(places)
