import hashlib
import random

import numpy as np
import pytest

from metertide.llm import substrings
from metertide.llm.substrings import (
    MATCH,
    Frequent,
    repeated_passages,
    rolling,
    runs_of,
    sliding_minimum,
    smallest_ids,
)
from tests.llm import samples


def brute_force(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows (doc_id, text)."""
    smallest = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - MATCH + 1):
            s = data[i : i + MATCH]
            if key is not None:
                smallest[s] = min(smallest.get(s, key), key)
    result = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - MATCH + 1):
            if key is not None and smallest[data[i : i + MATCH]] < key:
                gone[i : i + MATCH] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        result.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def found(docs, **options):
    rows = repeated_passages(docs, **options).select(COLUMNS).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_all_documents(spark):
    rows = [(r[0], r[1]) for r in samples.rows()]
    assert found(samples.documents(spark)) == brute_force(rows)


@pytest.mark.parametrize("seed", range(3))
def test_many_small_ranges_and_frequent_passages(spark, seed, monkeypatch):
    rng = random.Random(seed)
    line = "this very common line stands at the head of every document here.\n"
    texts = [line + t for t in samples.texts(40, seed)]
    texts += ["ab " * rng.randint(1, 90) for _ in range(12)]  # periodic: few distinct grams
    texts += [t[rng.randrange(9) :] for t in texts[:10]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substrings, "FREQUENT_TIMES", 3)
    assert found(docs, chunk_bytes=2000, range_tokens=200) == brute_force(rows)


def test_spans_and_carried_columns(spark):
    passage = "a passage of well over fifty bytes that two documents have in common. "
    rows = [(1, passage, "x"), (2, "before " + passage + "after", "y"), (3, "ü" * 40, "z"), (4, "ü" * 41, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    result = {r["doc_id"]: r for r in repeated_passages(docs, ("score",)).collect()}
    assert [(s["begin"], s["end"]) for s in result[2]["spans"]] == [(7, 7 + len(passage))]
    assert result[2]["kept"] == "before after"
    assert result[2]["carried"]["score"] == "y"
    assert result[1]["n_removed"] == 0
    assert result[4]["n_removed"] == 82
    assert result[4]["kept"] == ""


def test_rows_of_one_id_are_not_smaller(spark):
    text = "the same text, of more than fifty bytes, in two rows of one id and more"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    assert [r[:3] for r in found(docs)] == [(1, 71, 0), (1, 71, 0), (2, 71, 71), (None, 71, 0)]


def test_empty_table(spark):
    assert repeated_passages(samples.empty(spark)).count() == 0


def test_runs_hold_every_full_string_once():
    texts = [t.encode() for t in samples.texts(30)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    for frequent in (np.zeros(0, np.uint64), rolling(data, substrings.GRAM)[::7]):
        runs = runs_of(data, starts, Frequent(frequent))
        places = sorted(p for b, c in zip(runs.begin, runs.count, strict=True) for p in range(b, b + c))
        assert places == [
            p for a, b in zip(starts[:-1], starts[1:], strict=True) for p in range(a, b - MATCH + 1)
        ]
        tokens = {}
        for b, c, t in zip(runs.begin, runs.count, runs.token, strict=True):
            for p in range(b, b + c):  # equal strings have equal tokens
                assert tokens.setdefault(data[p : p + MATCH].tobytes(), t) == t


def test_rolling_hash_and_sliding_minimum():
    data = np.frombuffer(b"abcabcabcdefabc", np.uint8)
    hashes = rolling(data, 3)
    assert hashes[0] == hashes[3] == hashes[12] != hashes[1]
    values = np.random.default_rng(1).integers(0, 99, 40).astype(np.uint64)
    for width in (1, 2, 5, 27):
        assert sliding_minimum(values, width).tolist() == [
            min(values[i : i + width].tolist()) for i in range(40 - width + 1)
        ]


def test_smallest_id_of_equal_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[:200]
    data[3000:3100] = data[50:150]
    places = np.arange(len(data) - MATCH)
    ids = rng.integers(0, 1000, len(places))
    least = {}
    for p, i in zip(places.tolist(), ids.tolist(), strict=True):
        s = data[p : p + MATCH].tobytes()
        least[s] = min(least.get(s, i), i)
    expected = [least[data[p : p + MATCH].tobytes()] for p in places.tolist()]
    assert smallest_ids(data, places, ids).tolist() == expected


def test_chunks_without_a_shared_token(spark):
    import string

    rng = random.Random(11)
    rows = [(i, "".join(rng.choices(string.ascii_letters, k=200))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in repeated_passages(docs).collect())


def test_sql_gives_one_row_for_every_row(spark):
    import duckdb
    import pandas as pd

    from metertide.llm.oracle import OP5

    text = "the same text, of more than fifty bytes, in several rows of one id and more"
    rows = [(1, text), (1, text), (2, "x" + text), (2, text + "y"), (None, text), (None, None), (3, ""), (4, text[:60])]
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]})
    database = duckdb.connect()
    database.register("documents", documents)
    columns = ", ".join(COLUMNS)
    expected = database.execute(f"SELECT {columns} FROM ({OP5})").fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == sorted(expected, key=str) == brute_force(rows)
