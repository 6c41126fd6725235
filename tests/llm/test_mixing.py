from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from metertide.llm.mixing import (
    WORD,
    mix_to_targets,
    mixed_documents,
    sainte_lague,
    source_targets,
    word_count,
)
from tests.llm import samples


def one_by_one(weights, seats, caps):
    given = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if given[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


@pytest.mark.parametrize("seed", range(25))
def test_seats_go_to_the_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    weights = rng.integers(0, 1000, n) ** int(rng.integers(1, 3))
    seats = int(rng.integers(0, 400))
    caps = rng.integers(0, 60, n)
    assert sainte_lague(weights, seats, caps).tolist() == one_by_one(
        weights.tolist(), seats, caps.tolist()
    )


def water_level(sizes, weights, share, epochs):
    """Targets by dealing out again what sources cannot take."""
    sizes, weights = [Fraction(s) for s in sizes], [Fraction(w) for w in weights]
    total, full = sum(sizes) * Fraction(share), set()
    while True:
        rest = total - sum(epochs * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if rest * weights[i] / weight > epochs * sizes[i]}
        if not over:
            return [
                float(epochs * sizes[i] if i in full else rest * weights[i] / weight)
                for i in range(len(sizes))
            ]
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_stop_at_the_cap(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 5000, 9).tolist()
    rows = [(f"s{i}", s) for i, s in enumerate(sizes[:-1])] + [(None, sizes[-1])]
    found = source_targets(spark.createDataFrame(rows, "source string, size long")).collect()
    by_place = [r["target"] for r in sorted(found, key=lambda r: r["place"])]
    weights = [(5, 2, 1)[i % 3] for i in range(9)]
    assert by_place == pytest.approx(water_level(sizes, weights, "1.5", 2))
    assert [r["place"] for r in found if r["source"] is None] == [8]


def test_what_documents_give(spark):
    docs = samples.documents(spark, 200)
    found = mix_to_targets(docs, shard_words=700).toPandas()
    rows = samples.rows(200)
    assert len(found) == len(rows)
    sizes = sorted(len([w for w in (r[1] or "").split() if w]) for r in rows)
    assert sorted(found["size"]) == sizes
    assert (found["taken"] <= 2 * found["size"]).all() and (found["taken"] >= 0).all()
    for _, own in found.groupby("source", dropna=False):
        assert own["source_size"].iloc[0] == own["size"].sum()
        # A shard's last block may hold less than the others.
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 32 * (own["size"].sum() / 700 + 1)
    assert found["target"].groupby(found["source"].fillna("-")).first().sum() == pytest.approx(
        1.5 * sum(sizes)
    )
    again = mix_to_targets(docs.repartition(3), shard_words=700).toPandas()
    order = ["doc_id", "source", "size", "taken"]
    lists = [sorted(map(str, x[order].values.tolist())) for x in (found, again)]
    assert lists[0] == lists[1]


def test_blocks_are_taken_whole(spark):
    rows = [(i, "w " * (7 + i % 5), "s" if i % 2 else "t") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mix_to_targets(docs, weights=(1, 1), share=0.5, block_words=10).toPandas()
    for _, own in found.groupby("source"):
        stream = own.sort_values("first")
        assert (stream["first"] == stream["size"].cumsum() - stream["size"]).all()
        taken = []
        for r in stream.itertuples():
            for w in range(r.first, r.first + r.size):
                b = w // 10
                before, after = (((b + k) * r.extra + r.start) // r.blocks for k in (0, 1))
                taken.append(after > before)
        assert sum(taken) == own["taken"].sum()


def test_rows_of_the_mix(spark):
    docs = samples.documents(spark)
    mix = mix_to_targets(docs).filter("doc_id IS NOT NULL AND doc_id <> 1006")
    wanted = {r["doc_id"]: r["taken"] for r in mix.collect() if r["taken"]}
    rows = mixed_documents(docs)
    assert rows.columns == docs.columns
    counted = rows.groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()
    got = {r["doc_id"]: r["n"] for r in counted if r["doc_id"] not in (None, 1006)}
    assert got == wanted


def test_empty_table(spark):
    assert mix_to_targets(samples.empty(spark)).count() == 0
    assert mixed_documents(samples.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mix_to_targets(blank).select("size", "taken").collect()] == [(0, 0)] * 2
    assert WORD


def test_many_equal_and_empty_rows_and_no_ids(spark, monkeypatch):
    monkeypatch.setattr("metertide.llm.mixing.COPIES_AT_ONCE", 7)
    rows = [(5, "a b c", "s")] * 50 + [(i, "", "s") for i in range(300)] + [(6, None, None)]
    rows += [(None, "w " * (1 + i % 4), "t") for i in range(200)] + [(i, "x y", "u") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = mix_to_targets(docs, block_words=4, shard_words=60).toPandas()
    assert len(found) == len(rows)
    key = ["doc_id", "source", "size"]
    counts = found.fillna({"doc_id": -1, "source": "-"}).groupby(key).size().to_dict()
    assert counts[5, "s", 3] == 50 and counts[-1, "t", 2] == 50 and counts[6, "-", 0] == 1
    assert not found[found["size"] == 0][["taken", "copies"]].to_numpy().any()
    assert (found["taken"] <= 2 * found["size"]).all()
    filled = found[found["size"] > 0]
    equal = filled[(filled["doc_id"] == 5) & (filled["source"] == "s")]["first"].sort_values().tolist()
    assert equal == [equal[0] + 3 * i for i in range(50)]
    for source, own in filled.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 4 * (len(own) // 20 + 2), source
    again = mix_to_targets(docs.repartition(2), block_words=4, shard_words=60).toPandas()
    assert sorted(map(str, again.values.tolist())) == sorted(map(str, found.values.tolist()))
    assert mixed_documents(docs, block_words=4, shard_words=60).count() > 0


def test_no_window_holds_the_empty_texts_of_a_source(spark):
    docs = spark.range(200_000).selectExpr("id AS doc_id", "'' AS text", "'s' AS source")
    some = spark.createDataFrame([(-1, "a b", "s")], docs.schema)
    found = mix_to_targets(docs.unionByName(some))
    assert found.agg(F.sum("taken"), F.count(F.lit(1))).first()[1] == 200_001
