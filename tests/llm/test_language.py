import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from metertide.llm.batches import words_of
from metertide.llm.language import (
    held_out,
    identify_languages,
    infer_mixtures,
    learn_languages,
    of_known_language,
    trigrams,
)
from tests.llm import samples


def labelled(spark):
    rng = random.Random(3)
    rows = [(i, samples.prose(rng, lang), lang) for i, lang in enumerate(["en", "de", "es"] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_counts_follow_every_trigram():
    buckets, owner, letters = trigrams(pa.array(["ab", "12", "A-b"]))
    assert letters.tolist() == [True, False, True]
    assert owner.tolist() == [0, 0, 2, 2, 2]  # ' ab ' has two trigrams, ' a b ' three
    again, _, _ = trigrams(pa.array(["AB."]))
    assert buckets[:2].tolist() == again[:2].tolist()


def test_held_out_texts_are_told_apart(spark):
    docs = labelled(spark)
    apart = held_out(F.col("doc_id"), 4, 2)
    langs, model = learn_languages(docs.filter(~apart))
    found = identify_languages(docs, langs, model).join(docs.filter(apart), "doc_id").collect()
    assert langs == ["de", "en", "es"]
    assert len(found) > 10
    assert all(r["lang_pred"] == r["lang"] and r["score"] > 0.8 for r in found)


def test_a_text_of_two_languages_gets_both_shares(spark):
    langs, model = learn_languages(labelled(spark))
    rng = random.Random(5)
    mixed = samples.prose(rng, "en", 300) + " " + samples.prose(rng, "de", 100)
    alone = samples.prose(rng, "es", 200)
    shares = infer_mixtures(words_of(pa.array([mixed, alone])), model)
    assert abs(shares[0][langs.index("en")] - 0.75) < 0.1
    assert abs(shares[0][langs.index("de")] - 0.25) < 0.1
    assert np.count_nonzero(shares[1]) == 1


def test_shares_are_those_of_plain_expectation_maximisation(spark):
    _, model = learn_languages(labelled(spark))
    rng = random.Random(6)
    text = samples.prose(rng, "en", 80) + " " + samples.prose(rng, "es", 60)
    words = [w for w in text.split()]
    likely = []
    for word in words:
        buckets, _, _ = trigrams(pa.array([word]))
        logs = model[buckets].sum(axis=0)
        likely.append(np.exp(np.maximum(logs - logs.max(), -30)))
    likely = np.array(likely)
    pair = [1, 2]
    share = np.ones(2) / 2
    for _ in range(10):
        r = likely[:, pair] * share
        share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    shares = infer_mixtures(words_of(pa.array([text])), model)[0]
    assert shares[0] == 0
    assert np.allclose(shares[pair], share, atol=1e-3)


def test_odd_rows(spark):
    docs = samples.documents(spark)
    langs, model = learn_languages(docs)
    found = identify_languages(docs, langs, model).collect()
    assert len(found) == len(samples.rows())
    by_id = {r["doc_id"]: r for r in found}
    for key in (1000, 1001, 1002, 1003):
        assert (by_id[key]["lang_pred"], by_id[key]["score"]) == ("und", 0.0)
    assert by_id[1004]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in found)
    kept = of_known_language(docs, langs, model)
    assert kept.columns == docs.columns
    assert kept.count() == len(found) - 4


def test_nothing_learned_and_nothing_there(spark):
    langs, model = learn_languages(samples.empty(spark))
    assert langs == []
    found = identify_languages(samples.documents(spark), langs, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in found} == {("und", 0.0)}
    assert identify_languages(samples.empty(spark), langs, model).count() == 0


def test_held_out_is_the_checksum_of_the_id_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id"), 4, 2).alias("apart")).collect()
    assert all(r["apart"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
