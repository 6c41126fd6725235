import hashlib
import random

from pyspark.sql import functions as F

from metertide.llm import imatch
from metertide.llm.imatch import (
    document_frequencies,
    edited_fingerprints,
    fingerprints,
    likeness,
    next_documents,
)
from tests.llm import samples


def expected_edits(rows):
    """doc_id, n_chars and sha256 of the edit of rows (doc_id, text), in any order."""

    def place(row):
        key, text = row
        return key is None, -(key or 0), hashlib.sha256(text.encode()).hexdigest()

    rows = sorted(((key, text or "") for key, text in rows), key=place)
    result = []
    for i, (key, text) in enumerate(rows):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + rows[(i + 1) % len(rows)][1][:cut]
        result.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(result, key=str)


def edits(found):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=str)


def test_all_documents(spark):
    rows = [(r[0], r[1]) for r in samples.rows(120)]
    found = edited_fingerprints(samples.documents(spark, 120)).collect()
    assert edits(found) == expected_edits(rows)
    texts, prints = dict(rows), {}
    for r in found:
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["fingerprint"] == r["edited_fingerprint"]:
            assert r["near_edited"] == 1


def test_null_and_repeated_ids_and_copies_of_rows(spark, monkeypatch):
    monkeypatch.setattr("metertide.llm.imatch.COPIES_AT_ONCE", 4)
    rng = random.Random(3)
    texts = [samples.prose(rng, "en", 30) for _ in range(6)]
    rows = [(7, texts[0])] * 11 + [(7, texts[1]), (7, texts[2]), (7, texts[2])]
    rows += [(None, texts[3])] * 3 + [(None, texts[4]), (None, None), (None, ""), (None, "")]
    rows += [(1, texts[5]), (2, texts[0]), (3, None), (3, ""), (-4, "x")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = edited_fingerprints(docs).collect()
    assert len(found) == len(rows) and edits(found) == expected_edits(rows)
    again = edited_fingerprints(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    same = [r for r in found if r["doc_id"] == 7 and r["n_chars"] == len(texts[0])]
    assert sum(r["near_next"] == 1 for r in same) >= 10


def test_an_edit_is_more_like_its_text_than_another_text_is(spark):
    rng = random.Random(2)
    rows = [(i, samples.prose(rng, "en", rng.choice([60, 300, 2000]))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = edited_fingerprints(docs, most_share=0.5).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in found) >= 57
    assert sum(r["near_edited"] for r in found) / 60 > 0.2


def test_likeness_of_a_fingerprint_to_itself_and_to_none(spark):
    rows = [(1, "some words of a text, a text of words"), (2, None), (3, ""), (4, "!?"), (5, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprints(docs)
    pairs = found.alias("a").join(found.alias("b"), F.lit(True)).select(
        F.col("a.doc_id").alias("i"),
        F.col("b.doc_id").alias("j"),
        likeness(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("like"),
    )
    like = {(r["i"], r["j"]): r["like"] for r in pairs.collect()}
    assert all(like[i, i] == 1 for i in range(1, 6))
    assert like[2, 3] == like[3, 4] == 1
    assert like[1, 2] == 0
    assert all(like[i, j] == like[j, i] for i, j in like)


def test_frequencies_count_documents(spark):
    rows = [(1, "The cat. THE cat"), (2, "the dog"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["n"] for r in document_frequencies(docs).collect()) == [1, 1, 2]


def test_the_band_leaves_terms_out(spark):
    rng = random.Random(5)
    plain = [samples.prose(rng, "en", 50) for _ in range(30)]
    rows = [(2 * i, t) for i, t in enumerate(plain)] + [(2 * i + 1, t + " zzz") for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs, most_share=0.3).collect()}
    assert all(found[2 * i] == found[2 * i + 1] for i in range(30))


def test_next_documents_over_many_blocks(spark):
    ids = list(range(0, 900, 3))
    docs = spark.createDataFrame([(i, 5) for i in ids], "doc_id long, n_chars long").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = {r["doc_id"]: r["next_id"] for r in next_documents(docs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == {i: i - 3 if i else 897 for i in ids}


def test_no_python_runs_in_tasks(spark):
    plan = edited_fingerprints(samples.documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    row = edited_fingerprints(one).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert row["near_next"] == 1
    assert edited_fingerprints(samples.empty(spark)).count() == 0


def test_texts_are_shuffled_once_for_both_joins(spark, monkeypatch):
    plans = []

    def keep(df, name):
        if name == "fingerprints":
            df.write.format("noop").mode("overwrite").save()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    kept = imatch.materialize
    monkeypatch.setattr("metertide.llm.imatch.materialize", keep)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edited_fingerprints(samples.documents(spark, 40)).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plans[0]
