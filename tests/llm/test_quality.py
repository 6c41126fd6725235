import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metertide.llm.quality import (
    QualityModel,
    compressor,
    feature,
    fit_curve,
    learn_quality,
    pieces,
    score_quality,
)
from tests.llm import samples


def labelled(spark, count=240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(count):
        good = i % 4 > 0
        text = samples.prose(rng, "en", 200)
        rows.append((i, text if good else text.replace(" ", " | ### ")))
        labels.append((i, int(good)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_held_out_texts_get_their_label(spark):
    documents, labels = labelled(spark)
    model = learn_quality(documents, labels.filter("doc_id < 160"))
    assert model.good and model.bad and model.slope > 0
    found = score_quality(documents, model).join(labels, "doc_id").filter("doc_id >= 160").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_the_feature_is_the_difference_of_compressed_sizes():
    good, bad = compressor(b"good words in a row " * 40), compressor(b"| ### | $$$ " * 60)
    text = b"good words in a row, again and again " * 40
    saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text))
    assert saved > 0
    assert feature(text, good, bad) == saved / (len(text) + 64)
    assert b"".join(pieces(text)) == text
    assert feature(b"", good, bad) == 0


def test_the_curve_is_the_most_likely_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, intercept = fit_curve(x, y)
    assert slope == pytest.approx(2, abs=0.2)
    assert intercept == pytest.approx(-1, abs=0.2)
    slope, _ = fit_curve(np.array([0.0, 1.0]), np.array([0.0, 1.0]))  # told apart without error
    assert np.isfinite(slope)


def test_scores_depend_on_text_alone(spark):
    documents, labels = labelled(spark, 80)
    model = learn_quality(documents, labels)
    again = learn_quality(documents.repartition(7), labels.repartition(3))
    assert model == again
    twice = score_quality(documents.union(documents), model).groupBy("doc_id")
    assert twice.agg({"score": "min"}).count() == 80


def test_samples_stay_within_their_bounds(spark):
    documents, labels = labelled(spark)
    assert learn_quality(documents, labels, sample_bytes=0) == QualityModel(b"", b"", 0.0, 0.0)
    small = learn_quality(documents, labels, sample_rows=40)
    assert small != learn_quality(documents, labels)


def test_odd_rows(spark):
    documents = samples.documents(spark)
    labels = spark.createDataFrame(
        [(0, 1), (1, 0), (2, 1), (2, 1), (3, 0), (5, None), (None, 1), (6, 7), (1000, 0), (1001, 1)],
        "doc_id long, quality int",
    )
    model = learn_quality(documents, labels)
    found = score_quality(documents, model).collect()
    assert len(found) == len(samples.rows())
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1000]["score"] == by_id[1001]["score"]
    assert by_id[1000]["saved"] == 0


@pytest.mark.parametrize("quality", [[], [1, 1, 1], [0, 0]])
def test_labels_of_one_class_or_none(spark, quality):
    documents = samples.documents(spark)
    rows = list(enumerate(quality))
    model = learn_quality(documents, spark.createDataFrame(rows, "doc_id long, quality int"))
    scores = {r["score"] for r in score_quality(documents, model).collect()}
    assert len(scores) == 1
    assert score_quality(samples.empty(spark), model).count() == 0


def test_a_text_above_the_bytes_of_the_sample_leaves_room_for_the_others(spark):
    documents, labels = labelled(spark)
    first = labels.orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    long = F.when(F.col("doc_id") == first, F.repeat("text", 2000)).otherwise(F.col("text"))
    model = learn_quality(documents.withColumn("text", long), labels, sample_bytes=1 << 20)
    assert model.good and model.bad and model.slope > 0
    found = score_quality(documents, model).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in found]) > 0.95
