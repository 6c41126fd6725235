"""The pipeline against plain versions of its stages, each on the rows of the stage before."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from metertide.llm.mixing import mix_to_targets, mixed_documents
from metertide.llm.simhash import fingerprint, one_of_each_group, shingle_hashes
from tests.llm import samples
from tests.llm.test_packing import expected_ids
from tests.llm.test_substrings import MATCH


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    samples.documents(spark, 120).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    result = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        result.append(docs)
    return result


def pairs(df):
    """(doc_id, text), sorted; null ids last."""
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_stages_and_columns(steps):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == [
        "language ID", "SimHash near-dedup", "suffix-array dedup", "mixing to target weights", "packing",
    ]
    for df in steps[:-1]:
        assert df.columns == steps[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in steps[0].schema]
    assert corpus_pipeline.ORACLE_SQL is None


def test_texts_without_a_letter_go(steps):
    expected = [r for r in pairs(steps[0]) if any(c.isalpha() for c in r[1] or "")]
    assert pairs(steps[1]) == expected
    assert 0 < len(expected) < steps[0].count()


def spread(linked):
    """The smallest number that each of n numbers reaches over a matrix of links."""
    group = np.arange(len(linked))
    for _ in linked:
        group = np.array([group[np.append(np.flatnonzero(row), i)].min() for i, row in enumerate(linked)])
    return group


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_one_document_of_each_group_stays(steps):
    """All pairs of rows, by the bits of their fingerprints."""
    rows = sorted(set(all_rows(steps[1])), key=str)
    words = np.array([fingerprint(shingle_hashes(r[1], 3)) for r in rows], np.uint64)
    group = spread(np.array([np.bitwise_count(words ^ w).sum(axis=1) for w in words]) <= 3)
    kept = all_rows(steps[2])
    assert set(kept) <= set(rows)
    places = {r: i for i, r in enumerate(rows)}
    assert sorted(int(group[places[r]]) for r in kept) == sorted(set(group.tolist()))
    least = {}
    for r, g in zip(rows, group.tolist(), strict=True):
        least.setdefault(g, []).append((r[0] is None, r[0] or 0))
    assert all((r[0] is None, r[0] or 0) == min(least[group[places[r]]]) for r in kept)
    assert 0 < len(kept) < len(rows)


def test_rows_of_one_id_stand_for_themselves(spark):
    schema = "doc_id long, text string, first string, _row string, _mix string"
    rows = [
        (1, "alpha beta gamma delta", "a", "b", "c"), (1, "completely other words than these", "a", "b", "c"),
        (1, "completely other words than these", "a", "b", "c"), (2, "completely other words than these", "a", "b", "c"),
        (None, "no id but words of its own", "a", "b", "c"), (None, "alpha beta gamma delta", "a", "b", "c"),
    ]
    found = [all_rows(one_of_each_group(spark.createDataFrame(rows, schema))) for _ in range(2)]
    assert found[0] == found[1] == sorted([rows[0], rows[1], rows[4]], key=str)


def test_mixing_with_columns_of_any_name(spark):
    names = ["first", "start", "copies", "blocks", "extra", "taken", "_size", "_mix", "_part", "place"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    rows = [(i % 30, f"some words of text {i} " * (1 + i % 4), f"s{i % 3}", *"x" * len(names)) for i in range(60)]
    rows += [(None, "a row without an id", None, *"x" * len(names)), (99, None, "s0", *"x" * len(names))]
    df = spark.createDataFrame(rows, schema).repartition(4)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    assert all_rows(mixed) == all_rows(mixed_documents(df.repartition(3)))
    assert 0 < mixed.count() and mixed.select(*names).distinct().count() == 1


def test_later_copies_of_passages_go(steps):
    rows = pairs(steps[2])
    first = {}
    for key, text in rows:
        data = text.encode()
        for i in range(len(data) - MATCH + 1) if key is not None else ():
            first.setdefault(data[i : i + MATCH], key)
    expected = []
    for key, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), dtype=bool)
        for i in range(len(data) - MATCH + 1) if key is not None else ():
            if first[data[i : i + MATCH]] < key:
                gone[i : i + MATCH] = True
        if not len(data) or not gone.all():
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
            expected.append((key, kept))
    assert pairs(steps[3]) == expected
    lengths = steps[3].filter(F.length("text") != F.col("n_chars")).count()
    assert lengths == 0


def test_documents_come_as_often_as_they_are_taken(steps):
    mix = mix_to_targets(steps[3]).collect()
    wanted = {r["doc_id"]: r["taken"] for r in mix if r["taken"]}
    texts = {key: text.split() for key, text in pairs(steps[3])}
    got = {}
    for key, text in pairs(steps[4]):
        words = text.split()
        got[key] = got.get(key, 0) + len(words)
        it = iter(texts[key])  # in the order of the document
        assert all(w in it for w in words)
    assert got == wanted


def test_every_id_of_the_mix_is_packed(steps):
    pieces = steps[5].toPandas()
    expected = sorted(len(expected_ids(t)) for _, t in pairs(steps[4]))
    starts = pieces[pieces["start"] == 0]
    assert sorted(starts["doc_tokens"]) == expected
    assert pieces["length"].sum() == sum(expected)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["length"].sum() <= 4096
    for key, text in pairs(steps[4])[:20]:
        data = np.array(expected_ids(text), dtype="<u4")
        own = pieces[(pieces["doc_id"] == key) & (pieces["doc_tokens"] == len(data))]
        checks = {(p.start, p.length): p.ids_crc32 for p in own.itertuples()}
        found = [zlib.crc32(data[a : a + n].tobytes()) == c for (a, n), c in checks.items()]
        assert any(found)


def test_run_applies_all_stages(spark, folder, steps):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == steps[5].columns
    assert whole.agg(F.sum("length")).first() == steps[5].agg(F.sum("length")).first()
    heads = [df.filter("start = 0").select("doc_id", "doc_tokens") for df in (whole, steps[5])]
    assert sorted(map(str, heads[0].collect())) == sorted(map(str, heads[1].collect()))
    assert set(columns) <= set(whole.columns)


def test_empty_table(spark, tmp_path):
    samples.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
