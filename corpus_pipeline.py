"""From raw documents to packed training sequences: five stages, each written as Parquet.

A stage takes the session, the rows of the stage before and the folder of the tables. Its result is
written to the shared folder and read again, so a stage starts from files and outlives lost
executors. Tables that a stage needs on the way are removed when it is written. All stages but the last
return the columns of ``documents``, whatever further ones there are. An empty table gives no rows.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from metertide.llm.language import learn_languages, of_known_language
from metertide.llm.mixing import mixed_documents
from metertide.llm.packing import pack
from metertide.llm.simhash import one_of_each_group
from metertide.llm.substrings import repeated_passages
from metertide.workspace import new_path, temporary_tables


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter go, so also null and empty texts. Learns
    from the given labels. Each row is judged by itself, whatever its ``doc_id``."""
    langs, model = learn_languages(docs.filter(F.col("doc_id").isNotNull()))
    return of_known_language(docs, langs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest ``doc_id``.

    Texts are linked whose fingerprints, of all runs of three words, differ in at most 3 of 64 bits. Rows
    stand for themselves, also with a null or repeated ``doc_id``; null and empty texts are one group.
    """
    return one_of_each_group(docs, words=3, bits=64, limit=3)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a document with a smaller id has; emptied ones go. Rows with a
    null ``doc_id`` come before no other and stay uncut."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    known = docs.filter("doc_id IS NOT NULL")
    cut = repeated_passages(known, tuple(others)).filter("n_removed < n_bytes OR n_bytes = 0")
    id_type = docs.schema["doc_id"].dataType
    columns = {"doc_id": F.col("doc_id").cast(id_type), "text": F.col("kept")}
    rows = cut.select(*(columns.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.length("text").cast(kind))
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, and the parts that further blocks take. A null source
    is a source; texts without words are never taken."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which ids of a document lie where in which sequence. Every row is packed, copies too."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, fingerprints and dynamic programming are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with temporary_tables(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return docs
