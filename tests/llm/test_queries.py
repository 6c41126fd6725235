"""The registered queries of this package."""

import re

import pytest

from metertide.llm.oracle import ORACLE
from metertide.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    numbers = sorted(int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 14))
    assert "pipeline" in QUERIES
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_language_id", "doc_id:bigint held_out:boolean lang_pred:string score:double"),
        ("op2_packing", "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint"),
        ("op3_simhash", "doc_id:bigint fingerprint:string component_id:bigint"),
        ("op4_document_fingerprints", "doc_id:bigint n_chars:bigint edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double"),
        ("op5_suffix_dedup", "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string"),
        ("op6_quality", "doc_id:bigint held_out:boolean score:double predicted:int"),
        ("op8_mixing", "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint"),
        ("op9_url_filter", "page_id:bigint host:string path:string rule:string verdict:string"),
        ("op10_top_k", "query_id:bigint rank:int vec_id:bigint score:bigint"),
        ("op11_jaccard_join", "doc_id:bigint n_shingles:bigint component_id:bigint"),
        ("op12_vector_codes", "vec_id:bigint code:string error:bigint label_error:bigint codebooks_sha256:string"),
        ("op13_conversation_repair", "conv_id:bigint gaps:bigint blank:bigint duplicate:bigint truncated:bigint illegal:bigint cost:bigint audit:string repaired_sha256:string"),
    ],
)
def test_columns_of_the_contract(spark, name, columns):
    found = QUERIES[name](spark, SF_DIR)
    kinds = dict(found.dtypes)
    for column in columns.split():
        column, kind = column.split(":")
        assert kinds[column] == kind
    if name not in ("op2_packing", "op10_top_k"):
        key = found.columns[0]
        assert found.count() == found.select(key).distinct().count() > 0
