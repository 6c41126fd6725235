"""Updates, deletes, appends and edits by row index."""

import pytest
from pyspark.sql import functions as F

from metertide.operators.tables import (
    append_indexed_rows,
    append_rows,
    delete_where,
    edit_by_index,
    update_where,
)


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(4, "a"), (5, "b"), (6, "c"), (None, "d")], "id int, name string")


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def test_update_leaves_null_conditions_alone(table):
    changed = update_where(table, F.col("id") == 5, {"name": F.lit("edited")})
    assert rows_of(changed) == rows_of(table.replace("b", "edited"))


def test_update_of_several_columns_sees_the_old_values(table):
    changed = update_where(
        table.filter("id = 5"), F.col("id") == 5, {"id": F.col("id") + 1, "name": F.col("id").cast("string")}
    )
    assert rows_of(changed) == [(6, "5")]


def test_delete_keeps_null_conditions(table):
    assert rows_of(delete_where(table, F.col("id") == 6)) == sorted(
        [(4, "a"), (5, "b"), (None, "d")], key=str
    )


def test_append(table):
    assert append_rows(table, [(7, "e"), (None, None)]).count() == 6


def test_append_goes_on_with_the_index(spark):
    df = spark.createDataFrame([(0, "1-1"), (1, "1-2"), (2, "1-3")], "index bigint, col1 string")
    grown = append_indexed_rows(append_indexed_rows(df, [("1-4",)]), [("1-5",), ("1-6",)])
    assert rows_of(grown) == [(n, f"1-{n + 1}") for n in range(6)]
    assert grown.schema == df.schema


def test_edit_by_index(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "c", "z")], "index bigint, col1 string, col2 string")
    edits = spark.createDataFrame([(0, "Edited"), (2, None), (9, "nowhere")], "index bigint, col2 string")
    assert rows_of(edit_by_index(df, edits, "col2")) == [
        (0, "a", "Edited"), (1, "b", "y"), (2, "c", None),
    ]


def test_two_edits_of_one_row_are_an_error(spark):
    df = spark.createDataFrame([(0, "a")], "index bigint, col1 string")
    edits = spark.createDataFrame([(0, "b"), (0, "c")], "index bigint, col1 string")
    with pytest.raises(Exception, match="several edits for row 0"):
        edit_by_index(df, edits, "col1").collect()
