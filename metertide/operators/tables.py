"""Table edits as transforms: update, delete, append, edit by row index."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def update_where(
    df: DataFrame, condition: Column, assignments: Mapping[str, Column]
) -> DataFrame:
    """Set columns on the rows that meet ``condition``; rows where it is null stay as they are."""
    return df.withColumns(
        {
            name: F.when(condition, value).otherwise(F.col(name))
            for name, value in assignments.items()
        }
    )


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop the rows that meet ``condition``; rows where it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def append_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """Add a few given rows, in the column order of ``df``."""
    return df.unionByName(df.sparkSession.createDataFrame(list(rows), df.schema))


def append_indexed_rows(
    df: DataFrame, rows: Sequence[tuple], index: str = "index"
) -> DataFrame:
    """Add given rows, without their index, to an indexed frame; numbering goes on at its size."""
    columns = [name for name in df.columns if name != index]
    size = df.agg(F.count(F.lit(1))).scalar()
    schema = df.select(index, *columns).schema
    new = df.sparkSession.createDataFrame(
        [(offset, *row) for offset, row in enumerate(rows)], schema
    ).withColumn(index, F.col(index) + size)
    return df.unionByName(new)


def edit_by_index(
    df: DataFrame, edits: DataFrame, column: str, index: str = "index"
) -> DataFrame:
    """Overwrite ``column`` on the rows that ``edits(index, column)`` names, also with null.

    Two edits of one row are an error, as they would multiply it.
    """
    only = F.when(F.count(F.lit(1)) == 1, F.any_value(column)).otherwise(
        F.raise_error(F.concat(F.lit("several edits for row "), F.col(index)))
    )
    new = edits.groupBy(index).agg(F.struct(only.alias("value")).alias("_edit"))
    return (
        df.join(new, index, "left")
        .withColumn(
            column,
            F.when(F.col("_edit").isNotNull(), F.col("_edit.value")).otherwise(F.col(column)),
        )
        .select(df.columns)
    )
